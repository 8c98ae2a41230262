"""Licence scan: Aho-Corasick over notice phrases and identifier tags, and a shunting-yard parser for expressions."""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases that only add labels.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
#: Words of the tags after which, behind a colon, a licence expression stands in the raw text.
TAGS = ("spdx license identifier", "license expression")
# Identifiers, by lower-cased prefix, that a permissive-only policy accepts.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc-by", "cc0", "zlib", "unlicense", "bsl", "python")
RESTRICTED = ("cc-by-nc", "cc-by-nd", "cc-by-sa")

# Forms of lower-cased licence identifiers and of exceptions, as the SPDX list has them, and references to licences of one's own.
IDENTIFIERS = re.compile(
    r"mit(-0|-cmu|-feh|-modern-variant)?|apache(-[12]\.[01])?|[al]?gpl(-?v?[123](\.[01])?)?(-only|-or-later|\+)?|gfdl-1\.[123](-only|-or-later|\+)?|bsd(-[1-4]-clause(-[a-z-]+)?)?|0bsd|isc|mpl-[12]\.[01](\+|-no-copyleft-exception)?|epl-[12]\.0|eupl-1\.[012]"
    r"|cddl-1\.[01]|cc0-1\.0|cc-by(-nc)?(-nd|-sa)?(-[1234]\.[05])?(-[a-z]+)?|zlib|libpng(-2\.0)?|unlicense|wtfpl|bsl-1\.0|busl-1\.1|python-2\.0(\.1)?|psf-2\.0|artistic-[12]\.0(-[a-z]+)?|x11|ncsa|postgresql|openssl|ofl-1\.[01]|upl-1\.0|ms-[pr]l|osl-[123]\.[01]|afl-[123]\.[012]"
    r"|blueoak-1\.0\.0|json|curl|ruby|vim|php-3\.0[01]?|unicode-(dfs-201[56]|3\.0|tou)|hpnd|ijg|bzip2-1\.0\.[56]|w3c|zpl-[12]\.[01]|(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)
EXCEPTIONS = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|linux-syscall-note|(documentref-[a-z0-9.-]+:)?additionref-[a-z0-9.-]+")

#: Every byte outside a word becomes a space, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TOKEN = re.compile(r"\s*(\(|\)|/|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BEHIND_TAG = re.compile(rb"[ \t]*:([^\r\n]*)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def to_postfix(line: str) -> list[str] | None:
    """The longest well-formed expression at the head of ``line`` in postfix order (shunting-yard); None if there is none.

    A slash between two licences means OR, as older package manifests have it.
    """
    out: list[str] = []
    stack: list[str] = []
    best, at, operand_next = None, 0, True
    while m := _TOKEN.match(line, at):
        token = m[1]
        op = "or" if token == "/" else token.lower()
        if operand_next:
            if op in _PRECEDENCE or token == ")":
                break
            if token == "(":
                stack.append(token)
            else:
                out.append(token)
                operand_next = False
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif op in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[op]:
                out.append(stack.pop())
            stack.append(op)
            operand_next = True
        else:
            break
        at = m.end()
        if not operand_next and "(" not in stack:
            best = out + stack[::-1]
    return best


def evaluate(postfix: list[str], allowed=lambda name: name.startswith(PERMISSIVE) and not name.startswith(RESTRICTED)) -> tuple[set[str], bool | None]:
    """The licences that an expression names (a WITH pair is one name), and whether the policy can be met.

    OR needs one side, AND both; an exception after WITH only adds permissions, so its licence decides.  WITH stands between
    two names: with a compound on either side the expression says nothing, its names are kept and the policy is None.
    """
    stack: list[tuple[str, set[str], bool]] = []
    sound = True
    for token in postfix:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if token == "with" and left[0] and right[0] and "-with-" not in left[0]:
                name = f"{left[0]}-with-{right[0]}"
                stack.append((name, {name}, left[2]))
            else:
                sound &= token != "with"
                stack.append(("", left[1] | right[1], left[2] and right[2] if token == "and" else left[2] or right[2]))
        else:
            name = token.lower()
            stack.append((name, {name}, allowed(name)))
    return stack[0][1], stack[0][2] if sound else None


def is_identifier(name: str) -> bool:
    """Whether a name is of a known form; of a WITH pair, both parts."""
    licence, _, exception = name.lower().partition("-with-")
    return bool(IDENTIFIERS.fullmatch(licence)) and (not exception or bool(EXCEPTIONS.fullmatch(exception)))


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *MORE_PHRASES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of one whole text.

    The automaton finds phrases and tags by their words; a tag's place gives the line of the raw text that is parsed.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    words = folded.split()
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    places, base, labels, tags, phrases = [], set(), set(), [], 0
    for end, phrase in _automaton().iter(line):
        if phrase in BASE_PHRASES:
            places.append(end - len(phrase) - 1)
            base.add(BASE_PHRASES[phrase])
            phrases += 1
        elif phrase in MORE_PHRASES:
            labels.add(MORE_PHRASES[phrase])
            phrases += 1
        else:
            tags.append(end)
    starts = [line.count(" ", 0, p + 1) - 1 for p in ((min(places), max(places)) if places else ())]
    expressions, broken, verdicts = [], 0, []
    if tags:
        spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        letters = np.append(np.frombuffer(folded, np.uint8) != 32, False)
        ends = np.flatnonzero(letters[:-1] & ~letters[1:]) + 1
        for last in (np.searchsorted(spaces, tags) - 1).tolist():  # number of the tag's last word
            if m := _BEHIND_TAG.match(raw, int(ends[last])):
                postfix = to_postfix(m[1].decode("utf-8", "replace"))
                names, fits = evaluate(postfix) if postfix else (set(), None)
                real = names if fits is None else {n for n in names if is_identifier(n)}
                labels |= real
                if fits is None or real != names:  # words that are no licences, as in "see the file"
                    broken += 1
                else:
                    expressions.append(" ".join(postfix))
                    verdicts.append(fits)
    score = 1 - 0.2**phrases * 0.05 ** len(expressions) * 0.5**broken
    return (len(words), len(places), *(starts or (None, None)), ",".join(sorted(base)), ",".join(sorted(labels | base)), score, ";".join(expressions), all(verdicts) if verdicts else None)


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``; see :func:`scan`.

    ``n_base`` counts all places of base phrases, ``first_word``/``last_word`` are the smallest and largest word numbers
    at which one starts (NULL without any).  ``score`` is the noisy-or evidence of notices (0.8 each), parsed tags (0.95)
    and unparsable tags (0.5), those with a name of no known form (:data:`IDENTIFIERS`) among them; ``expressions`` are the parsed tags in postfix order and ``permissive`` whether all can be
    met with permissive licences (NULL without a tag).  NULL text counts as empty: zeros, empty strings.  NULL and
    repeated keys give a row each.  Whole texts are scanned in one pass, map side only.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("permissive", pa.bool_())])

    def batches(it):
        for batch in it:
            columns = list(zip(*map(scan, batch.column(1).to_pylist()))) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"
    )
