import random
import re

import pytest

from tidewake.llm import licences

BASE = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if tuple(words[i : i + len(phrase)]) == phrase]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None,
    "",
    "...",
    "MIT License, mit-license; MIT LICENSE mit license",
    "Licensed under CC BY-NC 4.0.\nThis work is under the GNU General Public License, version 3.",
    "élan CC\x00BY überall cc by",
    "submit license",
    "word " * 30000 + "Apache License",
]


def test_base_columns_equal_brute_force(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "mit license", "c"), (3, TEXTS[3], "c")]
    got = licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licences.licence_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_expressions():
    assert licences.to_postfix("MIT OR Apache-2.0 AND ISC") == ["MIT", "Apache-2.0", "ISC", "and", "or"]
    assert licences.to_postfix("(MIT OR Apache-2.0) AND GPL-2.0 WITH X */") == ["MIT", "Apache-2.0", "or", "GPL-2.0", "X", "with", "and"]
    assert licences.to_postfix("MIT AND") == ["MIT"]
    assert licences.to_postfix("OR MIT") is None and licences.to_postfix("") is None and licences.to_postfix("(MIT") is None
    assert licences.evaluate(["MIT", "GPL-3.0", "or"]) == ({"mit", "gpl-3.0"}, True)
    assert licences.evaluate(["MIT", "GPL-3.0", "and"])[1] is False
    row = licences.scan("x\n// SPDX-License-Identifier: (MIT OR GPL-2.0)\ny")
    assert row[5] == "gpl-2.0,mit" and row[8] is True and row[6] > 0.9


def test_with_stands_between_two_names():
    assert licences.evaluate(licences.to_postfix("GPL-2.0 WITH Classpath-exception-2.0 OR MIT")) == ({"gpl-2.0-with-classpath-exception-2.0", "mit"}, True)
    for line, names in (("(MIT OR Apache-2.0) WITH X", {"mit", "apache-2.0", "x"}), ("MIT WITH (A OR B)", {"mit", "a", "b"}), ("MIT WITH A WITH B", {"mit-with-a", "b"})):
        assert licences.evaluate(licences.to_postfix(line)) == (names, None)
        row = licences.scan("License-Expression: " + line)
        assert row[5] == ",".join(sorted(names)) and row[7] == "" and row[8] is None and row[6] == 0.5
    assert licences.to_postfix("MIT/Apache-2.0") == ["MIT", "Apache-2.0", "or"]


def brute_tags(text):
    """(label set, expressions) of tags found by a plain search of the raw text, for expressions of AND and OR without brackets."""
    names, count = set(), 0
    for m in re.finditer(r"(?i)(?<![a-z0-9\x80-\uffff])(?:spdx[^a-z0-9\x80-\uffff]+license[^a-z0-9\x80-\uffff]+identifier|license[^a-z0-9\x80-\uffff]+expression)[ \t]*:([^\r\n]*)", text):
        parts = re.split(r" (?:AND|OR) ", m[1].strip())
        names |= {p.lower() for p in parts}
        count += 1
    return names, count


def test_tags_labels_and_score_equal_brute_force():
    rng = random.Random(5)
    names = ["MIT", "Apache-2.0", "GPL-3.0-only", "ISC", "0BSD"]
    phrases = {"public domain": "public-domain", "CC-BY": "cc-by", "bsd license": "bsd", "all rights reserved": "proprietary", "MIT License": "mit"}
    for _ in range(300):
        lines, want, found = [], set(), 0
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                lines.append(rng.choice(["// ", "é ", "", "# 漢字 "]) + rng.choice(["SPDX-License-Identifier", "spdx license identifier", "License-Expression"]) + rng.choice([": ", " :", ":"]) + f" {rng.choice(['AND', 'OR'])} ".join(rng.choice(names) for _ in range(rng.randint(1, 3))))
            elif kind < 0.7:
                p = rng.choice(list(phrases))
                lines.append("x " + p + " y")
                want.add(phrases[p])
                found += 1
            else:
                lines.append("no tag here SPDX-License-Identifier MIT")
        text = "\nz\n".join(lines)
        tagged, n = brute_tags(text)
        row = licences.scan(text)
        assert row[5] == ",".join(sorted(want | tagged)), text
        assert row[6] == pytest.approx(1 - 0.2**found * 0.05**n)
        assert len(list(filter(None, row[7].split(";")))) == n


def test_words_behind_a_tag_that_are_no_licences():
    for line in ("see the file COPYING", "none of your business", "TBD", "NOASSERTION"):
        row = licences.scan(f"License-Expression: {line}")
        assert row[5] == "" and row[6] == 0.5 and row[7] == "" and row[8] is None
    mixed = licences.scan("SPDX-License-Identifier: MIT OR Whatever")
    assert mixed[5] == "mit" and mixed[6] == 0.5 and mixed[8] is None
    for name in ("MIT", "GPL-2.0-or-later", "LGPL-2.1+", "Apache-2.0", "BSD-3-Clause", "CC-BY-NC-SA-4.0", "LicenseRef-my.own-1", "0BSD", "MPL-2.0"):
        assert licences.is_identifier(name) and licences.scan(f"spdx-license-identifier: {name}")[6] >= 0.95
    assert licences.is_identifier("gpl-2.0-with-classpath-exception-2.0") and not licences.is_identifier("gpl-2.0-with-glasses")
