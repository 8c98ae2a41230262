"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, and a unigram base."""

from __future__ import annotations

import base64
import dataclasses
import functools
import io
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import crc_fold
from tidewake.scratch import saved

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Steps that a window scores, and the window: as many steps again come before them.
STRIDE = 32
WINDOW = 2 * STRIDE
#: Width of the layers, and of the hidden one of the feed-forward layer.
WIDTH, HIDDEN = 16, 64
#: Classes of subwords (the last one is the end of a text), and subwords with rows of their own.
CLASSES, FREQUENT = 35, 1024
#: Windows in a step of training, and sizes of the steps, of the start and of the whole corpus.
BATCH, RATE = 64, 0.02
LATER_BATCH, LATER_RATE = 256, 0.0015
FOLDS, HELD = 7, 2
_WINDOWS, _SLICE = 256, 400_000


@dataclasses.dataclass(frozen=True)
class Settings:
    """Training starts from weights fitted in ``steps`` to about ``start`` subwords of training texts, picked by a hash; then
    every window of every block of the corpus trains them further.  Counts of words and subwords are of all rows.

    ``share`` above 1 leaves windows out, all but one in ``share``: for trials.

    ``block`` are the characters of text per block, in which words are numbered and counted.
    """

    start: int = 3_000_000
    steps: int = 1500
    share: int = 1
    block: int = 5_000_000


@functools.cache
def _subwords(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe, len(ranks)


@functools.cache
def _starts(path: str) -> np.ndarray:
    """Whether a subword begins a word."""
    out = np.zeros(_subwords(path)[1], bool)
    for a, b in map(bytes.split, open(path, "rb")):
        out[int(b)] = base64.b64decode(a)[:1] == b" "
    return out


def _pieces(words: pa.Array) -> list[bytes]:
    """Strings in UTF-8."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    raw = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


class Block:
    """The words of some texts: distinct words, and per text the indexes of its words among them."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        words, at, sizes = _pieces(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(split.offsets.to_numpy())
        if b"" in words:  # what stands before a first and behind a last space
            void = words.index(b"")
            keep = at != void
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
            at, words = at[keep] - (at[keep] > void), words[:void] + words[void + 1 :]
        self.words, self.at, self.sizes = words, at, sizes.astype(np.int64)
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)

    def subwords(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of each distinct word after a space."""
        core, _ = _subwords(path)
        found = [core.encode_single_piece(b" " + w) for w in self.words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum())), sizes


def doc_of(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def sequences(at: np.ndarray, doc_sizes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of all texts one after the other, and how many each has."""
    begins, n = np.cumsum(sizes) - sizes, sizes[at]
    flat = np.arange(int(n.sum())) + np.repeat(begins[at] - (np.cumsum(n) - n), n)
    return ids[flat], np.bincount(doc_of(doc_sizes), weights=n, minlength=len(doc_sizes)).astype(np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    """Integers, compressed byte plane by byte plane."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _swollen(raw: bytes, dtype: str, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * width, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).reshape(n).astype(np.int64)


# ---- the model


def _classes(flat: np.ndarray, sizes: np.ndarray, vocabulary: int, starts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class (0 .. CLASSES-2) per subword: those seen often are clustered by their neighbours, the rest by position."""
    out = np.where(starts, CLASSES - 2, CLASSES - 3).astype(np.int64)
    flat = np.insert(flat, np.cumsum(sizes), -1)
    seen = np.bincount(flat[flat >= 0], minlength=vocabulary)
    often = np.flatnonzero(seen >= 30)
    k = CLASSES - 3
    if len(often) <= k:
        return out
    row = np.full(vocabulary + 1, -1)
    row[often] = np.arange(len(often))
    side = np.full(vocabulary + 1, 255)
    side[np.argsort(-seen)[:255]] = np.arange(255)
    side[vocabulary] = 254
    left, right = flat[:-1], flat[1:]
    near = np.zeros((len(often), 512))
    hit = (left >= 0) & (row[left] >= 0)
    np.add.at(near, (row[left[hit]], side[right[hit]]), 1)
    hit = (right >= 0) & (row[right] >= 0)
    np.add.at(near, (row[right[hit]], 256 + side[left[hit]]), 1)
    near = np.concatenate([np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1)), starts[often, None] * 0.7], axis=1)
    centres = near[rng.choice(len(often), k, replace=False, p=seen[often] / seen[often].sum())]
    for _ in range(12):
        own = ((centres * centres).sum(1) / 2 - near @ centres.T).argmin(1)
        for c in range(k):
            if (own == c).any():
                centres[c] = np.average(near[own == c], axis=0, weights=seen[often[own == c]])
    out[often] = own
    return out


class Shape:
    """How subwords are coded: a frequent one is a member of its class; in each class one more member stands for all others.

    ``row`` numbers the input rows: frequent subwords, then the others by class, then the begin of a text.  ``within`` is
    log P(subword | others of its class) from counts, 0 for frequent ones.
    """

    def __init__(self, classes: np.ndarray, counts: np.ndarray, docs: int):
        self.cls = classes
        self.cls_of = np.append(classes, [CLASSES - 1] * 2).astype(np.uint8)  # of -1 and -2, too
        often = np.argsort(-counts, kind="stable")[:FREQUENT]
        often = often[counts[often] > 0]
        self.member, self.sizes = np.full(len(classes), -1), np.zeros(CLASSES - 1, np.int64)
        counted = []
        for c in range(CLASSES - 1):
            mine = often[classes[often] == c]
            self.member[mine], self.sizes[c] = np.arange(len(mine)), len(mine) + 1
            counted.append(counts[mine])
        rest = self.member < 0
        self.member[rest] = self.sizes[classes[rest]] - 1
        others = np.bincount(classes[rest], weights=counts[rest] + 0.5, minlength=CLASSES)
        self.within = np.where(rest, np.log((counts + 0.5) / np.maximum(others, 0.5)[classes]), 0.0).astype(np.float32)
        self.row = np.where(rest, len(often) + classes, 0)
        self.row[often] = np.arange(len(often))
        self.begin = len(often) + CLASSES
        per_class = np.bincount(classes, weights=counts, minlength=CLASSES)
        per_class[-1] = docs
        self.class_bias = np.log(per_class + 1)
        self.member_bias = [np.log(np.append(n, others[c]) + 0.5) for c, n in enumerate(counted)]

    def weights(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        def normal(rows, columns, scale):
            return rng.normal(size=(rows, columns)) * scale

        even = WIDTH**-0.5
        w = {"E": normal(self.begin + 1, WIDTH, 0.3), "B": normal(self.begin + 1, WIDTH, 0.15), "QKV": normal(WIDTH, 3 * WIDTH, even), "O": normal(WIDTH, WIDTH, even / 2), "R": -np.linspace(0, 0.5, WINDOW)}
        w |= {"H": normal(WIDTH, HIDDEN, even), "h": np.zeros(HIDDEN), "D": normal(HIDDEN, WIDTH, HIDDEN**-0.5 / 2), "C": normal(WIDTH, CLASSES, 0.05), "c": self.class_bias}
        for k, n in enumerate(self.sizes):
            w |= {f"M{k}": normal(WIDTH, n, 0.05), f"m{k}": self.member_bias[k]}
        return {k: v.astype(np.float32) for k, v in w.items()}


class Stream:
    """Texts laid end to end in strides: per step its subword before, the one before that, the subword (-1: the end of the
    text; -2: none), and where its text begins.  One empty stride comes first."""

    def __init__(self, shape: Shape, flat: np.ndarray, n: np.ndarray):
        steps, begin = n + 1, np.cumsum(n + 1) - (n + 1)
        self.n, size = int(steps.sum()), -(-int(steps.sum()) // STRIDE) * STRIDE + STRIDE
        at = np.arange(len(flat)) + doc_of(n) + STRIDE
        self.target, self.now, self.start = np.full(size, -2, np.int32), np.full(size + 1, shape.begin, np.int32), np.full(size, size, np.int32)
        self.target[at], self.target[begin + n + STRIDE] = flat, -1
        self.now[at + 1] = shape.row[flat]
        self.now[begin + STRIDE] = shape.begin
        self.now = self.now[:size]
        self.start[STRIDE : STRIDE + self.n] = np.repeat(begin + STRIDE, steps)
        self.before = np.append(np.int32(shape.begin), self.now[:-1])
        self.before[begin + STRIDE] = shape.begin
        self.windows = size // STRIDE - 1
        self.doc = doc_of(steps)


_I, _J = np.arange(STRIDE)[:, None], np.arange(WINDOW)
_SINCE = np.clip(_I + STRIDE - _J, 0, WINDOW - 1)
_SEEN, _SELF, _J32 = (_J <= _I + STRIDE).astype(np.float32), _J == _I + STRIDE, _J.astype(np.int32)
#: Windows whose layers are computed at a time, so that they stay near the processor, and rows of a piece of a product.
_TOGETHER, _PIECE = 128, 128
#: Exponents are kept within this, so that no sum is infinite or zero.
_MOST = np.float32(60)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` piece by piece: small products are spared the packing of large ones."""
    out, whole = np.empty((len(x), w.shape[1]), x.dtype), len(x) // _PIECE
    cut = whole * _PIECE
    np.matmul(x[:cut].reshape(whole, _PIECE, x.shape[1]), w, out=out[:cut].reshape(whole, _PIECE, w.shape[1]))
    np.matmul(x[cut:], w, out=out[cut:])
    return out


def _across(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``x.T @ d`` piece by piece."""
    whole = len(x) // _PIECE
    cut = whole * _PIECE
    out = x[cut:].T @ d[cut:]
    return out + (x[:cut].reshape(whole, _PIECE, -1).transpose(0, 2, 1) @ d[:cut].reshape(whole, _PIECE, -1)).sum(0) if whole else out


def _turned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T)


def _wider(x: np.ndarray, rows: int, columns: int, corner: float = 0) -> np.ndarray:
    """``x`` with further rows and columns of zeros; the last number is ``corner``."""
    out = np.zeros((len(x) + rows, x.shape[1] + columns), x.dtype)
    out[: len(x), : x.shape[1]] = x
    out[-1, -1] = corner
    return out


def _bounded(s: np.ndarray) -> np.ndarray:
    if s.size and (s.max() > _MOST or s.min() < -_MOST):
        np.clip(s, -_MOST, _MOST, out=s)
    return s


class _Order:
    """Steps in the order of their targets' classes, and the places in one array of the members' numbers of each step.

    A class's only member has probability one and no numbers; what is no step is among the ends of texts, which are last.
    """

    def __init__(self, shape: Shape, target: np.ndarray):
        cls = shape.cls_of.take(target, mode="wrap")
        self.order = np.argsort(cls, kind="stable")
        counts = np.bincount(cls, minlength=CLASSES)
        ends = np.cumsum(counts)
        self.target, self.cls, self.several = target[self.order], cls[self.order], np.append(shape.sizes > 1, False)
        self.used, self.words = self.target != -2, int(ends[-2])
        width = np.append(shape.sizes, 0) * self.several
        wide, begins = width[self.cls], np.append(0, np.cumsum(counts * width))
        self.mine = np.flatnonzero(wide)
        self.size = int(begins[-1])
        self.at = (np.cumsum(wide) - wide)[self.mine] + shape.member[self.target[self.mine]]
        #: Class, its steps, and where its numbers are.
        self.classes = [(k, slice(int(ends[k] - counts[k]), int(ends[k])), slice(int(begins[k]), int(begins[k + 1]))) for k in np.flatnonzero((counts > 0) & self.several)]


def _head(w: dict, shape: Shape, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
    """log P of each target, given the last layer and a column of ones: log P(class) + log P(member | class), each a softmax of
    it; and the weights' gradients and the layer's, of minus their mean."""
    by, g = _Order(shape, target), {}
    h, n = h.take(by.order, axis=0), len(target)
    scale, ones = h.dtype.type(1 / max(1, by.used.sum())), np.ones(max(CLASSES, shape.sizes.max()), h.dtype)

    def both(weight: str, bias: str) -> np.ndarray:
        return np.concatenate([w[weight], w[bias][None]])

    s = _bounded(_times(h, both("C", "c")))
    at = np.arange(0, s.size, CLASSES) + by.cls
    out = s.take(at)
    np.exp(s, out=s)
    total = s @ ones[:CLASSES]
    s *= (scale / total)[:, None]
    s.reshape(-1)[at] -= scale
    s[by.words :] *= by.used[by.words :, None]
    out -= np.log(total)
    found = _across(h, s)
    g["C"], g["c"], d_h = found[:-1], found[-1], _times(s, _turned(w["C"]))
    out[: by.words] += shape.within[by.target[: by.words]]
    s, total, parts = np.empty(by.size, h.dtype), np.ones(n, h.dtype), []
    for k, steps, place in by.classes:
        parts.append(s[place].reshape(-1, shape.sizes[k]))
        np.matmul(h[steps], both(f"M{k}", f"m{k}"), out=parts[-1])
    own = _bounded(s).take(by.at)
    np.exp(s, out=s)
    for (_, steps, _), part in zip(by.classes, parts):
        np.matmul(part, ones[: part.shape[1]], out=total[steps])
    out[by.mine] += own - np.log(total[by.mine])
    total, d_m = scale / total, np.zeros_like(d_h)
    for (_, steps, _), part in zip(by.classes, parts):
        part *= total[steps, None]
    s[by.at] -= scale
    for (k, steps, _), part in zip(by.classes, parts):
        found = h[steps].T @ part
        g[f"M{k}"], g[f"m{k}"] = found[:-1], found[-1]
        np.matmul(part, w[f"M{k}"].T, out=d_m[steps])
    d_h += d_m
    out[~by.used] = 0
    logp, d = np.empty_like(out), np.empty_like(d_h)
    logp[by.order], d[by.order] = out, d_h
    return logp, g, d


def _slices(n: np.ndarray, most: int):
    """(first, end) of runs of texts with about ``most`` subwords."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def scores(w: dict, shape: Shape, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text, the sum of log P(subword | subwords before it in its window) over its subwords and its end.

    The same as the model's layers in ``gradients``, with what can be computed once for all windows taken out of the passes
    over them: exp(x + bias) is exp(x) times the bias's exponential.
    """
    fast = _Fast(w)
    ends = np.cumsum(n)
    return np.concatenate([np.zeros(0), *(fast.run(shape, flat[(ends[a - 1] if a else 0) : ends[b - 1]], n[a:b]) for a, b in _slices(n, _SLICE))])


class _Fast:
    def __init__(self, w: dict):
        self.w = w
        self.q, self.k, self.v = np.split(w["QKV"], 3, axis=1)
        self.q, self.k, self.v = self.q * np.float32(WIDTH**-0.5), _turned(self.k), _wider(self.v, 1, 1, 1)
        self.since, self.hidden = _since(w), np.concatenate([w["H"], w["h"][None]])
        self.e, self.b, self.o, self.d = _wider(w["E"], 0, 1), _wider(w["B"], 0, 1), _wider(w["O"], 1, 1), _wider(w["D"], 0, 1)
        self.e[:, -1] = 1
        self.last, self.ones = {k: np.concatenate([w[k], w[k.lower()][None]]) for k in w if k[0] in "MC"}, np.ones(max(w[k].size for k in w if k[0] in "mc"), np.float32)

    def run(self, shape: Shape, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        s, out = Stream(shape, flat, n), []
        for at in range(0, s.windows, _WINDOWS):
            count = min(_WINDOWS, s.windows - at)
            h = np.empty((count * STRIDE, WIDTH + 1), np.float32)
            for i in range(at, at + count, _TOGETHER):
                self.layers(s, i, min(_TOGETHER, at + count - i), h[(i - at) * STRIDE :])
            out.append(self.head(shape, h, s.target[(at + 1) * STRIDE : (at + count + 1) * STRIDE]))
        return np.bincount(s.doc, weights=np.concatenate(out)[: s.n], minlength=len(n)) if out else np.zeros(len(n))

    def layers(self, s: Stream, at: int, count: int, out: np.ndarray) -> None:
        span, scored = slice(at * STRIDE, (at + count + 1) * STRIDE), slice((at + 1) * STRIDE, (at + count + 1) * STRIDE)
        x = self.e.take(s.now[span], axis=0)
        x += self.b.take(s.before[span], axis=0)
        q, k, v = _times(x[STRIDE:, :WIDTH], self.q).reshape(count, STRIDE, WIDTH), _across_windows(self.k @ x[:, :WIDTH].T, count, STRIDE), _windowed(_times(x, self.v), count, STRIDE)
        a = _attend(q, k, self.since, s.start[scored].reshape(count, STRIDE), np.arange(at, at + count) * STRIDE)
        o = (a @ v).reshape(-1, WIDTH + 1)
        o /= o[:, WIDTH:].copy()
        h = _times(o, self.o)
        h += x[STRIDE:]
        z = _times(h, self.hidden)
        np.add(h, _times(np.maximum(z, 0, out=z), self.d), out=out[: count * STRIDE])

    def head(self, shape: Shape, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        by = _Order(shape, target)
        h = h.take(by.order, axis=0)
        s = _bounded(_times(h, self.last["C"]))
        found = s.take(np.arange(0, s.size, CLASSES) + by.cls)
        np.exp(s, out=s)
        found -= np.log(s @ self.ones[:CLASSES])
        found[: by.words] += shape.within[by.target[: by.words]]
        s, total, parts = np.empty(by.size, np.float32), np.ones(len(h), np.float32), []
        for k, steps, place in by.classes:
            parts.append(s[place].reshape(-1, shape.sizes[k]))
            np.matmul(h[steps], self.last[f"M{k}"], out=parts[-1])
        own = _bounded(s).take(by.at)
        np.exp(s, out=s)
        for (_, steps, _), part in zip(by.classes, parts):
            np.matmul(part, self.ones[: part.shape[1]], out=total[steps])
        found[by.mine] += own - np.log(total[by.mine])
        found[~by.used] = 0
        out = np.empty_like(found)
        out[by.order] = found
        return out


def _attend(q: np.ndarray, k: np.ndarray, since: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weights, not yet divided by their sums, of each scored step over its window (itself and what is before it in its own text)."""
    a = _bounded(q @ k)
    np.exp(a, out=a)
    a *= since
    cut = np.flatnonzero(start[:, -1] > first)
    if len(cut):
        a[cut] *= (_J32 >= (start[cut] - first[cut, None]).astype(np.int32)[:, :, None]) | _SELF
    return a


def _since(w: dict) -> np.ndarray:
    return np.exp(np.clip(w["R"], -_MOST, _MOST))[_SINCE] * _SEEN.astype(w["R"].dtype)


def _windowed(x: np.ndarray, count: int, apart: int) -> np.ndarray:
    """Windows, ``apart`` rows from each other, over rows."""
    return np.lib.stride_tricks.as_strided(x, (count, WINDOW, x.shape[1]), (x.strides[0] * apart, *x.strides))


def _across_windows(x: np.ndarray, count: int, apart: int) -> np.ndarray:
    """Windows, ``apart`` columns from each other, over columns."""
    return np.lib.stride_tricks.as_strided(x, (count, len(x), WINDOW), (x.strides[1] * apart, *x.strides))


def _consecutive(windows: np.ndarray) -> bool:
    return bool((windows[1:] - windows[:-1] == 1).all())


def _scored(x: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """What ``x`` has of the scored steps of some windows, a row a window."""
    if _consecutive(windows):
        return x[(windows[0] + 1) * STRIDE : (windows[-1] + 2) * STRIDE].reshape(len(windows), STRIDE)
    return x[((windows + 1) * STRIDE)[:, None] + _J[:STRIDE]]


class _Layers:
    """The layers of some windows of a stream before the last one, and their gradients.

    Of consecutive windows, each step's layers are computed once for both windows that it is in.  A last column of ones goes
    through the layers up to ``mid``, for biases and sums as parts of products.
    """

    def __init__(self, p: dict, s: Stream, windows: np.ndarray, h: np.ndarray):
        first, count = windows * STRIDE, len(windows)
        consecutive = _consecutive(windows)
        self.p, self.count, self.apart = p, count, STRIDE if consecutive else WINDOW
        at = slice(first[0], first[-1] + WINDOW) if consecutive else (first[:, None] + _J).ravel()
        self.now, self.before, start = s.now[at], s.before[at], _scored(s.start, windows)
        x = self.x = p["E"].take(self.now, axis=0)
        x += p["B"].take(self.before, axis=0)
        own = x[STRIDE:] if consecutive else x.reshape(count, WINDOW, -1)[:, STRIDE:].reshape(count * STRIDE, -1)
        self.q, self.k, v = _times(own[:, :WIDTH], p["Q"]).reshape(count, STRIDE, WIDTH), _times(x[:, :WIDTH], p["K"]), _times(x, p["V"])
        self.vt = _across_windows(_turned(v), count, self.apart)
        self.a = _attend(self.q, _across_windows(_turned(self.k), count, self.apart), p["since"], start, first)
        o = self.o = (self.a @ _windowed(v, count, self.apart)).reshape(-1, WIDTH + 1)
        self.total = o[:, WIDTH:].copy()
        o /= self.total
        mid = self.mid = _times(o, p["O"])
        mid += own
        self.r = _times(mid, p["H"])
        np.maximum(self.r, 0, out=self.r)
        np.add(mid, _times(self.r, p["D"]), out=h)

    def back(self, d: np.ndarray, g: dict, since: np.ndarray) -> np.ndarray:
        """The gradients, added to ``g`` and ``since``, and those of ``x``, given those of the last layer."""
        p, count, r = self.p, self.count, self.r
        g["D"] += _across(r, d)
        dz = _times(d, p["Dt"])
        dz *= r > 0
        g["Hh"] += _across(self.mid, dz)
        d = d + _times(dz, p["Ht"])
        g["O"] += _across(self.o, d)[:WIDTH]
        do, dot = np.empty((len(d), WIDTH + 1), d.dtype), _times(d, p["Ot"])
        np.divide(dot, self.total, out=do[:, :WIDTH])  # its last column times that of v's ones takes their mean off
        np.einsum("ij,ij->i", do[:, :WIDTH], self.o[:, :WIDTH], out=do[:, WIDTH])
        np.negative(do[:, WIDTH], out=do[:, WIDTH])
        do = do.reshape(count, STRIDE, WIDTH + 1)
        ds, q, a = do @ self.vt, self.q, self.a
        ds *= a
        since += ds.sum(0)
        dqkv = np.zeros((len(self.x), 3 * WIDTH), d.dtype)
        rows = np.lib.stride_tricks.as_strided(dqkv, (count, WINDOW, 3 * WIDTH), (dqkv.strides[0] * self.apart, *dqkv.strides))
        own, past = rows[:, STRIDE:], rows[:, :STRIDE]
        np.matmul(ds, _windowed(self.k, count, self.apart), out=own[:, :, :WIDTH])
        np.matmul(ds[:, :, STRIDE:].transpose(0, 2, 1), q, out=own[:, :, WIDTH : 2 * WIDTH])
        np.matmul(a[:, :, STRIDE:].transpose(0, 2, 1), do[:, :, :WIDTH], out=own[:, :, 2 * WIDTH :])
        past[:, :, WIDTH : 2 * WIDTH] += ds[:, :, :STRIDE].transpose(0, 2, 1) @ q
        past[:, :, 2 * WIDTH :] += a[:, :, :STRIDE].transpose(0, 2, 1) @ do[:, :, :WIDTH]
        g["QKV"] += _across(self.x[:, :WIDTH], dqkv)
        dx = _times(dqkv, p["QKVt"])
        scored = dx[STRIDE:] if self.apart == STRIDE else dx.reshape(count, WINDOW, WIDTH)[:, STRIDE:]
        scored += d.reshape(scored.shape)
        return dx


def _prepared(w: dict) -> dict:
    """The weights as the layers take them."""
    wq, wk, wv = np.split(w["QKV"], 3, axis=1)
    wq = wq * wq.dtype.type(WIDTH**-0.5)
    p = {"E": _wider(w["E"], 0, 1), "B": _wider(w["B"], 0, 1), "Q": wq, "K": np.ascontiguousarray(wk), "V": _wider(wv, 1, 1, 1), "O": _wider(w["O"], 1, 1), "D": _wider(w["D"], 0, 1), "since": _since(w)}
    p["E"][:, -1] = 1
    return p | {"H": np.concatenate([w["H"], w["h"][None]]), "Ht": _turned(w["H"]), "Dt": _turned(w["D"]), "Ot": _turned(w["O"]), "QKVt": _turned(np.concatenate([wq, wk, wv], axis=1))}


def gradients(w: dict, shape: Shape, s: Stream, windows: np.ndarray) -> tuple[float, dict]:
    """(mean loss over the scored steps of some windows of a stream, its gradients)."""
    p, target = _prepared(w), _scored(s.target, windows).ravel()
    h, of = np.empty((len(target), WIDTH + 1), w["E"].dtype), range(0, len(windows), _TOGETHER)
    parts = [_Layers(p, s, windows[i : i + _TOGETHER], h[i * STRIDE : (i + _TOGETHER) * STRIDE]) for i in of]
    logp, g, d = _head(w, shape, h, target)
    g |= {"D": np.zeros_like(w["D"]), "Hh": np.zeros_like(p["H"]), "O": np.zeros_like(w["O"]), "QKV": np.zeros_like(w["QKV"])}
    since = np.zeros((STRIDE, WINDOW))
    dx = np.concatenate([part.back(d[i * STRIDE : (i + _TOGETHER) * STRIDE], g, since) for i, part in zip(of, parts)])
    both = g.pop("Hh")
    g["QKV"][:, :WIDTH] *= g["QKV"].dtype.type(WIDTH**-0.5)
    g |= {"H": both[:WIDTH], "h": both[WIDTH], "R": np.bincount(_SINCE.ravel(), weights=since.ravel(), minlength=WINDOW)}
    for name, rows in (("E", [part.now for part in parts]), ("B", [part.before for part in parts])):
        rows = np.concatenate(rows).astype(np.uint16)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        begins = np.append(0, np.flatnonzero(rows[1:] != rows[:-1]) + 1)
        g[name] = np.zeros_like(w[name])
        pairs = np.add.reduceat(dx.take(order, axis=0).view(np.complex64 if dx.dtype == np.float32 else np.complex128), begins, axis=0)  # columns two by two
        g[name][rows[begins]] = pairs.view(dx.dtype)
    return float(-logp.sum() / max(1, (target != -2).sum())), g


def fit(shape: Shape, flat: np.ndarray, n: np.ndarray, steps: int = Settings.steps, seed: int = 3) -> tuple[dict, dict, list[float]]:
    """(weights, running squares of their gradients, losses): Adam over windows drawn from some texts."""
    rng = np.random.default_rng(seed)
    w = shape.weights(rng)
    mean, square, losses = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, []
    s = Stream(shape, flat, n)
    for t in range(1, steps + 1 if s.windows else 1):
        loss, g = gradients(w, shape, s, rng.integers(0, s.windows, BATCH))
        losses.append(loss)
        rate = RATE * min(1, t / 50) * (1 - t / (steps + 1))
        for k in g:
            mean[k] = (0.9 * mean[k] + 0.1 * g[k]).astype(np.float32)
            square[k] = (0.99 * square[k] + 0.01 * g[k] ** 2).astype(np.float32)
            w[k] = (w[k] - rate * mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w, square, losses


def further(w: dict, square: dict, shape: Shape, flat: np.ndarray, n: np.ndarray, first: int, share: int = Settings.share, state: dict | None = None) -> int:
    """Trains ``w`` in place on every ``share``-th window from number ``first`` on (1: on all windows); the number of windows.

    Adam goes on from the squares that ``fit`` left; ``state`` is its memory between calls.
    """
    s, state = Stream(shape, flat, n), {} if state is None else state
    windows = np.arange(first % share, s.windows, share)
    if not len(windows):
        return 0
    if not state:
        state |= {"t": 0, "square": np.concatenate([square[k].ravel() for k in w])}
        state["mean"] = np.zeros_like(state["square"])
    joined, ends, mean, square = np.concatenate([w[k].ravel() for k in w]), np.cumsum([w[k].size for k in w]), state["mean"], state["square"]
    views = {k: joined[end - w[k].size : end].reshape(w[k].shape) for k, end in zip(w, ends)}
    step, room = np.empty_like(joined), np.empty_like(joined)
    for at in range(0, len(windows), LATER_BATCH):
        part = windows[at : at + LATER_BATCH]
        step.fill(0)
        state["t"] += 1
        g = gradients(views, shape, s, part)[1]
        for k, end in zip(w, ends):
            if k in g:
                step[end - w[k].size : end] = g[k].ravel()
        mean *= np.float32(0.9)
        mean += np.multiply(step, np.float32(0.1), out=room)
        square *= np.float32(0.99)
        step *= step
        square += np.multiply(step, np.float32(0.01), out=step)
        np.sqrt(square, out=step)
        step += np.float32(1e-8)
        np.divide(mean, step, out=room)
        joined -= np.multiply(room, np.float32(LATER_RATE * len(part) / LATER_BATCH / (1 - 0.9 ** state["t"])), out=room)
    for k in w:
        w[k][...] = views[k]
    return len(windows)


def _dumped(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


# ---- the operator

_BLOCK = {"block": "long", "teaching": "long", "words": "int", "distinct": "int", "pieces": "int", "ids": "binary", "flags": "binary", "sizes": "binary", "at": "binary", "piece": "binary", "lens": "binary", "hashes": "binary", "n": "binary"}
_DDL = ", ".join(f"{k} {v}" for k, v in _BLOCK.items())
_SCHEMA = pa.schema([(k, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[v]) for k, v in _BLOCK.items()])
_TEACHES, _HELD, _NO_ID = 1, 2, 4


class _Row:
    """A block as it is kept: arrays are unpacked when they are asked for."""

    def __init__(self, row: dict):
        self.row = row
        self.docs = len(row["flags"])
        self.flags = np.frombuffer(row["flags"], np.uint8)

    def sizes(self) -> np.ndarray:
        return _swollen(self.row["sizes"], "<u4", self.docs)

    def at(self) -> np.ndarray:
        return _swollen(self.row["at"], "<u4", self.row["words"])

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        return _swollen(self.row["piece"], "<u2", self.row["pieces"]), _swollen(self.row["lens"], "<u4", self.row["distinct"])

    def hashes(self) -> np.ndarray:
        return np.frombuffer(self.row["hashes"], "<i8")

    def n(self) -> np.ndarray:
        return _swollen(self.row["n"], "<u4", self.row["distinct"])

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        return sequences(self.at(), self.sizes(), *self.pieces())

    def taught(self) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of the texts that teach."""
        flat, n = self.sequences()
        teaches = self.flags & _TEACHES > 0
        return flat[teaches[doc_of(n)]], n[teaches]


def _packed(docs: DataFrame, path: str, folds: int, held: int, size: int) -> DataFrame:
    """Rows of about ``size`` characters of ``docs``, split, numbered and cut into subwords; made where texts are read."""
    fold = crc_fold(F.col("doc_id").cast("long"), folds)
    flags = F.when(fold != held, _TEACHES).when(fold == held, _HELD).otherwise(_NO_ID)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flags.cast("tinyint").alias("flags"))

    def packed(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        block = Block(whole.column("text").combine_chunks() if whole.column("text").num_chunks != 1 else whole.column("text").chunk(0))
        flags = whole.column("flags").to_numpy().astype(np.uint8)
        ids, lens = block.subwords(path)
        teaches = (flags & _TEACHES > 0)[doc_of(block.sizes)]
        n = np.bincount(block.at[teaches], minlength=len(block.words))
        row = {"block": number, "teaching": int((flags & _TEACHES > 0).sum()), "words": len(block.at), "distinct": len(block.words), "pieces": len(ids), "ids": pc.fill_null(whole.column("doc_id"), 0).to_numpy().astype("<i8").tobytes(), "flags": flags.tobytes()}
        row |= {"sizes": _squeezed(block.sizes.astype("<u4")), "at": _squeezed(block.at.astype("<u4")), "piece": _squeezed(ids.astype("<u2")), "lens": _squeezed(lens.astype("<u4")), "hashes": block.hashes.tobytes(), "n": _squeezed(n.astype("<u4"))}
        return pa.RecordBatch.from_pylist([row], _SCHEMA)

    def blocks(it):
        number, held_back, chars = TaskContext.get().partitionId() << 32, [], 0
        for batch in it:
            lengths, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                till = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size - chars)))
                held_back.append(batch.slice(at, till - at))
                chars += int(lengths[min(till, batch.num_rows) - 1] - (lengths[at - 1] if at else 0))
                at = till
                if chars >= size:
                    yield packed(number, held_back)
                    number, held_back, chars = number + 1, [], 0
        if held_back:
            yield packed(number, held_back)

    return saved(table.mapInArrow(blocks, _DDL), "blocks")


def _word_counts(blocks: DataFrame) -> DataFrame:
    """``(block, i, h, n)``: the distinct words of each block, numbered."""

    def words(it):
        for batch in it:
            for row in map(_Row, batch.to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(row.row["distinct"], row.row["block"])), pa.array(np.arange(row.row["distinct"], dtype=np.int32)), pa.array(row.hashes()), pa.array(row.n())], ["block", "i", "h", "n"])

    return blocks.select("block", "distinct", "flags", "hashes", "n").mapInArrow(words, "block long, i int, h long, n long")


def _totals(words: DataFrame) -> DataFrame:
    """``(h, c, known)`` of words that several blocks have: their counts; and a row a task without ``h`` for all the others.

    ``c`` sums to all words that teach, ``known`` to how many distinct ones there are.
    """

    def condensed(batches):
        c = known = 0
        for batch in batches:
            several, n = batch.column(2).to_numpy() > 1, batch.column(1).to_numpy()
            c, known = c + int(n[~several].sum()), known + int((n[~several] > 0).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(several)), pa.array(n[several]), pa.array((n[several] > 0).astype(np.int64))], ["h", "c", "known"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([c], pa.int64()), pa.array([known], pa.int64())], ["h", "c", "known"])

    return words.groupBy("h").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")).mapInArrow(condensed, "h long, c long, known long")


def _subword_counts(blocks: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each subword of the vocabulary stands in the texts that teach."""

    def count(it):
        total = np.zeros(vocabulary, np.int64)
        for batch in it:
            for row in map(_Row, batch.to_pylist()):
                ids, lens = row.pieces()
                total += np.bincount(ids, weights=np.repeat(row.n(), lens), minlength=vocabulary).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["subword", "n"])

    found = blocks.select("flags", "distinct", "pieces", "piece", "lens", "n").mapInArrow(count, "subword long, n long").groupBy("subword").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    out = np.zeros(vocabulary)
    out[found.column("subword").to_numpy()] = found.column("n").to_numpy()
    return out


def _started(blocks: DataFrame, counts: np.ndarray, docs: int, path: str, how: Settings) -> tuple[Shape, dict, dict]:
    """Shape and first weights, fitted in one task to a bounded sample of the texts that teach."""
    share = min(1.0, how.start / max(1, int(counts.sum())))

    def pick(it):
        for batch in it:
            for row in map(_Row, batch.to_pylist()):
                ids = np.frombuffer(row.row["ids"], "<i8").astype(np.uint64)
                flat, n = row.sequences()
                chance = (ids * np.uint64(0x9E3779B97F4A7C15) ^ n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x94D049BB133111EB) >> np.uint64(11)
                mine = (row.flags & _TEACHES > 0) & (chance < share * 2.0**53) & (n <= how.start)
                ends = np.cumsum(n)
                for d in np.flatnonzero(mine):
                    yield pa.RecordBatch.from_arrays([pa.array([int(chance[d])]), pa.array([flat[ends[d] - n[d] : ends[d]].astype("<u2").tobytes()])], ["chance", "ids"])

    def start(it):
        rows = sorted((r for batch in it for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        texts, held = [], 0
        for _, raw in rows:
            if held + len(raw) // 2 <= 1.2 * how.start:
                texts.append(np.frombuffer(raw, "<u2").astype(np.int64))
                held += len(texts[-1])
        flat, n = np.concatenate([np.zeros(0, np.int64), *texts]), np.array([len(x) for x in texts], np.int64)
        classes = _classes(flat, n, len(counts), _starts(path), np.random.default_rng(3))
        w, square, _ = fit(Shape(classes, counts, docs), flat, n, how.steps)
        yield pa.RecordBatch.from_arrays([pa.array([classes.astype("<i8").tobytes()]), pa.array([_dumped(w)]), pa.array([_dumped(square)])], ["classes", "weights", "squares"])

    texts = blocks.select("ids", "flags", "sizes", "words", "distinct", "pieces", "at", "piece", "lens").mapInArrow(pick, "chance long, ids binary")
    got = saved(texts.repartition(1).mapInArrow(start, "classes binary, weights binary, squares binary"), "start").first()
    if got is None:
        classes = np.where(_starts(path), CLASSES - 2, CLASSES - 3)
        w, square, _ = fit(Shape(classes, counts, docs), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return Shape(classes, counts, docs), w, square
    classes, w, square = np.frombuffer(got["classes"], "<i8"), *(dict(np.load(io.BytesIO(got[k]))) for k in ("weights", "squares"))
    return Shape(classes, counts, docs), w, square


def _trained(blocks: DataFrame, shape: Shape, w: dict, square: dict, how: Settings) -> dict:
    """The weights after all blocks have trained them: each task trains a copy, copies are averaged by their windows."""
    shared, names = blocks.sparkSession.sparkContext.broadcast((shape, w, square)), list(w)  # bounded by the vocabulary

    def train(it):
        shape, first, square = shared.value
        w, windows, state = {k: v.copy() for k, v in first.items()}, 0, {}
        for batch in it:
            for row in map(_Row, batch.to_pylist()):
                flat, n = row.taught()
                if len(n):
                    windows += further(w, square, shape, flat, n, row.row["block"], how.share, state)
        if windows:
            moved = np.concatenate([(w[k] - first[k]).ravel() for k in names]).astype(np.float64) * windows
            hit = np.append(np.flatnonzero(moved), len(moved))
            values = np.append(moved, windows)[hit]
            for at in range(0, len(hit), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(hit[at : at + (1 << 16)].astype(np.int32)), pa.array(values[at : at + (1 << 16)])], ["slot", "v"])

    sums = blocks.mapInArrow(train, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()  # one row a weight at most
    size = sum(v.size for v in w.values())
    total = np.zeros(size + 1)
    total[sums.column("slot").to_numpy()] = sums.column("v").to_numpy()
    moved, at, out = total[:-1] / max(1.0, total[-1]), 0, {}
    for k in names:
        out[k] = (w[k] + moved[at : at + w[k].size].reshape(w[k].shape)).astype(np.float32)
        at += w[k].size
    return out


_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, path: str = RANKS, folds: int = FOLDS, held: int = HELD, how: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every whole text.

    Learns from rows whose crc32(doc_id) modulo ``folds`` is not ``held``.  Tokens are words (A-Z lower-cased) and an end;
    ``base_score`` is their add-one unigram log10 probability from counts over all training rows.  ``score`` is the log10
    probability that the attention model gives the words' subwords and the end: P(class) P(subword | class), both softmaxes
    of its last layer; subwords that are not frequent share one member of their class by their counts.

    * NULL text is empty: one token, the end.  NULL doc_id: neither learned from nor held out.
    * Repeated rows count and score one by one.  Empty table: no rows.  Other columns are ignored.
    * Very long texts are whole: a text lies in one block, however long, and is scored window by window.

    Texts are read once, where they lie, into packed blocks of about ``how.block`` characters; later passes read those.  A block
    sends each distinct word once, as a 64-bit hash with its count, and gets back totals of those words that other
    blocks have, too, so no task sees a common word more than once per block.  Training is a start in one task on a bounded
    sample, then one pass in which every task trains a copy on all windows of all its blocks and copies are averaged.
    """
    spark, vocabulary = docs.sparkSession, _subwords(path)[1]
    blocks = _packed(docs, path, folds, held, how.block)
    words = _word_counts(blocks)
    totals = saved(_totals(words), "totals")
    spoken, distinct = totals.agg(F.sum("c"), F.sum("known")).first()
    n_train = blocks.agg(F.sum("teaching")).first()[0] or 0
    train_tokens, distinct = (spoken or 0) + n_train, (distinct or 0) + bool(n_train)
    counts = _subword_counts(blocks, vocabulary)
    shape, w, square = _started(blocks, counts, n_train, path, how)
    known = spark.sparkContext.broadcast((shape, _trained(blocks, shape, w, square, how)))
    base = float(train_tokens + distinct + 1)

    def judged(t: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for row in map(_Row, t.to_pylist()):
            n, size, sizes, at = row.n(), row.docs, row.sizes(), row.at()
            n[back.column("i").to_numpy()] = back.column("c").to_numpy()
            doc = doc_of(sizes)
            unigram = np.bincount(doc, weights=np.log10((n + 1) / base)[at], minlength=size) + np.log10((n_train + 1) / base)
            seen = np.bincount(doc, weights=(n > 0)[at], minlength=size).astype(np.int64) + bool(n_train)
            ids, lens = row.pieces()
            logp = scores(known.value[1], known.value[0], *sequences(at, sizes, ids.astype(np.int32), lens))
            del n, doc, at
            ids = pa.array(np.frombuffer(row.row["ids"], "<i8"), mask=row.flags & _NO_ID > 0)
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(row.flags & _HELD > 0), pa.array(sizes + 1), pa.array(seen), pa.array(np.full(size, train_tokens, np.int64)), pa.array(unigram), pa.array(logp / np.log(10))], schema=_RESULT))
        return pa.Table.from_batches(out, _RESULT)

    # a word that no other block has is known there already
    back = words.select("block", "i", "h").join(totals.where("h is not null").select("h", "c"), "h").select("block", "i", "c")
    return blocks.drop("hashes").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(judged, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
