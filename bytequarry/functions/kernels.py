"""Arrow kernels over binary columns.

Bytes are never exploded into rows: each kernel reads a whole Arrow batch of
blobs and gives one value a blob (a histogram, a sum, an array of windows), from
which the DataFrame operators go on with built-in expressions. Null blobs give
null; every kernel is a function of its blob alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from bytequarry.functions import ladders

#: Windows of a blob that are counted at a time (2 KiB each).
WINDOWS = 8192

SPAN = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("entropy", pa.float64()), ("chi_square", pa.float64()), ("mean", pa.float64())])
SPANS = pa.list_(SPAN)
TILES = pa.list_(
    pa.struct([("tile", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("entropy", pa.float64()), ("zero_share", pa.float64()), ("ascii_share", pa.float64()), ("top_byte", pa.int32())])
)
NGRAMS = pa.struct([(n, pa.int64()) for n in ("bigrams", "trigrams", "quadgrams")])


def kernel(kind: pa.DataType):
    """Makes a column function of a function over Arrow arrays; ``kind`` is what it returns."""
    return arrow_udf(returnType=from_arrow_type(kind))


def views(blobs: pa.Array) -> Iterator[np.ndarray | None]:
    """The bytes of each blob without a copy."""
    for blob in blobs:
        data = blob.as_buffer()
        yield None if data is None else np.frombuffer(data, np.uint8)


def each(blobs: pa.Array, function: Callable, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else function(v) for v in views(blobs)], kind)


def histogram_of(v: np.ndarray) -> np.ndarray:
    return np.bincount(v, minlength=256)


def entropy_of(counts: np.ndarray) -> np.ndarray:
    """Bits a byte of each histogram (last axis); 0 for an empty one."""
    counts = np.asarray(counts, np.float64)
    total = counts.sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / total
        bits = np.where(counts > 0, -p * np.log2(p), 0.0)
    return bits.sum(-1)


@kernel(pa.list_(pa.int64()))
def byte_counts(blobs: pa.Array) -> pa.Array:
    """256 counts by byte value."""
    return each(blobs, lambda v: histogram_of(v).tolist(), pa.list_(pa.int64()))


def _serial(v: np.ndarray) -> float:
    if len(v) < 2:
        return 0.0
    a = v.astype(np.float64) - v.mean()
    spread = float((a * a).sum())
    return float((a * np.roll(a, -1)).sum() / spread) if spread > 0 else 0.0


@kernel(pa.float64())
def serial_correlation(blobs: pa.Array) -> pa.Array:
    """Correlation of neighbouring bytes, the last with the first; 0 for fewer than two bytes or equal ones."""
    return each(blobs, _serial, pa.float64())


def _pi(v: np.ndarray) -> float:
    if len(v) < 6:
        return 0.0
    pairs = len(v) // 2
    at = v[: 2 * pairs].reshape(-1, 2).astype(np.float64) - 127.5
    return float(4 * ((at * at).sum(1) <= 127.5**2).sum() / pairs)


@kernel(pa.float64())
def monte_carlo_pi(blobs: pa.Array) -> pa.Array:
    """Four times the share of byte pairs inside the circle; 0 for fewer than six bytes."""
    return each(blobs, _pi, pa.float64())


def _ngrams(v: np.ndarray) -> dict[str, int]:
    v = v.astype(np.int64)
    out, code = {}, v
    for n, name in ((2, "bigrams"), (3, "trigrams"), (4, "quadgrams")):
        code = code[:-1] << 8 | v[n - 1 :] if len(v) >= n else np.empty(0, np.int64)
        out[name] = len(np.unique(code))
    return out


@kernel(NGRAMS)
def ngram_counts(blobs: pa.Array) -> pa.Array:
    """Distinct 2-, 3- and 4-byte sequences of whole blobs."""
    return each(blobs, _ngrams, NGRAMS)


@kernel(pa.int64())
def run_count(blobs: pa.Array) -> pa.Array:
    """Runs of equal bytes."""
    return each(blobs, lambda v: int((v[1:] != v[:-1]).sum()) + 1 if len(v) else 0, pa.int64())


def _facts(starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Offset, length, entropy, chi-square and mean of spans by their histograms; empty spans have zeros."""
    counts, n = counts.astype(np.float64), np.maximum(lengths, 1)
    chi = np.where(lengths > 0, 256 / n * (counts * counts).sum(1) - lengths, 0.0)
    return starts, lengths, entropy_of(counts), chi, counts @ np.arange(256.0) / n


def _no_facts() -> tuple[np.ndarray, ...]:
    return np.empty(0, np.int64), np.empty(0, np.int64), *(np.empty(0) for _ in range(3))


def span_lists(blobs: pa.Array, cut: Callable[[np.ndarray], list[tuple[np.ndarray, ...]]]) -> pa.Array:
    """One list of spans a blob; ``cut`` gives a blob's facts in parts."""
    parts, sizes, null = [_no_facts()], [0], []
    for v in views(blobs):
        found = [] if v is None else cut(v)
        parts += found
        sizes.append(sum(len(p[0]) for p in found))
        null.append(v is None)
    columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), (f.type for f in SPAN))]
    spans = pa.StructArray.from_arrays(columns, fields=list(SPAN))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), spans, mask=pa.array(null, pa.bool_()))


def _blocks(v: np.ndarray, width: int) -> np.ndarray:
    """Histograms of blocks of ``width`` bytes side by side, the last one maybe shorter."""
    count = -(-len(v) // width)
    key = np.repeat(np.arange(0, 256 * count, 256), width)[: len(v)] + v
    return np.bincount(key, minlength=256 * count).reshape(count, 256)


def _tumbling(v: np.ndarray, window: int, keep_tail: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, lengths and histograms of adjacent windows, some at a time."""
    size = len(v) if keep_tail else len(v) // window * window
    for at in range(0, size, WINDOWS * window):
        part = v[at : min(size, at + WINDOWS * window)]
        starts = at + np.arange(0, len(part), window)
        yield starts, np.minimum(window, size - starts), _blocks(part, window)


def tumbling(window: int, keep_tail: bool = True):
    """A column function: spans of ``window`` bytes, with the shorter last one unless told otherwise."""

    @kernel(SPANS)
    def spans(blobs: pa.Array) -> pa.Array:
        return span_lists(blobs, lambda v: [_facts(*x) for x in _tumbling(v, window, keep_tail)])

    return spans


def _sliding(v: np.ndarray, window: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, lengths and histograms of full windows: sums of blocks that all windows are made of."""
    if len(v) <= window:
        if len(v):
            yield np.array([0]), np.array([len(v)]), _blocks(v, len(v))
        return
    unit, total = math.gcd(window, step), (len(v) - window) // step + 1
    many = max(1, (4 * WINDOWS - window // unit) * unit // step)  # windows whose blocks are held at a time
    for first in range(0, total, many):
        starts = np.arange(first, min(total, first + many)) * step
        blocks = _blocks(v[starts[0] : starts[-1] + window], unit)
        upto = np.concatenate([np.zeros((1, 256), np.int64), np.cumsum(blocks, 0)])
        at = (starts - starts[0]) // unit
        yield starts, np.full(len(starts), window), upto[at + window // unit] - upto[at]


def sliding(window: int, step: int):
    """A column function: full spans of ``window`` bytes every ``step``; a blob no longer than one has one."""

    @kernel(SPANS)
    def spans(blobs: pa.Array) -> pa.Array:
        return span_lists(blobs, lambda v: [_facts(*x) for x in _sliding(v, window, step)])

    return spans


def _merged(v: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, length, histogram) of the runs of adjacent windows of one region class."""
    cuts = np.array([cut for cut, _ in ladders.REGION[0]])
    held = None
    for starts, lengths, counts in _tumbling(v, window):
        kind = np.searchsorted(cuts, np.round(entropy_of(counts), 6), "right")
        new = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        for c, start, length, histogram in zip(kind[new].tolist(), starts[new].tolist(), np.add.reduceat(lengths, new).tolist(), np.add.reduceat(counts, new, axis=0)):
            if held and held[0] == c:
                held = c, held[1], held[2] + length, held[3] + histogram
            else:
                if held:
                    yield held[1:]
                held = c, start, length, histogram
    if held:
        yield held[1:]


def merged_regions(window: int):
    """A column function: adjacent windows of one region class as one span, with the facts of its own bytes."""

    @kernel(SPANS)
    def spans(blobs: pa.Array) -> pa.Array:
        def cut(v):
            runs = list(_merged(v, window))
            return [_facts(np.array([r[0] for r in part]), np.array([r[1] for r in part]), np.stack([r[2] for r in part])) for part in (runs[i : i + WINDOWS] for i in range(0, len(runs), WINDOWS))]

        return span_lists(blobs, cut)

    return spans


def deltas(distance: int):
    """A column function: each byte less the one ``distance`` before it (0 before the start), modulo 256."""

    @kernel(pa.list_(pa.int32()))
    def values(blobs: pa.Array) -> pa.Array:
        def one(v):
            v = v.astype(np.int32)
            return (v - np.concatenate([np.zeros(distance, np.int32), v])[: len(v)]) % 256

        return each(blobs, one, pa.list_(pa.int32()))

    return values


PLACES = pa.list_(pa.struct([("offset", pa.int64()), ("which", pa.int32())]))
MATCHES = pa.list_(pa.struct([("offset", pa.int64()), ("value", pa.string())]))


def _lists(sizes: list[int], null: list[bool], names: Sequence[str], columns: list[pa.Array]) -> pa.Array:
    values = pa.StructArray.from_arrays(columns, list(names))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values, mask=pa.array(null, pa.bool_()))


def word_places(words: Sequence[bytes]):
    """A column function: offset and number of the word of each place of each of the words, those of one word not overlapping."""

    @kernel(PLACES)
    def places(blobs: pa.Array) -> pa.Array:
        patterns = [re.compile(re.escape(w)) for w in words]
        offsets, which, sizes, null = [], [], [], []
        for blob in blobs:
            data, before = blob.as_py(), len(offsets)
            for i, pattern in enumerate(patterns):
                found = [m.start() for m in pattern.finditer(data or b"")]
                offsets += found
                which += [i] * len(found)
            sizes.append(len(offsets) - before)
            null.append(data is None)
        return _lists(sizes, null, ("offset", "which"), [pa.array(offsets, pa.int64()), pa.array(which, pa.int32())])

    return places


def pattern_matches(pattern: str):
    """A column function: offset and bytes (as Latin-1 characters) of the matches of a regular expression over the bytes, from left to right."""

    @kernel(MATCHES)
    def matches(blobs: pa.Array) -> pa.Array:
        compiled = re.compile(pattern.encode("latin-1"))
        offsets, values, sizes, null = [], [], [], []
        for blob in blobs:
            data, before = blob.as_py(), len(offsets)
            for m in compiled.finditer(data or b""):
                offsets.append(m.start())
                values.append(m[0].decode("latin-1"))
            sizes.append(len(offsets) - before)
            null.append(data is None)
        return _lists(sizes, null, ("offset", "value"), [pa.array(offsets, pa.int64()), pa.array(values, pa.string())])

    return matches


def _windows(v: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Facts of any spans of one blob."""
    out = []
    for i in range(0, len(starts), WINDOWS):
        part = slice(i, i + WINDOWS)
        out.append(_facts(starts[part], ends[part] - starts[part], np.stack([histogram_of(v[a:b]) for a, b in zip(starts[part], ends[part])])))
    return out


@kernel(SPANS)
def spans_of(blobs: pa.Array, offsets: pa.Array, lengths: pa.Array) -> pa.Array:
    """The same facts for stated spans of each blob; null spans have none."""
    stated = iter(zip(offsets.to_pylist(), lengths.to_pylist()))

    def cut(v):
        starts, sizes = next(stated)
        a = np.array(starts or [], np.int64)
        return _windows(v, a, a + np.array(sizes or [], np.int64))

    known = blobs.is_valid()
    if not all(known.to_pylist()):
        stated = iter([x for x, k in zip(stated, known.to_pylist()) if k])
    return span_lists(blobs, cut)


@kernel(TILES)
def grid_of_256(blobs: pa.Array) -> pa.Array:
    """256 tiles a blob, the remainder spread over the first ones, each read up to 64 KiB; empty tiles are left out."""
    def cut(v):
        size, extra = divmod(len(v), 256)
        out, at = [], 0
        for tile in range(256):
            length = size + (tile < extra)
            if length:
                part = histogram_of(v[at : at + min(length, 65536)])
                n = int(part.sum())
                out.append(
                    {"tile": tile, "offset": at, "length": length, "entropy": float(entropy_of(part)), "zero_share": part[0] / n, "ascii_share": float(part[32:127].sum() / n), "top_byte": int(part.argmax())}
                )
            at += length
        return out

    return each(blobs, cut, TILES)
