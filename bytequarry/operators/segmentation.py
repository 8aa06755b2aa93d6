"""Segmentation of blobs and discovery of structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders

#: Window of the entropy signal, side of the confirmations, and thresholds.
SIGNAL, SIDE, LEAST_KL, LEAST_CHI, DEPTH = 256, 512, 0.1, 300.0, 20
MIN_REGION, MAX_REGIONS, SHARPEN_BYTES = 256, 500, 50 << 20
SMALL_BYTES = 4096
_CUT = pa.list_(pa.int64())


def _segments(signal: np.ndarray, threshold: float) -> list[int]:
    """Places of change: the largest |cumulative deviation from the mean| of a part, while above the threshold."""
    found, todo = [], [(0, len(signal), DEPTH)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth <= 0:
            continue
        part = signal[a:b]
        walk = np.abs(np.cumsum(part - part.mean()))
        at = a + int(walk.argmax())
        if walk.max() > threshold:
            found.append(at)
            todo += [(a, at, depth - 1), (at, b, depth - 1)]
    return sorted(found)


def _kl(p: np.ndarray, q: np.ndarray) -> float:
    p, q = (p + 1.0) / (p.sum() + 256), (q + 1.0) / (q.sum() + 256)
    return float((p * np.log(p / q)).sum())


def _chi(a: np.ndarray, b: np.ndarray) -> float:
    n, m, both = a.sum(), b.sum(), a + b
    seen = both > 0
    return float((((a / n - b / m) ** 2)[seen] / (both[seen] / (n + m))).sum() * n * m / (n + m)) if n and m else 0.0


def _sharpen(v: np.ndarray, rough: int) -> int:
    """The place within 128 bytes where the entropies of the 64 bytes before and after differ most."""
    best, where = 0.0, rough
    places = np.arange(max(16, rough - 128), min(len(v), rough + 128) - 64)
    if not len(places):
        return where
    low = max(0, int(places[0]) - 64)
    part = v[low : int(places[-1]) + 64]
    upto = np.zeros((len(part) + 1, 256), np.int32)
    upto[np.arange(1, len(part) + 1), part] = 1
    np.cumsum(upto, 0, out=upto)
    at = places - low
    left = kernels.entropy_of(upto[at] - upto[np.maximum(at - 64, 0)])
    right = kernels.entropy_of(upto[at + 64] - upto[at])
    slopes = np.abs(right - left)
    top = int(slopes.argmax())
    return int(places[top]) if slopes[top] > best else where


def boundaries_of(v: np.ndarray) -> list[int]:
    """Offsets of changes in the statistics of a blob of at least SMALL_BYTES."""
    edges = np.arange(0, len(v), SIGNAL)
    signal = np.array([float(kernels.entropy_of(kernels.histogram_of(v[a : a + SIGNAL]))) for a in edges])
    out = []
    for index in _segments(signal, 2 * np.sqrt(len(signal))):
        at = index * SIGNAL
        if at < SIDE or at >= len(v) - SIDE:
            continue
        left, right = kernels.histogram_of(v[at - SIDE : at]), kernels.histogram_of(v[at : at + SIDE])
        if _kl(left, right) >= LEAST_KL and _chi(left, right) > LEAST_CHI:
            out.append(_sharpen(v, at) if len(v) <= SHARPEN_BYTES else at)
    kept = [0]
    for at in sorted({*out, len(v)}):
        if at - kept[-1] >= MIN_REGION:
            kept.append(at)
    if kept[-1] != len(v):
        kept.append(len(v))
    while len(kept) - 1 > MAX_REGIONS:
        sizes = np.diff(kept)[1:]
        kept.pop(1 + int(sizes.argmin()))
    return kept


@kernels.kernel(kernels.SPANS)
def boundary_regions(blobs: pa.Array) -> pa.Array:
    """Regions between the boundaries; smaller blobs are one region."""

    def cut(v):
        if not len(v):
            return []
        edges = np.array(boundaries_of(v) if len(v) >= SMALL_BYTES else [0, len(v)])
        return kernels._windows(v, edges[:-1], edges[1:])

    return kernels.span_lists(blobs, cut)


def boundaries(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    rows = blobs.select(id_col, F.explode(boundary_regions(data_col)).alias("s")).select(id_col, "s.*")
    return rows.withColumn("class", ladders.classify_region(F.round("entropy", 6)))


def cusum_peak(samples: DataFrame, value: str = "entropy", id_col: str = "blob_id") -> DataFrame:
    """id, offset, peak: where the running sum of deviations from the blob's mean is largest in size, first among equals.

    Values count in millionths. Sums are of whole numbers (n times the running
    sum less k times the total), so ties are ties whatever the order of addition.
    """
    whole = Window.partitionBy(id_col)
    run = whole.orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("__v", F.round(F.col(value) * 1_000_000).cast("decimal(20,0)"))
    walk = F.abs(F.sum("__v").over(run) * F.count("*").over(whole) - F.sum("__v").over(whole) * F.count("*").over(run))
    rows = rows.withColumn("__walk", walk.cast("decimal(38,0)")).withColumn("__n", F.count("*").over(whole))
    rows = rows.groupBy(id_col).agg(F.max(F.struct("__walk", (-F.col("offset")).alias("o"), "__n")).alias("b"))
    return rows.select(id_col, (-F.col("b.o")).alias("offset"), (F.col("b.__walk").cast("double") / F.col("b.__n") / 1e6).alias("peak"))


def _repeats(v: np.ndarray, lengths: tuple[int, int], least: int, top: int) -> list[dict]:
    """Repeated byte strings of one blob, by number of places, then longer ones first, then by bytes."""
    v = np.ascontiguousarray(v)
    rank = v.astype(np.int64)  # of the string of each place, among those of its length
    found: list[tuple[int, int, bytes]] = []
    for length in range(2, min(lengths[1], len(v) // least) + 1):
        pair = rank[:-1] << 8 | v[length - 1 :]  # the string's rank and its next byte
        _, first, rank, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        if not (count >= least).any():
            break  # nor does any longer string
        if length >= lengths[0]:
            for at, n in zip(first[count >= least].tolist(), count[count >= least].tolist()):
                pattern = v[at : at + length].tobytes()
                if pattern.count(pattern[0]) < length:
                    found.append((-n, -length, pattern))
    kept: list[bytes] = []
    out = []
    for n, length, pattern in sorted(found):
        if not any(len(k) > -length and pattern in k for k in kept):
            kept.append(pattern)
            out.append({"pattern": pattern.hex().upper(), "n": -n})
            if len(out) == top:
                break
    return out


def repeated_patterns(blobs: DataFrame, lengths: tuple[int, int] = (4, 64), least: int = 3, top: int = 100, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, pattern (hex), n: byte strings of these lengths that occur at least ``least`` times (places may overlap).

    Whole blobs count. Strings of one byte value, and those within a longer one
    that comes before them (more places first, then longer), are left out; the
    first ``top`` of a blob are reported.
    """
    kind = pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())]))

    @kernels.kernel(kind)
    def count(blobs: pa.Array) -> pa.Array:
        return kernels.each(blobs, lambda v: _repeats(v, lengths, least, top), kind)

    return blobs.select(id_col, F.explode(count(data_col)).alias("x")).select(id_col, "x.pattern", "x.n")


# Alignments that are looked for, and those that get a bonus.
ALIGNMENTS, COMMON_ALIGNMENTS, ALIGNMENT_BONUS = (4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096), (4, 8, 16, 512, 4096), 0.05


def alignment(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, alignment, confidence, padded, total: multiples of an alignment that zero bytes lead up to.

    A boundary is padded if one of the four bytes before it is zero and its own is
    not, or if two of them are. Alignments with two padded boundaries and more
    than a twentieth of all count. Whole blobs of 16 bytes or more are read.
    """
    kind = pa.list_(pa.struct([("alignment", pa.int32()), ("padded", pa.int64()), ("total", pa.int64())]))

    @kernels.kernel(kind)
    def count(blobs: pa.Array) -> pa.Array:
        def one(v):
            zero = np.concatenate([np.zeros(4, np.int8), v == 0])
            before = zero[3:-1] + zero[2:-2] + zero[1:-3] + zero[:-4] if len(v) >= 16 else np.empty(0, np.int8)
            out = []
            for step in ALIGNMENTS:
                near, own = before[step::step], v[step::step]
                if len(near):
                    out.append({"alignment": step, "padded": int((((near >= 1) & (own != 0)) | (near >= 2)).sum()), "total": len(near)})
            return out

        return kernels.each(blobs, one, kind)

    rows = blobs.select(id_col, F.explode(count(data_col)).alias("x")).select(id_col, "x.*")
    share = F.col("padded") / F.col("total")
    bonus = F.when(F.col("alignment").isin(*COMMON_ALIGNMENTS), ALIGNMENT_BONUS).otherwise(0.0)
    return rows.where((F.col("padded") >= 2) & (share > 0.05)).withColumn("confidence", F.least(F.lit(1.0), share + bonus))


def field_length(blobs: DataFrame, lags: tuple[int, int] = (4, 4096), least: float = 0.02, top: int = 50, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, lag, confidence: record lengths at which bytes repeat more than chance, multiples of better ones left out.

    All bytes count; a length fits three times at least, bytes agree in more than
    3 of 256 places and the confidence is ``least`` or more.
    """
    kind = pa.list_(pa.struct([("lag", pa.int32()), ("confidence", pa.float64())]))

    @kernels.kernel(kind)
    def measure(blobs: pa.Array) -> pa.Array:
        def one(v):
            found = []
            for lag in range(lags[0], min(lags[1], len(v) // 3) + 1):
                share = np.count_nonzero(v[lag:] == v[:-lag]) / (len(v) - lag)
                confidence = (share - 1 / 256) / (1 - 1 / 256)
                if share > 3 / 256 and confidence >= least:
                    found.append((confidence, lag))
            kept: list[tuple[float, int]] = []
            for confidence, lag in sorted(found, key=lambda x: (-x[0], x[1])):
                if not any(lag % other == 0 for _, other in kept):
                    kept.append((confidence, lag))
            return [{"lag": lag, "confidence": c} for c, lag in kept[:top]]

        return kernels.each(blobs, one, kind)

    return blobs.select(id_col, F.explode(measure(data_col)).alias("x")).select(id_col, "x.lag", "x.confidence")
