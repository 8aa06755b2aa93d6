"""Fingerprints: which kind of coding a blob looks like.

Every rule is an expression over the histogram, a few header bytes and a few
sums; the result is a row for each rule that fires, with its confidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders
from bytequarry.operators import bytestats

_FACTS = pa.struct([("pairs_low", pa.int64()), ("odd_values", pa.int64()), ("flags9", pa.float64()), ("flags17", pa.float64()), ("table", pa.float64()), ("lengths", pa.int64()), ("lzw_valid", pa.int64()), ("lzw_total", pa.int64())])
# Fixed values in the rules below: least sizes, thresholds, steps and caps of confidences.
#: LZW codes that are looked at, and codes with a meaning of their own.
LZW_CODES = 100
_CLEAR, _END = 256, 257


def _flag_share(v: np.ndarray, stride: int) -> float:
    """Share of bytes at every ``stride`` (while a whole stride follows) with 2 to 6 bits set; 0 for fewer than three."""
    at = v[: max(0, len(v) - stride) : stride]
    bits = np.bitwise_count(at)
    return float(((bits >= 2) & (bits <= 6)).mean()) if len(at) >= 3 else 0.0


def _lzw(v: np.ndarray) -> tuple[int, int]:
    """(valid, all) codes of a stream of variable-width codes, lowest bit first."""
    stream = int.from_bytes(v[: LZW_CODES * 12 // 8 + 2].tobytes(), "little")
    at, width, following, valid, total = 0, 9, 258, 0, 0
    while total < LZW_CODES and at + width <= 8 * len(v):
        code = stream >> at & (1 << width) - 1
        at, total = at + width, total + 1
        if code > following:
            break
        valid += 1
        if code == _END:
            break
        if code == _CLEAR:
            width, following = 9, 258
        elif code > _END:
            following += 1
            if following >= 1 << width and width < 12:
                width += 1
    return valid, total


def _facts(v: np.ndarray) -> dict:
    pairs = v[: len(v) // 2 * 2 : 2]
    share, lengths = -1.0, 0
    if len(v) >= 8 and v[0]:
        table = v[1 : int(v[0]) + 1]
        fits = (table >= 1) & (table <= 20)
        share, lengths = float(fits.mean()), len(np.unique(table[fits]))
    valid, total = _lzw(v) if len(v) >= 8 else (0, 0)
    return {
        "pairs_low": int(((pairs >= 1) & (pairs <= 127)).sum()), "odd_values": len(np.unique(v[1::2])), "flags9": _flag_share(v, 9), "flags17": _flag_share(v, 17),
        "table": share, "lengths": lengths, "lzw_valid": valid, "lzw_total": total,
    }


@kernels.kernel(_FACTS)
def coding_facts(blobs: pa.Array) -> pa.Array:
    return kernels.each(blobs, _facts, _FACTS)


def of_blob(data: bytes) -> list[tuple[str, float]]:
    """(algorithm, confidence) of the rules for codings that fire on one blob: what ``fingerprints`` gives a table of blobs."""
    v = np.frombuffer(data, np.uint8)
    n, out = len(v), []
    if n < 3:
        return out
    facts, counts = _facts(v), kernels.histogram_of(v)
    head = [int(x) for x in v[:5]]
    kind, word = head[0] >> 1 & 3, head[0] | head[1] << 8 | head[2] << 16
    if n >= 5 and kind == 0 and (head[1] | head[2] << 8) ^ (head[3] | head[4] << 8) == 0xFFFF:
        out.append(("Deflate", 0.85))
    elif kind == 1:
        out.append(("Deflate", 0.55))
    elif n >= 4 and kind == 2 and word >> 3 & 31 <= 29 and word >> 8 & 31 <= 29:
        out.append(("Deflate", 0.80))
    pairs = facts["pairs_low"] / (n // 2)
    rle = min(0.85, 0.3 + pairs * 0.4 + (1 - facts["odd_values"] / 256) * 0.15)
    if n >= 4 and pairs >= 0.4 and rle >= 0.4:
        out.append(("RLE", rle))
    low = counts[:4].sum() / n
    falls = sum(counts[i] > counts[i + 1] for i in range(3))
    mtf = min(0.85, 0.3 + 0.2 * (low > 0.5) + 0.1 * (low > 0.7) + 0.15 * (falls >= 3) + 0.1 * (counts[128:].sum() / n < 0.1))
    if n >= 16 and low >= 0.3 and mtf >= 0.5:
        out.append(("MTF", mtf))
    runs, entropy = int((v[1:] != v[:-1]).sum()) + 1, round(float(kernels.entropy_of(counts)), 6)
    mean_run = (2 * n - runs) / runs
    bwt = 0.3 + 0.15 * (mean_run > 3) + 0.1 * (mean_run > 5) + 0.1 * (3 < entropy < 7.5) + 0.1 * (runs < n // 2)
    if n >= 32 and mean_run >= 2 and bwt >= 0.4:
        out.append(("BWT", min(0.75, bwt)))
    flags = max(facts["flags9"], facts["flags17"])
    if n >= 18 and flags >= 0.5:
        out.append(("LZ/LZSS", min(0.7, 0.3 + flags * 0.4)))
    if facts["table"] >= 0.7 and 2 <= facts["lengths"] <= 15:
        out.append(("Huffman", min(0.7, 0.3 + facts["table"] * 0.3 + 0.1 * (facts["lengths"] >= 3))))
    if facts["lzw_total"] >= 5 and (share := facts["lzw_valid"] / facts["lzw_total"]) >= 0.6:
        out.append(("LZW", min(0.8, 0.4 + share * 0.4)))
    return out


def _byte(i: int) -> Column:
    return F.conv(F.hex(F.substring("head", i + 1, 1)), 16, 10).cast("int")


def fingerprints(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, algorithm, confidence of every rule that fires."""
    rows = bytestats.with_counts(blobs.select(id_col, F.col(data_col).alias("data")))
    rows = rows.select(
        id_col, "counts", "n", F.substring("data", 1, 5).alias("head"), coding_facts("data").alias("f"),
        kernels.run_count("data").alias("runs"), kernels.serial_correlation("data").alias("serial"),
    )
    counts, n = F.col("counts"), F.col("n")
    rows = rows.withColumn("entropy", bytestats.entropy(counts, n)).withColumn("p", bytestats.chi_square_p(bytestats.chi_square(counts, n)))
    entropy, p = F.round("entropy", 6), F.col("p")
    part = lambda a, b: bytestats.total(F.slice(counts, a + 1, b - a)) / n

    kind = F.shiftright(_byte(0), 1).bitwiseAND(F.lit(3))
    stored = (_byte(1) + _byte(2) * 256).bitwiseXOR(_byte(3) + _byte(4) * 256) == 0xFFFF
    word = _byte(0) + _byte(1) * 256 + _byte(2) * 65536
    dynamic = (F.shiftright(word, 3).bitwiseAND(F.lit(31)) <= 29) & (F.shiftright(word, 8).bitwiseAND(F.lit(31)) <= 29)
    deflate = F.when((n >= 5) & (kind == 0) & stored, 0.85).when((n >= 3) & (kind == 1), 0.55).when((n >= 4) & (kind == 2) & dynamic, 0.80)

    pairs = F.col("f.pairs_low") / F.floor(n / 2)
    rle = F.least(F.lit(0.85), 0.3 + pairs * 0.4 + (1 - F.col("f.odd_values") / 256.0) * 0.15)
    rle = F.when((n >= 4) & (pairs >= 0.4) & (rle >= 0.4), rle)

    low = part(0, 4)
    falls = sum(F.when(F.element_at(counts, i + 1) > F.element_at(counts, i + 2), 1).otherwise(0) for i in range(3))
    bonus = lambda when, x: F.when(when, x).otherwise(0.0)
    mtf = F.least(F.lit(0.85), 0.3 + bonus(low > 0.5, 0.2) + bonus(low > 0.7, 0.1) + bonus(falls >= 3, 0.15) + bonus(part(128, 256) < 0.1, 0.1))
    mtf = F.when((n >= 16) & (low >= 0.3) & (mtf >= 0.5), mtf)

    mean_run = (n * 2 - F.col("runs")) / F.col("runs")
    bwt = 0.3 + bonus(mean_run > 3, 0.15) + bonus(mean_run > 5, 0.1) + bonus((entropy > 3) & (entropy < 7.5), 0.1) + bonus(F.col("runs") < F.floor(n / 2), 0.1)
    bwt = F.when((n >= 32) & (mean_run >= 2) & (bwt >= 0.4), F.least(F.lit(0.75), bwt))

    flags = F.greatest("f.flags9", "f.flags17")
    lz = F.when((n >= 18) & (flags >= 0.5), F.least(F.lit(0.7), 0.3 + flags * 0.4))
    arithmetic = F.when((n >= 64) & (entropy >= 7.9) & (p >= 0.01) & (F.abs("serial") <= 0.1), F.least(F.lit(0.5), 0.3 + p * 0.2))
    table = F.col("f.table")
    huffman = F.when((table >= 0.7) & F.col("f.lengths").between(2, 15), F.least(F.lit(0.7), 0.3 + table * 0.3 + bonus(F.col("f.lengths") >= 3, 0.1)))
    codes = F.col("f.lzw_valid") / F.col("f.lzw_total")
    lzw = F.when((F.col("f.lzw_total") >= 5) & (codes >= 0.6), F.least(F.lit(0.8), 0.4 + codes * 0.4))

    found = [("Deflate", deflate), ("RLE", rle), ("MTF", mtf), ("BWT", bwt), ("LZ/LZSS", lz), ("Arithmetic", arithmetic), ("Huffman", huffman), ("LZW", lzw)]
    items = [F.struct(F.lit(name).alias("algorithm"), confidence.alias("confidence")) for name, confidence in found]
    by_entropy = F.struct(ladders.ladder(entropy, ladders.FINGERPRINT).alias("algorithm"), F.when(n >= 16, ladders.ladder(entropy, ladders.FINGERPRINT_CONFIDENCE)).alias("confidence"))
    rows = rows.select(id_col, F.explode(F.array(by_entropy, *items)).alias("r"))
    return rows.where("r.confidence is not null").select(id_col, "r.algorithm", "r.confidence")
