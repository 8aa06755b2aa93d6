"""What a payload may be: heuristics beyond magics, marks of packed streams, decoders that accept it, and facts over runs of a tool."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import codecs, kernels, scan

#: First bytes in which marks of packed streams are looked for.
MARK_BYTES = 64
# Marks of packed streams.
MARKS = """
DEFLATE (zlib) 7801, DEFLATE (zlib) 785e, DEFLATE (zlib) 789c, DEFLATE (zlib) 78da, LZMA 5d0000, LZ4 frame 04224d18, Zstd frame 28b52ffd,
Brotli ceb2cf81, Snappy ff060000, DEFLATE raw edbd, BZip2 31415926
"""
# Confidence of an accepted output by its size (expected, larger, equal, smaller), and the bonus of a plausible entropy.
EXPECTED, LARGER, EQUAL, SMALLER, PLAUSIBLE = 0.95, 0.7, 0.5, 0.3, 0.1
#: Entropy above which a payload counts as compressed.
COMPRESSED = 6.5


def special_format(data: Column) -> Column:
    """RefPack, Lzma or Tar by rules that no magic expresses, null if none fits; for blobs without a magic."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("long")
    n = F.octet_length(data)
    ref = lambda at: (n >= at + 5) & (byte(at).bitwiseAND(F.lit(0xFE)) == 0x10) & (byte(at + 1) == 0xFB)
    size = byte(1) + byte(2) * (1 << 8) + byte(3) * (1 << 16) + byte(4) * (1 << 24)
    lzma = (n >= 13) & (byte(0) < 0xE1) & size.between(1, 0x40000000)
    tar = (n >= 263) & (F.substring(data, 258, 5) == F.lit(b"ustar"))
    return F.when(ref(0) | ref(4), "RefPack").when(lzma, "Lzma").when(tar, "Tar")


_MARKS = pa.list_(pa.struct([("offset", pa.int32()), ("format", pa.string())]))


def stream_marks(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, offset, format: marks of packed streams that begin in the first 64 bytes."""
    table = [(name, bytes.fromhex(m)) for name, _, m in (x.strip().rpartition(" ") for x in MARKS.split(","))]

    @kernels.kernel(_MARKS)
    def found(blobs: pa.Array) -> pa.Array:
        out = []
        for blob in blobs:
            head = (blob.as_py() or b"")[: MARK_BYTES + 8]
            spots = sorted({(at, name) for name, magic in table for at in scan.places(head, magic) if at < MARK_BYTES})
            out.append([{"offset": at, "format": name} for at, name in spots])
        return pa.array(out, _MARKS)

    return blobs.select(id_col, F.explode(found(data_col)).alias("m")).select(id_col, "m.*")


_ACCEPTED = pa.list_(pa.struct([("codec", pa.string()), ("output_size", pa.int64()), ("confidence", pa.float64())]))


def accepted(data: bytes, expected: int | None) -> list[tuple[str, int, float]]:
    """(codec, output size, confidence) of the decoders that take the bytes, most confident first."""
    out = []
    for name in codecs.DECODERS:
        try:
            made = codecs.decode_whole(name, data)
        except Exception:  # decoders fail in many ways on bytes that are not theirs
            continue
        if not made:
            continue
        confidence = EXPECTED if expected and len(made) == expected else LARGER if len(made) > len(data) else SMALLER if len(made) < len(data) else EQUAL
        bits = float(kernels.entropy_of(kernels.histogram_of(np.frombuffer(made, np.uint8))))
        out.append((name, len(made), min(1.0, confidence + PLAUSIBLE * (0.5 < bits < 7.5))))
    return sorted(out, key=lambda r: (-r[2], r[0]))


def compression_identify(blobs: DataFrame, expected_col: str | None = None, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, codec, output_size, confidence: every decoder that takes a payload; ``expected_col`` holds the size that the output should have. Null blobs have none."""

    @kernels.kernel(_ACCEPTED)
    def tried(blobs: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = [[] if b is None else accepted(b, n) for b, n in zip(blobs.to_pylist(), sizes.to_pylist())]
        return pa.array([[dict(zip(("codec", "output_size", "confidence"), r)) for r in found] for found in rows], _ACCEPTED)

    expected = F.col(expected_col).cast("long") if expected_col else F.lit(None).cast("long")
    return blobs.select(id_col, F.explode(tried(F.col(data_col), expected)).alias("c")).select(id_col, "c.*")


def payload_facts(runs: DataFrame, header: int, footer: int, in_col: str = "input", out_col: str = "output", group_cols: tuple[str, ...] = ()) -> DataFrame:
    """avg_ratio, deterministic, payload_entropy, compressed of a tool's runs (by group).

    The ratio is the output's size over the input's, averaged over runs where
    neither is empty. A tool is deterministic if equal inputs gave equal outputs
    (null if no input came twice). The entropy is that of the bytes between header
    and footer of all outputs together.
    """
    n_in, n_out = F.octet_length(in_col), F.octet_length(out_col)
    ratio = F.when((n_in > 0) & (n_out > 0), n_out / n_in)
    inner = F.expr(f"substring({out_col}, {int(header) + 1}, greatest(0, octet_length({out_col}) - {int(header) + int(footer)}))")
    keyed = runs.select(*group_cols, F.sha2(in_col, 256).alias("__in"), F.sha2(out_col, 256).alias("__out"), ratio.alias("__ratio"), kernels.byte_counts(inner).alias("__counts"))
    same = keyed.groupBy(*group_cols, "__in").agg(F.count("*").alias("__n"), (F.min("__out") == F.max("__out")).alias("__same"))
    same = same.groupBy(*group_cols).agg(F.bool_and(F.when(F.col("__n") > 1, F.col("__same"))).alias("deterministic"))
    counts = keyed.select(*group_cols, F.posexplode("__counts").alias("b", "n")).where("n > 0").groupBy(*group_cols, "b").agg(F.sum("n").alias("n"))
    total = counts.groupBy(*group_cols).agg(F.sum("n").alias("__t"), (-F.sum(F.col("n") * F.log2(F.col("n").cast("double")))).alias("__s"))
    bits = total.select(*group_cols, (F.log2(F.col("__t").cast("double")) + F.col("__s") / F.col("__t")).alias("payload_entropy"))
    rows = keyed.groupBy(*group_cols).agg(F.avg("__ratio").alias("avg_ratio"))
    for part in (same, bits):
        rows = rows.join(part, list(group_cols), "left") if group_cols else rows.join(part, how="left")
    return rows.select(*group_cols, "avg_ratio", "deterministic", F.coalesce("payload_entropy", F.lit(0.0)).alias("payload_entropy")).withColumn("compressed", F.col("payload_entropy") > COMPRESSED)
