"""Trial decoding, chains of codings, benchmarks of codecs and integrity tests."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import codecs, kernels, scan
from bytequarry.operators import detect, fingerprint
from bytequarry.sources import archives, signatures

#: Strategies in the order in which they are tried: (name, kind).
ORDER = (
    *((n, "stream") for n in ("Gzip", "Zlib", "Bzip2", "Xz", "Lzma", "Zstd", "Lz4", "Snappy", "Brotli")),
    *((n, "primitive") for n in ("Deflate", "RLE", "MTF", "LZW", "LZSS", "BWT", "Huffman")),
    *((n, "archive") for n in ("Zip", "Tar")),
)
#: Those that keep the size, and that must lower the entropy more.
SAME_SIZE = ("BWT", "MTF")
MAX_DEPTH = 10
# Fingerprints and the decoder that each suggests, least confidence of one that is followed, and confidences of blind steps and of archives.
SUGGESTED = {"Deflate": "Deflate", "RLE": "RLE", "MTF": "MTF", "BWT": "BWT", "LZW": "LZW", "LZ/LZSS": "LZSS", "Huffman": "Huffman"}
LEAST_SUGGESTED, BLIND, ARCHIVED = 0.3, 0.3, 0.9
#: Confidence from which a signature at the start of an output tells success, and the bytes in which it must lie.
KNOWN, KNOWN_BYTES = 0.8, 32


def _entropy(data: bytes) -> float:
    return float(kernels.entropy_of(kernels.histogram_of(np.frombuffer(data, np.uint8)))) if data else 0.0


def likely_text(data: bytes) -> bool:
    if len(data) < 8:
        return False
    v = np.frombuffer(data, np.uint8)
    return float((((v >= 32) & (v < 127)) | (v == 9) | (v == 10) | (v == 13)).mean()) > 0.85


def succeeded(before: bytes, after: bytes, name: str = "") -> bool:
    """Whether decoding brought structure out.

    Entropy falls by half a bit at no smaller size, or by 0.3 while the size grows
    by a fifth; or a text comes out of what was none; or the output starts with a
    well-known signature. Size-preserving transforms need the first or the third.
    """
    if not after or len(after) > 100 * len(before):
        return False
    gain = _entropy(before) - _entropy(after)
    text = likely_text(after) and not likely_text(before)
    if name in SAME_SIZE:
        return gain > 0.5 or text
    if gain >= 0.5 and len(after) >= len(before) or len(after) > 1.2 * len(before) and gain > 0.3 or text:
        return True
    return len(after) >= 8 and max((c for _, _, c in scan.hits(after[:KNOWN_BYTES], signatures.known())), default=0.0) >= KNOWN


@kernels.kernel(pa.bool_())
def success(before: pa.Array, after: pa.Array) -> pa.Array:
    """A column function: ``succeeded`` for inputs and outputs; null if either is."""
    return pa.array([None if a is None or b is None else succeeded(a, b) for a, b in zip(before.to_pylist(), after.to_pylist())], pa.bool_())


def attempt(data: bytes, name: str, kind: str) -> bytes:
    """The output of one strategy; raises where it fails or gives nothing.

    An archive gives its first file with content. Streams whose output is above the guard fail.
    """
    if kind == "archive":
        for _, _, size, _, method, folder, locked, content in archives.entries_of(data):
            if method != "Stream" and not folder and not locked and size and content:
                return content
        raise ValueError("no file with content")
    out = codecs.decode_whole(name, data)
    if not out:
        raise ValueError("no output")
    return out


def _fits(data: bytes, name: str) -> bool:
    """Archives are tried on what starts like them."""
    return data[:2] == b"PK" if name == "Zip" else data[257:262] == b"ustar"


def attempts(data: bytes, every: bool = False) -> list[tuple]:
    """(algorithm, kind, output size, output entropy, error, output) of the strategies, successes by entropy.

    Magics come first and are instant: one that fits is a confident match, after
    which no slower strategy runs (unless ``every`` one is asked for). Failures
    are listed behind, for those that ran.
    """
    found, failed = [], []
    best = {}
    for offset, form, confidence in scan.hits(data[: detect.HEADER_BYTES], signatures.known()) if data else ():
        if offset == 0:
            best[form] = max(confidence, best.get(form, 0.0))
    for form in sorted(best, key=lambda f: (-best[f], f)):
        found.append((form, "magic", len(data), _entropy(data), None, None))
    sure = bool(found)
    for name, kind in ORDER:
        if sure and not every:
            break
        if kind == "archive" and not _fits(data, name):
            continue
        try:
            out = attempt(data, name, kind)
        except Exception as problem:  # decoders fail in many ways on bytes that are not theirs
            failed.append((name, kind, 0, None, type(problem).__name__, None))
            continue
        found.append((name, kind, len(out), _entropy(out), None, out))
        sure = sure or kind == "archive"
    return sorted(found, key=lambda a: a[3]) + failed


_TRIAL = pa.list_(pa.struct([("rank", pa.int32()), ("algorithm", pa.string()), ("kind", pa.string()), ("output_size", pa.int64()), ("output_entropy", pa.float64()), ("improved", pa.bool_()), ("error", pa.string())]))


def trial_decode(blobs: DataFrame, every: bool = False, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, rank, algorithm, kind, output_size, output_entropy, improved, error: the strategies that ran on each blob.

    Successes come first, those of the lowest output entropy in front; failures
    have an error and no rank. A magic that fits (kind ``magic``: its output is the
    blob itself) or an archive that opens stops the slower strategies, unless
    ``every`` one is asked for. ``improved`` is the success rule. Whole outputs are
    measured; one above the guard is a failure. Null blobs give no rows.
    """

    @kernels.kernel(_TRIAL)
    def tried(blobs: pa.Array) -> pa.Array:
        out = []
        for data in blobs.to_pylist():
            rows = []
            for i, (name, kind, size, entropy, error, output) in enumerate(attempts(data, every) if data is not None else ()):
                improved = None if output is None else succeeded(data, output, name)
                rows.append({"rank": None if error else i, "algorithm": name, "kind": kind, "output_size": size, "output_entropy": entropy, "improved": improved, "error": error})
            out.append(rows)
        return pa.array(out, _TRIAL)

    return blobs.select(id_col, F.explode(tried(data_col)).alias("t")).select(id_col, "t.*")


_LAYERS = pa.list_(pa.struct([("depth", pa.int32()), ("algorithm", pa.string()), ("input_size", pa.int64()), ("output_size", pa.int64()), ("confidence", pa.float64())]))


def _step(data: bytes, seen: set[bytes]) -> tuple[str, bytes, float] | None:
    """One coding taken off: an archive's first file, else what a fingerprint suggests, else the first decoder that improves."""

    def fresh(out: bytes) -> bool:
        return hashlib.sha256(out).digest() not in seen

    plans = [(name, kind, ARCHIVED) for name, kind in ORDER if kind == "archive" and _fits(data, name)]
    suggested = sorted(((c, a) for a, c in fingerprint.of_blob(data) if c >= LEAST_SUGGESTED and a in SUGGESTED), key=lambda x: (-x[0], x[1]))
    plans += [(SUGGESTED[a], "primitive", c) for c, a in suggested]
    plans += [(name, kind, BLIND) for name, kind in ORDER if kind != "archive"]
    for name, kind, confidence in plans:
        try:
            out = attempt(data, name, kind)
        except Exception:  # not this one's
            continue
        if (kind == "archive" or succeeded(data, out, name)) and fresh(out):
            return name, out, confidence
    return None


def chain_of(data: bytes, depth: int = MAX_DEPTH) -> list[dict]:
    """Codings from the outermost in, until no strategy gives bytes that are better and were not seen before."""
    seen, out = {hashlib.sha256(data).digest()}, []
    while len(out) < depth and (step := _step(data, seen)):
        name, inner, confidence = step
        seen.add(hashlib.sha256(inner).digest())
        out.append({"depth": len(out), "algorithm": name, "input_size": len(data), "output_size": len(inner), "confidence": confidence})
        data = inner
    return out


def chain_layers(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, depth, algorithm, input_size, output_size, confidence: the codings of each blob, outermost first."""

    @kernels.kernel(_LAYERS)
    def layers(blobs: pa.Array) -> pa.Array:
        return pa.array([chain_of(b or b"") for b in blobs.to_pylist()], _LAYERS)

    return blobs.select(id_col, F.explode(layers(data_col)).alias("l")).select(id_col, "l.*")


def patterns(size: int = 4096) -> dict[str, bytes]:
    """Inputs of a codec benchmark, each by a rule."""
    random = np.random.default_rng(42).integers(0, 256, size, np.uint8).tobytes()
    text = b"The quick brown fox jumps over the lazy dog. "
    records = b"".join(i.to_bytes(4, "little") + b"\0\0" + (i % 3).to_bytes(2, "little") + random[8 * i % size :][:8].ljust(8, b"\0") for i in range(size // 16))
    return {
        "Zeroes": bytes(size), "Alternating": b"\xaa\x55" * (size // 2), "Incrementing": bytes(i & 255 for i in range(size)), "Random": random,
        "Text": (text * (size // len(text) + 1))[:size], "SingleByte": b"\x42" * size, "BinaryStruct": records,
    }


def bench_matrix(spark, names: Sequence[str] = tuple(codecs.ENCODERS), size: int = 4096) -> DataFrame:
    """block, pattern, sizes, ratio, times, verified, error: every codec on every pattern (a fixed list of each)."""
    inputs = spark.createDataFrame(list(patterns(size).items()), "pattern string, data binary")
    blocks = spark.createDataFrame([(n,) for n in names], "block string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, pattern, data in zip(*(c.to_pylist() for c in batch.columns)):
                row = {"block": block, "pattern": pattern, "original_size": len(data)}
                try:
                    a = time.perf_counter()
                    packed = codecs.ENCODERS[block](data)
                    b = time.perf_counter()
                    back = codecs.DECODERS[block](packed, len(data) + 1)
                    row |= {"compressed_size": len(packed), "ratio": len(packed) / max(1, len(data)), "compress_ms": (b - a) * 1e3, "decompress_ms": (time.perf_counter() - b) * 1e3, "verified": back == data}
                except Exception as problem:  # an error row, so that one codec stops no other
                    row |= {"verified": False, "error": f"{type(problem).__name__}: {problem}"}
                rows.append(row)
            kind = pa.schema([("block", pa.string()), ("pattern", pa.string()), ("original_size", pa.int64()), ("compressed_size", pa.int64()), ("ratio", pa.float64()), ("compress_ms", pa.float64()), ("decompress_ms", pa.float64()), ("verified", pa.bool_()), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kind)

    matrix = blocks.crossJoin(inputs).repartition(8)
    return matrix.mapInArrow(run, "block string, pattern string, original_size long, compressed_size long, ratio double, compress_ms double, decompress_ms double, verified boolean, error string")


def bench_summary(matrix: DataFrame) -> DataFrame:
    """Ratios, speeds (MB a second, by the original size) and round trips of each codec over its patterns; those with an error are counted apart."""
    speed = lambda ms: F.col("original_size") / 1e6 / (F.col(ms) / 1e3)
    good = F.col("error").isNull()
    return matrix.groupBy("block").agg(
        F.avg("ratio").alias("avg_ratio"), F.min("ratio").alias("best_ratio"), F.max("ratio").alias("worst_ratio"),
        F.min(speed("compress_ms")).alias("min_compress_mb_s"), F.avg(speed("compress_ms")).alias("avg_compress_mb_s"),
        F.min(speed("decompress_ms")).alias("min_decompress_mb_s"), F.avg(speed("decompress_ms")).alias("avg_decompress_mb_s"),
        F.count_if(good).alias("n"), F.count_if(~good).alias("failed"), F.bool_and("verified").alias("all_verified"),
    )
