"""Format detection: magics as joins against the signature table.

The table is a fixed list, so it is broadcast; blobs are never shuffled for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions import kernels, scan

#: Bytes of a blob that header detection looks at, and bytes that near matches look at.
HEADER_BYTES = 4096
FUZZY_BYTES = 1024
# Least bytes of a magic and of a near match, factor of a near match's confidence, and matches reported.
FUZZY_LEAST, FUZZY_FACTOR, FUZZY_TOP = 2, 0.7, 50
EXTENSION_CONFIDENCE = 0.40


def header_matches(blobs: DataFrame, signatures: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, format, reg_order, offset, confidence of every signature that the header holds at its offset."""
    heads = blobs.select(id_col, F.substring(data_col, 1, HEADER_BYTES).alias("head"))
    sig = F.broadcast(signatures.where(F.col("offset") + F.octet_length("magic") <= HEADER_BYTES))
    found = F.expr("substring(head, offset + 1, octet_length(magic))") == F.col("magic")
    return heads.join(sig, found).select(id_col, "format", "reg_order", "offset", "confidence")


def detect_magic(blobs: DataFrame, signatures: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """The most confident match of each blob, the first registered among equals; blobs without one have no row."""
    best = F.max(F.struct("confidence", (-F.col("reg_order")).alias("r"), "format")).alias("b")
    rows = header_matches(blobs, signatures, id_col, data_col).groupBy(id_col).agg(best)
    return rows.select(id_col, "b.format", "b.confidence")


def prefix_matches(blobs: DataFrame, signatures: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Matches at offset 0 as an equi join on the first two bytes, then a check of the rest. One-byte magics have no such prefix."""
    sig = signatures.where((F.col("offset") == 0) & (F.octet_length("magic") >= 2)).withColumn("prefix2", F.substring("magic", 1, 2))
    heads = blobs.select(id_col, F.substring(data_col, 1, 64).alias("head")).withColumn("prefix2", F.substring("head", 1, 2))
    rows = heads.join(F.broadcast(sig), "prefix2").where(F.expr("substring(head, 1, octet_length(magic)) = magic"))
    return rows.select(id_col, "format", "confidence")


def by_extension(names: DataFrame, extensions: DataFrame, id_col: str = "blob_id", name_col: str = "path") -> DataFrame:
    """id, format, ext: the longest extension that the name ends in, whatever its case."""
    name = names.select(id_col, F.lower(name_col).alias("__name"))
    rows = name.join(F.broadcast(extensions.withColumn("ext", F.lower("ext"))), F.expr("endswith(__name, ext)"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.length("ext")), "format"))
    return rows.withColumn("__rank", rank).where("__rank = 1").select(id_col, "format", "ext")


def detect(blobs: DataFrame, signatures: DataFrame, extensions: DataFrame, mode: str = "magic_first", id_col: str = "blob_id", data_col: str = "data", name_col: str = "path") -> DataFrame:
    """id, format, confidence of every blob, null if nothing fits; ``mode`` says whether magic or extension goes first."""
    magic = detect_magic(blobs, signatures, id_col, data_col).select(id_col, F.col("format").alias("m"), F.col("confidence").alias("mc"))
    ext = by_extension(blobs, extensions, id_col, name_col).select(id_col, F.col("format").alias("e"))
    rows = blobs.select(id_col).join(magic, id_col, "left").join(ext, id_col, "left")
    by_ext = F.when(F.col("e").isNotNull(), F.lit(EXTENSION_CONFIDENCE))
    if mode == "ext_first":
        return rows.select(id_col, F.coalesce("e", "m").alias("format"), F.coalesce(by_ext, "mc").alias("confidence"))
    if mode != "magic_first":
        raise ValueError(f"unknown mode {mode!r}")
    return rows.select(id_col, F.coalesce("m", "e").alias("format"), F.coalesce("mc", by_ext).alias("confidence"))


_HEADERS = pa.list_(pa.struct([("offset", pa.int64()), ("format", pa.string()), ("kind", pa.string()), ("matched", pa.int32()), ("total", pa.int32()), ("confidence", pa.float64())]))


def header_matches_of(v: np.ndarray, table: list[scan.Signature], starts: int = FUZZY_BYTES, fuzzy: bool = True, top: int = FUZZY_TOP) -> list[tuple]:
    """(offset, format, kind, matched, total, confidence): headers that start in the first bytes of a blob, exact or nearly so."""
    best: dict[tuple[int, str], tuple] = {}
    for s in table:
        total = len(s.magic)
        count = min(starts, len(v), len(v) - s.offset - total + 1)
        if total < FUZZY_LEAST or count <= 0:
            continue
        matched = np.zeros(count, np.int32)
        for i, byte in enumerate(s.magic):
            part, mask = v[s.offset + i : s.offset + i + count], 255 if s.mask is None else s.mask[i]
            matched += (part if mask == 255 else part & mask) == byte
        near = (matched == total) | (matched * 4 >= total * 3) & (matched >= FUZZY_LEAST) & fuzzy
        for at in np.flatnonzero(near).tolist():
            m = int(matched[at])
            confidence = s.confidence if m == total else s.confidence * (m / total) * FUZZY_FACTOR
            if confidence > best.get((at, s.format), (0, 0, 0, 0, 0, -1.0))[5]:
                best[at, s.format] = at, s.format, "Exact" if m == total else "Fuzzy", m, total, confidence
    return sorted(best.values(), key=lambda r: (-r[5], r[0], r[1]))[:top]


def fuzzy_headers(blobs: DataFrame, signatures: DataFrame, fuzzy: bool = True, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, offset, format, kind, matched, total, confidence: headers that start anywhere in the first 1,024 bytes.

    All bytes of a magic of two or more fit (``Exact``), or three quarters of them
    and two at least (``Fuzzy``: confidence * share * 0.7). Masked bits do not
    count. Of one format at one offset the most confident match is kept; the 50
    most confident of a blob are reported, then those with the smallest offset.
    """
    table = signature_list(signatures)

    @kernels.kernel(_HEADERS)
    def matched(blobs: pa.Array) -> pa.Array:
        rows = [[] if v is None else header_matches_of(v, table, fuzzy=fuzzy) for v in kernels.views(blobs)]
        return pa.array([[dict(zip(("offset", "format", "kind", "matched", "total", "confidence"), r)) for r in found] for found in rows], _HEADERS)

    return blobs.select(id_col, F.explode(matched(data_col)).alias("h")).select(id_col, "h.*")


def signature_list(signatures: DataFrame) -> list[scan.Signature]:
    """The signatures on the driver: a fixed table of some hundred rows, which a kernel takes along."""
    rows = signatures.orderBy("reg_order").collect()
    mask = "mask" in signatures.columns
    return [scan.Signature(r["format"], bytes(r["magic"]), r["offset"], r["confidence"], bytes(r["mask"]) if mask and r["mask"] is not None else None) for r in rows]


_HITS = pa.list_(pa.struct([("format", pa.string()), ("offset", pa.int64()), ("confidence", pa.float64()), ("preview", pa.string())]))


def deep_scan(blobs: DataFrame, signatures: DataFrame, max_hits: int | None = None, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, format, offset, confidence, preview: every place of every magic, as the offset where the blob of that format would start.

    A place before the magic's own offset would start before the blob and is no
    hit. Hits of one format at one offset count once, by confidence. With
    ``max_hits`` the most confident of a blob are kept, then by offset and format.
    One kernel does all of this for a blob, so nothing is shuffled.
    """
    table = signature_list(signatures)

    @kernels.kernel(_HITS)
    def scanned(blobs: pa.Array) -> pa.Array:
        rows, sizes, null = [], [], []
        for blob in blobs:
            data = blob.as_py()
            found = scan.hits(data, table) if data else []
            if max_hits is not None:
                found = sorted(found, key=lambda h: (-h[2], h[0], h[1]))[:max_hits]
            rows += [(form, offset, confidence, data[offset : offset + 16].hex().upper()) for offset, form, confidence in found]
            sizes.append(len(found))
            null.append(data is None)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.string(), pa.int64(), pa.float64(), pa.string()))]
        return kernels._lists(sizes, null, ("format", "offset", "confidence", "preview"), columns)

    return blobs.select(id_col, F.explode(scanned(data_col)).alias("h")).select(id_col, "h.*")
