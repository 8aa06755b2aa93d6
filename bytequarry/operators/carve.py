"""Carving: payloads of known formats inside blobs, with their lengths.

A blob is scanned, probed and thinned out by one kernel where it lies: bytes are
neither copied for each hit nor shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels, scan
from bytequarry.operators import detect


@kernels.kernel(pa.int64())
def probed_length(data: pa.Array, formats: pa.Array) -> pa.Array:
    """Length of the payload that starts each blob, by the format's own marks."""
    return pa.array([None if d.as_py() is None or f is None else scan.payload_length(d.as_py(), f) for d, f in zip(data, formats.to_pylist())], pa.int64())


_CARVED = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("format", pa.string()), ("confidence", pa.float64())]))


def carve(blobs: DataFrame, signatures: DataFrame, least_confidence: float = 0.5, min_bytes: int = 128, max_bytes: int = 512_000_000, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, offset, length, format, confidence of the outermost payloads.

    A length comes from the format's own marks, or is the distance to the next
    hit of any format (confidence times 0.7); one that runs past the blob is cut
    (times 0.8). Payloads outside the size bounds, and those within another, are
    dropped. Null and empty blobs have none.
    """
    table = detect.signature_list(signatures)

    @kernels.kernel(_CARVED)
    def carved(blobs: pa.Array) -> pa.Array:
        names = ("offset", "length", "format", "confidence")
        found = [[] if b.as_py() is None else scan.carve(b.as_py(), table, least_confidence, min_bytes, max_bytes) for b in blobs]
        rows = [r for f in found for r in f]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.int64(), pa.int64(), pa.string(), pa.float64()))]
        return kernels._lists([len(f) for f in found], [False] * len(found), names, columns)

    return blobs.select(id_col, F.explode(carved(data_col)).alias("c")).select(id_col, "c.*")
