"""Hits and spans: as-of lengths, containment, the best of equal hits, top k, merged probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_next(hits: DataFrame, size_col: str = "size", id_col: str = "blob_id") -> DataFrame:
    """Adds ``length``: to the next strictly greater offset of the blob, else to its end.

    Hits at one offset all get the same length, which lead() would not give them.
    Offsets run backwards, so that the frame grows: Spark sums up one that shrinks
    anew for every row.
    """
    ahead = Window.partitionBy(id_col).orderBy(F.desc("offset")).rangeBetween(Window.unboundedPreceding, -1)
    return hits.withColumn("length", F.coalesce(F.min("offset").over(ahead), F.col(size_col)) - F.col("offset"))


def outermost(spans: DataFrame, *tie: str, id_col: str = "blob_id") -> DataFrame:
    """Drops spans that lie within an earlier one, by offset, then longer ones first, then ``tie``.

    Whatever contains a dropped span also ends no earlier than it, so the running
    maximum of ends over all earlier spans decides as the kept ones would.
    """
    before = (
        Window.partitionBy(id_col)
        .orderBy("offset", F.desc("length"), *tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    end = F.col("offset") + F.col("length")
    rows = spans.withColumn("__reach", F.max(end).over(before))
    return rows.where(F.col("__reach").isNull() | (F.col("__reach") < end)).drop("__reach")


def best_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_hits(hits: DataFrame, k: int, id_col: str = "blob_id") -> DataFrame:
    """The k most confident hits of each blob, then by offset and format."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("confidence"), "offset", "format"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_probes(probes: DataFrame, id_col: str = "blob_id") -> DataFrame:
    """id, format, confidence, level, health: the highest confidence; the health of the highest level, the worst of it if there are several."""
    best = F.max(F.struct("level", "health")).alias("best")
    rows = probes.groupBy(id_col, "format").agg(F.max("confidence").alias("confidence"), best)
    return rows.select(id_col, "format", "confidence", "best.level", "best.health")


def within_size(spans: DataFrame, least: int = 128, most: int = 512_000_000) -> DataFrame:
    return spans.where(F.col("length").between(least, most))
