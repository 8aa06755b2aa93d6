"""Windowed scans of blobs; the byte offset is the order key.

Kernels give each blob its spans as an array; spans become rows here, and all
that follows (labels, islands, merged regions) is window functions over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders


def span_rows(blobs: DataFrame, spans: Column, id_col: str = "blob_id", *keep: str) -> DataFrame:
    """id, offset, length, entropy, chi_square, mean: a row a span."""
    rows = blobs.select(id_col, *keep, F.explode(spans).alias("s"))
    return rows.select(id_col, *keep, "s.offset", "s.length", "s.entropy", "s.chi_square", "s.mean")


def entropy_tumbling(blobs: DataFrame, window: int = 256, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Adjacent windows of ``window`` bytes (16 at least), the shorter last one kept, with their region class."""
    rows = span_rows(blobs, kernels.tumbling(max(16, window))(data_col), id_col)
    return rows.withColumn("class", ladders.classify_region(F.round("entropy", 6)))


def entropy_sliding(blobs: DataFrame, window: int = 256, step: int = 64, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Full windows every ``step`` bytes (one for a blob no longer than a window), with their type."""
    rows = span_rows(blobs, kernels.sliding(window, step)(data_col), id_col)
    return rows.withColumn("type", ladders.classify_sliding(F.round("entropy", 6)))


def entropy_heatmap(blobs: DataFrame, window: int = 4096, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Full windows side by side; a shorter tail is dropped."""
    return span_rows(blobs, kernels.tumbling(window, keep_tail=False)(data_col), id_col)


def heatmap_grid(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    rows = blobs.select(id_col, F.explode(kernels.grid_of_256(data_col)).alias("t"))
    return rows.select(id_col, "t.*")


def islands(rows: DataFrame, label: str, id_col: str = "blob_id") -> DataFrame:
    """Adds ``island``: the number of the run of rows with one label, by offset."""
    order = Window.partitionBy(id_col).orderBy("offset")
    change = F.when(F.lag(label).over(order).eqNullSafe(F.col(label)), 0).otherwise(1)
    return rows.withColumn("__change", change).withColumn("island", F.sum("__change").over(order)).drop("__change")


def region_merge(blobs: DataFrame, window: int = 256, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Adjacent windows of one class become a region, whose facts are those of its own bytes."""
    rows = span_rows(blobs, kernels.merged_regions(max(16, window))(data_col), id_col)
    return rows.withColumn("class", ladders.classify_region(F.round("entropy", 6)))


def sliding_regions(blobs: DataFrame, window: int = 256, step: int = 64, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Runs of sliding windows of one type: start, end of the last window, mean of the windows' entropies."""
    runs = islands(entropy_sliding(blobs, window, step, id_col, data_col), "type", id_col)
    return runs.groupBy(id_col, "island").agg(
        F.min("offset").alias("offset"),
        F.max(F.col("offset") + F.col("length")).alias("end"),
        F.avg("entropy").alias("entropy"),
        F.first("type").alias("type"),
    ).drop("island")


def high_entropy_spans(samples: DataFrame, threshold: float = 7.5, id_col: str = "blob_id") -> DataFrame:
    """id, offset, end: from the first sample at or above the threshold to the first below it, or the last sample's offset."""
    order = Window.partitionBy(id_col).orderBy("offset")
    rows = samples.withColumn("high", F.col("entropy") >= threshold)
    rows = islands(rows.withColumn("next", F.lead("offset").over(order)), "high", id_col)
    runs = rows.where("high").groupBy(id_col, "island").agg(F.min("offset").alias("offset"), F.max("offset").alias("__last"), F.max_by("next", "offset").alias("__next"))
    return runs.select(id_col, "offset", F.coalesce("__next", "__last").alias("end"))


def block_map(spans: DataFrame, block: int, id_col: str = "blob_id") -> DataFrame:
    """id, block, depth, owners: the spans (offset, length, format) that cover each block, outermost first."""
    blocks = F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("length") - 1) / block))
    rows = spans.where("length > 0").select(id_col, "offset", "length", "format", F.explode(blocks).alias("block"))
    stack = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("l"), "offset", "format")))
    rows = rows.groupBy(id_col, "block").agg(F.count("*").alias("depth"), stack.alias("s"))
    return rows.select(id_col, "block", "depth", F.array_join("s.format", "/").alias("owners"))


def delta(blobs: DataFrame, distance: int, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, pos, delta: each byte less the one ``distance`` before it (0 before the start), modulo 256; a row a byte, made where the blob is."""
    rows = blobs.select(id_col, F.posexplode(kernels.deltas(distance)(data_col)).alias("pos", "delta"))
    return rows.withColumn("pos", F.col("pos").cast("long"))
