"""Byte statistics of a stream of chunks, and sessions of events.

Histograms add up, so no watermark is needed for them: the state is 256 counts a
blob, whatever the number of chunks and their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels
from bytequarry.operators import bytestats


def running_histograms(chunks: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, byte, n of all chunks so far; for a stream in complete or update mode, and for a batch."""
    rows = chunks.select(id_col, kernels.byte_counts(data_col).alias("counts"))
    return rows.select(id_col, F.posexplode("counts").alias("byte", "n")).where("n > 0").groupBy(id_col, "byte").agg(F.sum("n").alias("n"))


def histogram_statistics(histograms: DataFrame, id_col: str = "blob_id") -> DataFrame:
    """id, n_bytes, entropy, chi_square from rows of ``running_histograms``."""
    rows = histograms.groupBy(id_col).agg(F.sum("n").alias("n_bytes"), F.collect_list("n").alias("counts"))
    n = F.col("n_bytes")
    return rows.select(id_col, "n_bytes", bytestats.entropy(F.col("counts"), n).alias("entropy"), bytestats.chi_square(F.col("counts"), n).alias("chi_square"))


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n, value: sessions of events, closed once the watermark has passed them. An extension."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
