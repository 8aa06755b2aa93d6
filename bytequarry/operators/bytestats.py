"""Byte statistics of blobs.

One pass of the kernels gives each blob its histogram; all that follows from the
histogram is a built-in expression over its 256 counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders

#: Chi-square below which bytes count as incompressible, and the least size for that.
INCOMPRESSIBLE = 310.0
INCOMPRESSIBLE_BYTES = 64
# Coefficients of the complementary error function.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERFC_SCALE = 0.3275911


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def entropy(counts: Column, n: Column) -> Column:
    """Shannon entropy in bits a byte; 0 if empty."""
    term = lambda x: F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(_sum(F.transform(counts, term)))


def chi_square(counts: Column, n: Column) -> Column:
    """Against equal shares of all 256 values: 256 / n * sum of squares - n."""
    return F.when(n == 0, 0.0).otherwise(_sum(F.transform(counts, lambda x: x.cast("double") * x)) * 256.0 / n - n)


def erfc(x: Column) -> Column:
    t = 1.0 / (1.0 + ERFC_SCALE * F.abs(x))
    poly = F.lit(ERFC[-1])
    for a in reversed(ERFC[:-1]):
        poly = F.lit(a) + t * poly
    value = t * poly * F.exp(-x * x)
    return F.when(x < 0, 2.0 - value).otherwise(value)


def chi_square_p(chi: Column, degrees: int = 255) -> Column:
    """Upper tail by the cube-root normal approximation."""
    spread = 2.0 / (9.0 * degrees)
    z = (F.pow(chi / float(degrees), F.lit(1.0 / 3.0)) - (1.0 - spread)) / math.sqrt(spread)
    return 0.5 * erfc(z / math.sqrt(2.0))


def mean(counts: Column, n: Column) -> Column:
    weighted = F.aggregate(F.transform(counts, lambda x, i: x * i), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(n == 0, 0.0).otherwise(weighted / n)


def with_counts(blobs: DataFrame, data_col: str = "data") -> DataFrame:
    """All columns and ``counts`` (256 values) and ``n``."""
    return blobs.withColumn("counts", kernels.byte_counts(data_col)).withColumn("n", total(F.col("counts")))


def statistics(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """One row a blob with its fifteen statistics; a null blob has nulls, an empty one zeros and p = 1."""
    rows = blobs.select(
        F.col(id_col).alias(id_col),
        F.col(data_col).alias("data"),
    )
    rows = with_counts(rows).select(
        id_col,
        "counts",
        "n",
        kernels.serial_correlation("data").alias("serial_correlation"),
        kernels.monte_carlo_pi("data").alias("monte_carlo_pi"),
        kernels.ngram_counts("data").alias("grams"),
    )
    n, counts = F.col("n"), F.col("counts")
    rows = rows.withColumn("chi_square", chi_square(counts, n))
    top = F.array_max(F.transform(counts, lambda x, i: F.struct(x.alias("n"), (-i).alias("b"))))
    low = F.array_min(F.filter(F.transform(counts, lambda x, i: F.struct(x.alias("n"), i.alias("b"))), lambda s: s["n"] > 0))
    return rows.select(
        id_col,
        n.alias("n_bytes"),
        entropy(counts, n).alias("entropy"),
        mean(counts, n).alias("mean"),
        "chi_square",
        F.when(n == 0, 1.0).otherwise(chi_square_p(F.col("chi_square"))).alias("p_value"),
        "serial_correlation",
        "monte_carlo_pi",
        F.size(F.filter(counts, lambda x: x > 0)).alias("unique_bytes"),
        (-top["b"]).alias("most_common"),
        top["n"].alias("most_common_n"),
        F.coalesce(low["b"], F.lit(0)).alias("least_common"),
        F.coalesce(low["n"], F.lit(0)).alias("least_common_n"),
        F.col("grams.bigrams").alias("bigrams"),
        F.col("grams.trigrams").alias("trigrams"),
        F.col("grams.quadgrams").alias("quadgrams"),
        "counts",
    )


def histogram_rows(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, byte, n: one row for each byte value that occurs."""
    rows = with_counts(blobs.select(id_col, F.col(data_col).alias("data")))
    return rows.select(id_col, F.posexplode("counts").alias("byte", "n")).where("n > 0")


def incompressible(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, chi_square, incompressible, of all bytes."""
    rows = with_counts(blobs.select(id_col, F.col(data_col).alias("data")))
    chi = chi_square(F.col("counts"), F.col("n"))
    return rows.select(id_col, chi.alias("chi_square"), ((F.col("n") >= INCOMPRESSIBLE_BYTES) & (chi < INCOMPRESSIBLE)).alias("incompressible"))


def shares(counts: Column, n: Column) -> dict[str, Column]:
    """Shares of content classes of a histogram."""
    part = lambda a, b: total(F.slice(counts, a + 1, b - a))
    return {
        "null_n": part(0, 1),
        "control_n": part(1, 32) + part(127, 128),
        "printable_n": part(32, 127),
        "high_n": part(128, 256),
        "text_n": part(32, 127) + part(9, 11) + part(13, 14),
    }


def likely_text(counts: Column, n: Column) -> Column:
    return (n >= 8) & (shares(counts, n)["text_n"] / n > 0.85)


def kl_divergence(p: Column, n_p: Column, q: Column, n_q: Column) -> Column:
    """Kullback-Leibler divergence of two histograms in nats, each count raised by one; 0 if one is empty."""
    share = lambda x, n: (x + 1.0) / (n + 256.0)
    terms = F.zip_with(p, q, lambda a, b: share(a, n_p) * F.ln(share(a, n_p) / share(b, n_q)))
    return F.when((n_p == 0) | (n_q == 0), 0.0).otherwise(_sum(terms))


def two_sample_chi_square(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    term = lambda x, y: F.when(x + y > 0, F.pow(x / n_a - y / n_b, F.lit(2.0)) / ((x + y) / (n_a + n_b))).otherwise(0.0)
    return F.when((n_a == 0) | (n_b == 0), 0.0).otherwise(_sum(F.zip_with(a, b, term)) * n_a * n_b / (n_a + n_b))


def classes(rows: DataFrame, id_col: str = "blob_id") -> DataFrame:
    """id, n_bytes, unique_bytes, entropy, class from rows of ``with_counts``."""
    n, counts = F.col("n"), F.col("counts")
    bits = entropy(counts, n)
    return rows.select(
        id_col,
        n.alias("n_bytes"),
        F.size(F.filter(counts, lambda x: x > 0)).alias("unique_bytes"),
        F.round(bits, 6).alias("entropy"),
        ladders.classify_region(F.round(bits, 6)).alias("class"),
    )
