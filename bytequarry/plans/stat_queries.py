"""Queries of the byte statistics, ladders and fingerprints over documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders
from bytequarry.operators import bytestats as B
from bytequarry.plans.catalogue import register
from bytequarry.session import table


def blobs(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(F.col("doc_id").alias("blob_id"), F.encode("text", "UTF-8").alias("data"))


def counted(spark, sf_dir: str) -> DataFrame:
    return B.with_counts(blobs(spark, sf_dir))


# Shared parts of the SQL: the bytes, histogram and totals of every document.
BYTES = "b AS MATERIALIZED (SELECT doc_id AS blob_id, unnest(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)) AS byte, unnest(range(octet_length(encode(text)))) AS pos FROM documents)"
HIST = f"{BYTES}, h AS MATERIALIZED (SELECT blob_id, byte, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT blob_id, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY blob_id)"
STATS = f"""{HIST}, s AS (SELECT h.blob_id, total, count(*) AS uniq, -sum(n / total * log2(n / total)) AS ent,
  256.0::DOUBLE / total * sum(n::DOUBLE * n) - total AS chi, sum(n * byte) / total AS mean FROM h JOIN t USING (blob_id) GROUP BY h.blob_id, total)"""


def p_sql(chi: str) -> str:
    spread = 2.0 / (9.0 * 255)
    z = f"((pow({chi} / 255.0::DOUBLE, {1 / 3!r}::DOUBLE) - {1.0 - spread!r}::DOUBLE) / {math.sqrt(spread)!r}::DOUBLE / {math.sqrt(2.0)!r}::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {B.ERFC_SCALE!r}::DOUBLE * abs({z})))"
    poly = f"{B.ERFC[-1]!r}::DOUBLE"
    for a in reversed(B.ERFC[:-1]):
        poly = f"({a!r}::DOUBLE + {t} * {poly})"
    value = f"({t} * {poly} * exp(-{z} * {z}))"
    return f"0.5::DOUBLE * CASE WHEN {z} < 0 THEN 2.0 - {value} ELSE {value} END"


@register("byte_histogram", f"WITH {HIST} SELECT blob_id, byte, n FROM h")
def byte_histogram(spark, sf_dir):
    return B.histogram_rows(blobs(spark, sf_dir))


@register("shannon_entropy", f"WITH {STATS} SELECT blob_id, round(ent, 6) AS entropy FROM s")
def shannon_entropy(spark, sf_dir):
    return counted(spark, sf_dir).select("blob_id", F.round(B.entropy(F.col("counts"), F.col("n")), 6).alias("entropy"))


@register("chi_square", f"WITH {STATS} SELECT blob_id, round(chi, 4) AS chi_square FROM s")
def chi_square(spark, sf_dir):
    return counted(spark, sf_dir).select("blob_id", F.round(B.chi_square(F.col("counts"), F.col("n")), 4).alias("chi_square"))


@register("chi_square_pvalue", f"WITH {STATS} SELECT blob_id, round({p_sql('chi')}, 6) AS p_value FROM s")
def chi_square_pvalue(spark, sf_dir):
    rows = counted(spark, sf_dir).withColumn("chi", B.chi_square(F.col("counts"), F.col("n")))
    return rows.select("blob_id", F.round(B.chi_square_p(F.col("chi")), 6).alias("p_value"))


@register("byte_mean", f"WITH {STATS} SELECT blob_id, round(mean, 6) AS mean FROM s")
def byte_mean(spark, sf_dir):
    return counted(spark, sf_dir).select("blob_id", F.round(B.mean(F.col("counts"), F.col("n")), 6).alias("mean"))


@register(
    "byte_extremes",
    f"WITH {HIST} SELECT blob_id, count(*) AS unique_bytes, arg_max(byte, n * 256 + 255 - byte) AS most_common, max(n) AS most_common_n, arg_min(byte, n * 256 + byte) AS least_common, min(n) AS least_common_n FROM h GROUP BY blob_id",
)
def byte_extremes(spark, sf_dir):
    rows = B.statistics(blobs(spark, sf_dir))
    return rows.select("blob_id", F.col("unique_bytes").cast("long").alias("unique_bytes"), "most_common", "most_common_n", "least_common", "least_common_n")


SERIAL = f"""WITH {BYTES}, m AS (SELECT blob_id, avg(byte) AS mean, count(*) AS n FROM b GROUP BY blob_id),
x AS (SELECT blob_id, n, byte - mean AS a, coalesce(lead(byte) OVER w, first_value(byte) OVER w) - mean AS c FROM b JOIN m USING (blob_id)
      WINDOW w AS (PARTITION BY blob_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@register("serial_correlation", f"{SERIAL} SELECT blob_id, round(CASE WHEN any_value(n) < 2 OR sum(a * a) = 0 THEN 0 ELSE sum(a * c) / sqrt(sum(a * a) * sum(c * c)) END, 6) AS serial_correlation FROM x GROUP BY blob_id")
def serial_correlation(spark, sf_dir):
    return blobs(spark, sf_dir).select("blob_id", F.round(kernels.serial_correlation("data"), 6).alias("serial_correlation"))


@register(
    "monte_carlo_pi",
    f"""WITH {BYTES}, p AS (SELECT blob_id, pos // 2 AS k, max(CASE WHEN pos % 2 = 0 THEN byte END) AS x, max(CASE WHEN pos % 2 = 1 THEN byte END) AS y FROM b GROUP BY ALL),
    c AS (SELECT blob_id, count(*) AS n FROM b GROUP BY blob_id)
    SELECT blob_id, round(CASE WHEN any_value(n) < 6 THEN 0 ELSE 4.0::DOUBLE * count(*) FILTER (y IS NOT NULL AND (x - 127.5) * (x - 127.5) + (y - 127.5) * (y - 127.5) <= 16256.25) / count(y) END, 6) AS pi
    FROM p JOIN c USING (blob_id) GROUP BY blob_id""",
)
def monte_carlo_pi(spark, sf_dir):
    return blobs(spark, sf_dir).select("blob_id", F.round(kernels.monte_carlo_pi("data"), 6).alias("pi"))


@register(
    "ngram_diversity",
    f"""WITH {BYTES}, g AS (SELECT blob_id, byte AS a, lead(byte, 1) OVER w AS c, lead(byte, 2) OVER w AS d, lead(byte, 3) OVER w AS e FROM b WINDOW w AS (PARTITION BY blob_id ORDER BY pos))
    SELECT blob_id, count(DISTINCT CASE WHEN c IS NOT NULL THEN a * 256 + c END) AS bigrams, count(DISTINCT CASE WHEN d IS NOT NULL THEN (a * 256 + c) * 256 + d END) AS trigrams,
      count(DISTINCT CASE WHEN e IS NOT NULL THEN ((a * 256 + c) * 256 + d)::BIGINT * 256 + e END) AS quadgrams,
      round(100.0::DOUBLE * count(DISTINCT CASE WHEN c IS NOT NULL THEN a * 256 + c END) / 65536, 6) AS bigram_percent,
      round(100.0::DOUBLE * count(DISTINCT CASE WHEN d IS NOT NULL THEN (a * 256 + c) * 256 + d END) / 16777216, 6) AS trigram_percent FROM g GROUP BY blob_id""",
)
def ngram_diversity(spark, sf_dir):
    rows = blobs(spark, sf_dir).select("blob_id", kernels.ngram_counts("data").alias("g"))
    return rows.select(
        "blob_id",
        "g.bigrams",
        "g.trigrams",
        "g.quadgrams",
        F.round(F.col("g.bigrams") * 100.0 / 65536, 6).alias("bigram_percent"),
        F.round(F.col("g.trigrams") * 100.0 / 16777216, 6).alias("trigram_percent"),
    )


PAIRED = """WITH d AS (SELECT doc_id AS blob_id, encode(text) AS x, octet_length(encode(text)) // 2 AS cut FROM documents),
p AS (SELECT blob_id, hex(x[1:cut]) AS l, hex(x[cut + 1:]) AS r FROM d),
u AS (SELECT blob_id, unnest(regexp_extract_all(l, '..')) AS b, 0 AS side FROM p UNION ALL SELECT blob_id, unnest(regexp_extract_all(r, '..')), 1 FROM p),
g AS (SELECT blob_id, b, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS c FROM u GROUP BY ALL),
t AS (SELECT blob_id, sum(a)::DOUBLE AS na, sum(c)::DOUBLE AS nc, count(*) AS seen FROM g GROUP BY blob_id)"""


def halves(spark, sf_dir):
    """Histograms of the first and the second half of each document."""
    rows = blobs(spark, sf_dir).withColumn("cut", F.floor(F.octet_length("data") / 2).cast("int"))
    rows = rows.select("blob_id", F.expr("substring(data, 1, cut)").alias("left"), F.expr("substring(data, cut + 1)").alias("right"))
    rows = rows.select("blob_id", kernels.byte_counts("left").alias("a"), kernels.byte_counts("right").alias("b"))
    return rows.withColumn("na", B.total(F.col("a"))).withColumn("nb", B.total(F.col("b")))


@register(
    "kl_divergence",
    f"""{PAIRED} SELECT blob_id, round(CASE WHEN na = 0 OR nc = 0 THEN 0 ELSE sum((a + 1) / (na + 256) * ln(((a + 1) / (na + 256)) / ((c + 1) / (nc + 256))))
      + (256 - seen) * (1 / (na + 256) * ln((1 / (na + 256)) / (1 / (nc + 256)))) END, 6) AS kl FROM g JOIN t USING (blob_id) GROUP BY blob_id, na, nc, seen""",
)
def kl_divergence(spark, sf_dir):
    return halves(spark, sf_dir).select("blob_id", F.round(B.kl_divergence(F.col("a"), F.col("na"), F.col("b"), F.col("nb")), 6).alias("kl"))


@register(
    "two_sample_chi2",
    f"{PAIRED} SELECT blob_id, round(CASE WHEN na = 0 OR nc = 0 THEN 0 ELSE sum((a / na - c / nc) * (a / na - c / nc) / ((a + c) / (na + nc))) * na * nc / (na + nc) END, 4) AS chi_square FROM g JOIN t USING (blob_id) GROUP BY blob_id, na, nc",
)
def two_sample_chi2(spark, sf_dir):
    chi = B.two_sample_chi_square(F.col("a"), F.col("na"), F.col("b"), F.col("nb"))
    return halves(spark, sf_dir).select("blob_id", F.round(chi, 4).alias("chi_square"))


@register("incompressible", f"WITH {STATS} SELECT blob_id, round(chi, 4) AS chi_square, total >= 64 AND chi < 310 AS incompressible FROM s")
def incompressible(spark, sf_dir):
    return B.incompressible(blobs(spark, sf_dir)).withColumn("chi_square", F.round("chi_square", 4))


@register("likely_text", f"WITH {HIST} SELECT blob_id, any_value(total) >= 8 AND sum(n) FILTER (byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13)) / any_value(total) > 0.85 AS likely_text FROM h JOIN t USING (blob_id) GROUP BY blob_id")
def likely_text(spark, sf_dir):
    return counted(spark, sf_dir).select("blob_id", B.likely_text(F.col("counts"), F.col("n")).alias("likely_text"))


@register(
    "tile_facts",
    f"WITH {HIST} SELECT blob_id, round(coalesce(sum(n) FILTER (byte = 0), 0) / any_value(total), 6) AS zero_share, round(coalesce(sum(n) FILTER (byte BETWEEN 32 AND 126), 0) / any_value(total), 6) AS ascii_share, arg_max(byte, n * 256 + 255 - byte) AS top_byte FROM h JOIN t USING (blob_id) GROUP BY blob_id",
)
def tile_facts(spark, sf_dir):
    rows = counted(spark, sf_dir)
    part = B.shares(F.col("counts"), F.col("n"))
    top = F.array_max(F.transform("counts", lambda x, i: F.struct(x.alias("n"), (-i).alias("b"))))
    return rows.select("blob_id", F.round(part["null_n"] / F.col("n"), 6).alias("zero_share"), F.round(part["printable_n"] / F.col("n"), 6).alias("ascii_share"), (-top["b"]).alias("top_byte"))


@register(
    "content_classes",
    f"""WITH {HIST} SELECT blob_id, CAST(coalesce(sum(n) FILTER (byte = 0), 0) AS BIGINT) AS null_n, CAST(coalesce(sum(n) FILTER (byte BETWEEN 1 AND 31 OR byte = 127), 0) AS BIGINT) AS control_n,
    CAST(coalesce(sum(n) FILTER (byte BETWEEN 32 AND 126), 0) AS BIGINT) AS printable_n, CAST(coalesce(sum(n) FILTER (byte >= 128), 0) AS BIGINT) AS high_n,
    round(100.0::DOUBLE * coalesce(sum(n) FILTER (byte BETWEEN 32 AND 126), 0) / any_value(total), 6) AS printable_percent FROM h JOIN t USING (blob_id) GROUP BY blob_id""",
)
def content_classes(spark, sf_dir):
    part = B.shares(F.col("counts"), F.col("n"))
    percent = F.round(part["printable_n"] * 100.0 / F.col("n"), 6).alias("printable_percent")
    return counted(spark, sf_dir).select("blob_id", *[part[k].alias(k) for k in ("null_n", "control_n", "printable_n", "high_n")], percent)


@register(
    "compressibility",
    f"""{SERIAL}, r AS (SELECT blob_id, CASE WHEN any_value(n) < 2 OR sum(a * a) = 0 THEN 0 ELSE sum(a * c) / sqrt(sum(a * a) * sum(c * c)) END AS serial FROM x GROUP BY blob_id),
    {STATS.partition(', h AS')[1].lstrip(', ')}{STATS.partition(', h AS')[2]}
    SELECT s.blob_id, CAST(ceil(round(ent * total / 8, 6)) AS BIGINT) AS ideal_bytes,
      CASE WHEN ent > 7.9 AND {p_sql('chi')} > 0.01 AND abs(serial) < 0.05 THEN 'random' WHEN ent > 7 THEN 'high' WHEN ent > 5 THEN 'moderate' ELSE 'low' END AS verdict FROM s JOIN r USING (blob_id)""",
)
def compressibility(spark, sf_dir):
    rows = B.statistics(blobs(spark, sf_dir))
    ideal = F.ceil(F.round(F.col("entropy") * F.col("n_bytes") / 8, 6)).cast("long")
    return rows.select("blob_id", ideal.alias("ideal_bytes"), ladders.compressibility(F.col("entropy"), F.col("p_value"), F.col("serial_correlation")).alias("verdict"))


@register(
    "run_stats",
    f"""WITH {BYTES}, l AS (SELECT blob_id, byte, lag(byte) OVER (PARTITION BY blob_id ORDER BY pos) AS before FROM b)
    SELECT blob_id, count(*) FILTER (before IS DISTINCT FROM byte) AS runs, round((count(*) + count(*) FILTER (before = byte)) / count(*) FILTER (before IS DISTINCT FROM byte), 6) AS mean_run FROM l GROUP BY blob_id""",
)
def run_stats(spark, sf_dir):
    rows = blobs(spark, sf_dir).select("blob_id", F.octet_length("data").alias("n"), kernels.run_count("data").alias("runs"))
    return rows.select("blob_id", "runs", F.round((F.col("n") * 2 - F.col("runs")) / F.col("runs"), 6).alias("mean_run"))


@register(
    "classify_region",
    f"WITH {STATS} SELECT blob_id, total AS n_bytes, uniq AS unique_bytes, round(ent, 6) AS entropy, {ladders.ladder_sql('round(ent, 6)', ladders.REGION)} AS class FROM s",
)
def classify_region(spark, sf_dir):
    return B.classes(counted(spark, sf_dir)).withColumn("unique_bytes", F.col("unique_bytes").cast("long"))


@register(
    "classify_fingerprint",
    f"WITH {STATS} SELECT blob_id, {ladders.ladder_sql('round(ent, 6)', ladders.FINGERPRINT)} AS algorithm, {ladders.ladder_sql('round(ent, 6)', ladders.FINGERPRINT_CONFIDENCE)} AS confidence FROM s WHERE total >= 16",
)
def classify_fingerprint(spark, sf_dir):
    rows = B.classes(counted(spark, sf_dir)).where("n_bytes >= 16")
    return rows.select("blob_id", ladders.ladder(F.col("entropy"), ladders.FINGERPRINT).alias("algorithm"), ladders.ladder(F.col("entropy"), ladders.FINGERPRINT_CONFIDENCE).alias("confidence"))


@register("classify_sliding", f"WITH {STATS} SELECT blob_id, CASE WHEN round(ent, 6) < 3 THEN 'LowEntropy' WHEN round(ent, 6) > 7 THEN 'HighEntropy' ELSE 'MediumEntropy' END AS type FROM s")
def classify_sliding(spark, sf_dir):
    return B.classes(counted(spark, sf_dir)).select("blob_id", ladders.classify_sliding(F.col("entropy")).alias("type"))


@register(
    "classify_block",
    f"""WITH {STATS}, z AS (SELECT blob_id, max(byte) = 0 AS zero FROM h GROUP BY blob_id)
    SELECT s.blob_id, CASE WHEN zero THEN 'Empty' WHEN starts_with(d.text, 'The') THEN 'HasSignature' WHEN round(ent, 6) < 3 THEN 'LowEntropy' WHEN round(ent, 6) < 5.5 THEN 'Structured' WHEN round(ent, 6) < 7.5 THEN 'Compressed' ELSE 'Random' END AS type
    FROM s JOIN z USING (blob_id) JOIN documents AS d ON d.doc_id = s.blob_id""",
)
def classify_block(spark, sf_dir):
    """Documents that start with "The" stand for blobs with a signature."""
    rows = counted(spark, sf_dir)
    zero = F.element_at("counts", 1) == F.col("n")
    known = F.substring("data", 1, 3) == F.lit("The").cast("binary")
    bits = F.round(B.entropy(F.col("counts"), F.col("n")), 6)
    return rows.select("blob_id", ladders.classify_block(bits, zero, known).alias("type"))
