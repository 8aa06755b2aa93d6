"""Queries of windows, regions, detection, hits and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders
from bytequarry.operators import detect, intervals, windows
from bytequarry.plans.catalogue import register
from bytequarry.plans.stat_queries import BYTES, STATS, blobs
from bytequarry.session import table
from bytequarry.streaming import byte_stream
from bytequarry.sources import signatures as S

REGION_SQL = ladders.ladder_sql("round(entropy, 6)", ladders.REGION)


def window_sql(key: str, where: str = "TRUE") -> str:
    """Facts of groups of bytes: ``key`` numbers the group of a byte."""
    return f"""{BYTES}, k AS (SELECT blob_id, {key} AS w, byte, count(*) AS n, min(pos) AS p FROM b WHERE {where} GROUP BY ALL),
    kt AS (SELECT blob_id, w, CAST(sum(n) AS BIGINT) AS length, min(p) AS "offset" FROM k GROUP BY ALL),
    win AS MATERIALIZED (SELECT k.blob_id, k.w, "offset", length, 0 - sum(n / length * log2(n / length)) AS entropy,
       256.0::DOUBLE / length * sum(n::DOUBLE * n) - length AS chi_square, sum(n * byte) / length AS mean FROM k JOIN kt USING (blob_id, w) GROUP BY k.blob_id, k.w, "offset", length)"""


def _rounded(rows: DataFrame, **digits: int) -> DataFrame:
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


@register("entropy_tumbling", f'WITH {window_sql("pos // 256")} SELECT blob_id, "offset", length, round(entropy, 6) AS entropy, round(chi_square, 4) AS chi_square, round(mean, 6) AS mean, {REGION_SQL} AS class FROM win')
def entropy_tumbling(spark, sf_dir):
    return _rounded(windows.entropy_tumbling(blobs(spark, sf_dir)), entropy=6, chi_square=4, mean=6)


SLIDING = f"""WITH {BYTES}, z AS (SELECT blob_id, count(*) AS size FROM b GROUP BY blob_id),
st AS (SELECT blob_id, unnest(CASE WHEN size <= 256 THEN [0] ELSE range(0, size - 255, 64) END) AS "offset", least(size, 256) AS length FROM z),
k AS (SELECT st.blob_id, "offset", length, byte, count(*) AS n FROM st JOIN b ON b.blob_id = st.blob_id AND pos >= "offset" AND pos < "offset" + length GROUP BY ALL),
win AS MATERIALIZED (SELECT blob_id, "offset", CAST(length AS BIGINT) AS length, 0 - sum(n / length * log2(n / length)) AS entropy FROM k GROUP BY ALL),
ty AS (SELECT *, CASE WHEN round(entropy, 6) < 3 THEN 'LowEntropy' WHEN round(entropy, 6) > 7 THEN 'HighEntropy' ELSE 'MediumEntropy' END AS type FROM win)"""


@register("entropy_sliding", f'{SLIDING} SELECT blob_id, "offset", length, round(entropy, 6) AS entropy, type FROM ty')
def entropy_sliding(spark, sf_dir):
    rows = windows.entropy_sliding(blobs(spark, sf_dir)).select("blob_id", "offset", "length", "entropy", "type")
    return _rounded(rows, entropy=6)


@register("entropy_heatmap", f'WITH {window_sql("pos // 4096")} SELECT blob_id, "offset", round(entropy, 6) AS entropy FROM win WHERE length = 4096')
def entropy_heatmap(spark, sf_dir):
    return _rounded(windows.entropy_heatmap(blobs(spark, sf_dir)).select("blob_id", "offset", "entropy"), entropy=6)


@register(
    "heatmap_grid",
    f"""WITH {BYTES}, z AS (SELECT blob_id, count(*) // 256 AS q, count(*) % 256 AS e FROM b GROUP BY blob_id),
    k AS (SELECT b.blob_id, CASE WHEN pos < (q + 1) * e THEN pos // (q + 1) ELSE e + (pos - (q + 1) * e) // q END AS tile, byte, pos FROM b JOIN z USING (blob_id)),
    n AS (SELECT blob_id, tile, byte, count(*) AS n, min(pos) AS p FROM k GROUP BY ALL), t AS (SELECT blob_id, tile, sum(n) AS length, min(p) AS o FROM n GROUP BY ALL)
    SELECT n.blob_id, CAST(n.tile AS INT) AS tile, any_value(o) AS "offset", CAST(any_value(length) AS BIGINT) AS length, round(0 - sum(n / length * log2(n / length)), 6) AS entropy,
      round(coalesce(sum(n) FILTER (byte BETWEEN 32 AND 126), 0) / any_value(length), 6) AS ascii_share, arg_max(byte, n * 256 + 255 - byte) AS top_byte
    FROM n JOIN t USING (blob_id, tile) GROUP BY n.blob_id, n.tile""",
)
def heatmap_grid(spark, sf_dir):
    return _rounded(windows.heatmap_grid(blobs(spark, sf_dir)).drop("zero_share"), entropy=6, ascii_share=6)


ISLANDS = """c AS (SELECT *, CASE WHEN lag({label}) OVER (PARTITION BY blob_id ORDER BY "offset") IS NOT DISTINCT FROM {label} THEN 0 ELSE 1 END AS ch FROM {rows}),
i AS MATERIALIZED (SELECT *, sum(ch) OVER (PARTITION BY blob_id ORDER BY "offset") AS island FROM c)"""


@register(
    "region_merge",
    f"""WITH {window_sql("pos // 256")}, cl AS (SELECT *, {REGION_SQL} AS class FROM win), {ISLANDS.format(label="class", rows="cl")},
    m AS (SELECT k.blob_id, island, byte, sum(n) AS n, min(i."offset") AS o FROM k JOIN i ON i.blob_id = k.blob_id AND i.w = k.w GROUP BY k.blob_id, island, byte),
    mt AS (SELECT blob_id, island, CAST(sum(n) AS BIGINT) AS length, min(o) AS o FROM m GROUP BY ALL),
    f AS (SELECT m.blob_id, mt.o AS "offset", length, 0 - sum(n / length * log2(n / length)) AS entropy FROM m JOIN mt USING (blob_id, island) GROUP BY m.blob_id, island, mt.o, length)
    SELECT blob_id, "offset", length, round(entropy, 6) AS entropy, {REGION_SQL} AS class FROM f""",
)
def region_merge(spark, sf_dir):
    return _rounded(windows.region_merge(blobs(spark, sf_dir)).select("blob_id", "offset", "length", "entropy", "class"), entropy=6)


@register(
    "sliding_regions",
    f"""{SLIDING}, {ISLANDS.format(label="type", rows="ty")}
    SELECT blob_id, min("offset") AS "offset", max("offset" + length) AS "end", round(avg(entropy), 6) AS entropy, any_value(type) AS type FROM i GROUP BY blob_id, island""",
)
def sliding_regions(spark, sf_dir):
    return _rounded(windows.sliding_regions(blobs(spark, sf_dir)), entropy=6)


@register(
    "high_entropy_spans",
    f"""WITH {window_sql("pos // 256")}, s AS (SELECT blob_id, "offset", round(entropy, 6) >= 4.2 AS high, lead("offset") OVER (PARTITION BY blob_id ORDER BY "offset") AS nxt FROM win), {ISLANDS.format(label="high", rows="s")}
    SELECT blob_id, min("offset") AS "offset", coalesce(arg_max(nxt, "offset") FILTER (nxt IS NOT NULL AND last_row = "offset"), max("offset")) AS "end"
    FROM (SELECT *, max("offset") OVER (PARTITION BY blob_id, island) AS last_row FROM i WHERE high) GROUP BY blob_id, island""",
)
def high_entropy_spans(spark, sf_dir):
    """Threshold 4.2 over 256-byte windows: texts have few spans above 7.5."""
    samples = _rounded(windows.entropy_tumbling(blobs(spark, sf_dir)), entropy=6)
    return windows.high_entropy_spans(samples, 4.2)


#: Word, confidence and length of the hits below.
WORDS = (("the", 0.5, 40), ("The", 0.9, 200), ("de", 0.7, 25), ("der", 0.8, 60))


def hits(spark, sf_dir) -> DataFrame:
    """Places of a few words of documents, as hits of formats named for them: one scan for all words."""
    places = F.explode(kernels.word_places([w.encode() for w, _, _ in WORDS])(F.encode("text", "UTF-8"))).alias("p")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.octet_length("text").cast("long").alias("size"), places)
    fact = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("p.which") + 1)
    word, confidence, length = zip(*WORDS)
    return rows.select("blob_id", "p.offset", fact(word).alias("format"), fact(length).cast("long").alias("length"), fact(confidence).alias("confidence"), "size")


def hit_sql() -> str:
    parts = []
    for word, confidence, length in (("the", 0.5, 40), ("The", 0.9, 200), ("de", 0.7, 25), ("der", 0.8, 60)):
        parts.append(
            f"""SELECT blob_id, s - {len(word)} AS "offset", '{word}' AS format, {length}::BIGINT AS length, {confidence}::DOUBLE AS confidence, size FROM (
            SELECT blob_id, size, m, i, sum(len + {len(word)}) OVER (PARTITION BY blob_id ORDER BY i) AS s FROM (
              SELECT doc_id AS blob_id, strlen(text) AS size, len(string_split(text, '{word}')) AS m, unnest(range(len(string_split(text, '{word}')))) AS i,
                unnest(list_transform(string_split(text, '{word}'), lambda x: strlen(x))) AS len FROM documents)) WHERE i < m - 1"""
        )
    return "hit AS MATERIALIZED (SELECT blob_id, CAST(\"offset\" AS BIGINT) AS \"offset\", format, length, confidence, CAST(size AS BIGINT) AS size FROM (" + " UNION ALL ".join(parts) + "))"


@register("union_hits", f"WITH {hit_sql()} SELECT format, count(*) AS n, CAST(sum(\"offset\") AS BIGINT) AS offsets FROM hit GROUP BY format")
def union_hits(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("format").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


@register("asof_next_hit", f'WITH {hit_sql()} SELECT blob_id, "offset", format, coalesce(min("offset") OVER (PARTITION BY blob_id ORDER BY "offset" RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), size) - "offset" AS length FROM hit')
def asof_next_hit(spark, sf_dir):
    return intervals.asof_next(hits(spark, sf_dir).drop("length")).select("blob_id", "offset", "format", "length")


@register(
    "interval_dedupe",
    f"""WITH {hit_sql()}, r AS (SELECT *, max("offset" + length) OVER (PARTITION BY blob_id ORDER BY "offset", length DESC, format ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit)
    SELECT blob_id, "offset", length, format FROM r WHERE reach IS NULL OR reach < "offset" + length""",
)
def interval_dedupe(spark, sf_dir):
    return intervals.outermost(hits(spark, sf_dir), "format").select("blob_id", "offset", "length", "format")


@register("hit_dedupe", f'WITH {hit_sql()} SELECT blob_id, "offset", max(confidence) AS confidence, arg_max(format, confidence) AS format FROM hit GROUP BY blob_id, "offset"')
def hit_dedupe(spark, sf_dir):
    rows = intervals.best_of(hits(spark, sf_dir), ["blob_id", "offset"], F.desc("confidence"), "format")
    return rows.select("blob_id", "offset", "confidence", "format")


@register("topk_hits", f'WITH {hit_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY confidence DESC, "offset", format) AS rank FROM hit) SELECT blob_id, "offset", format, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5')
def topk_hits(spark, sf_dir):
    return intervals.top_hits(hits(spark, sf_dir), 5).select("blob_id", "offset", "format", "rank")


@register(
    "block_map",
    f"""WITH {hit_sql()}, x AS (SELECT blob_id, format, length, "offset", unnest(range("offset" // 64, ("offset" + length - 1) // 64 + 1)) AS block FROM hit)
    SELECT blob_id, block, count(*) AS depth, string_agg(format, '/' ORDER BY length DESC, "offset", format) AS owners FROM x GROUP BY blob_id, block""",
)
def block_map(spark, sf_dir):
    return windows.block_map(hits(spark, sf_dir), 64)


@register(
    "probe_merge",
    f"""WITH {hit_sql()}, p AS (SELECT blob_id, format, confidence, "offset" % 4 AS level, "offset" % 6 AS health FROM hit)
    SELECT blob_id, format, max(confidence) AS confidence, max(level) AS level, max(health) FILTER (level = top) AS health FROM (SELECT *, max(level) OVER (PARTITION BY blob_id, format) AS top FROM p) GROUP BY blob_id, format""",
)
def probe_merge(spark, sf_dir):
    """Levels and healths, both ordered numbers, are taken from the offsets."""
    rows = hits(spark, sf_dir).select("blob_id", "format", "confidence", (F.col("offset") % 4).alias("level"), (F.col("offset") % 6).alias("health"))
    return intervals.merge_probes(rows)


def pages(spark, sf_dir) -> DataFrame:
    """Web pages with real magics in front of some, by number, and a path from the url."""
    rows = table(spark, sf_dir, "pages")
    kinds = [m for _, m, o, *_ in S.SIGNATURES if o == 0]
    magic = F.element_at(F.array(*[F.unhex(F.lit(m)) for m in kinds]), (F.pmod("page_id", F.lit(len(kinds))) + 1).cast("int"))
    data = F.when(F.col("page_id") % 3 == 0, F.concat(magic, F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".zip", ".tar.gz", ".PNG", ".html", "", ".gz")]), (F.pmod("page_id", F.lit(6)) + 1).cast("int"))
    return rows.select(F.col("page_id").alias("blob_id"), data.alias("data"), F.concat("url", ext).alias("path"))


def page_sql() -> str:
    kinds = [m for _, m, o, *_ in S.SIGNATURES if o == 0]
    sig = ", ".join(f"({i}, '{f}', '{m.upper()}', {o}, {c}::DOUBLE)" for i, (f, m, o, c, _) in enumerate(S.SIGNATURES))
    exts = sorted({(f, e) for f, _, _, _, x in S.SIGNATURES for e in x.split()} | set(S.COMPOUND))
    return f"""pg AS MATERIALIZED (SELECT page_id AS blob_id, CASE WHEN page_id % 3 = 0 THEN [{', '.join(repr(m.upper()) for m in kinds)}][page_id % {len(kinds)} + 1] ELSE '' END || hex(encode(html)) AS hx,
      url || ['.zip', '.tar.gz', '.PNG', '.html', '', '.gz'][page_id % 6 + 1] AS path FROM pages),
    sig(reg_order, format, magic, "offset", confidence) AS (VALUES {sig}),
    ext(format, ext) AS (VALUES {', '.join(f"('{f}', '{e.lower()}')" for f, e in exts)}),
    hm AS (SELECT blob_id, format, reg_order, sig."offset", confidence FROM pg JOIN sig ON substr(left(hx, 8192), 2 * sig."offset" + 1, length(magic)) = magic),
    dm AS (SELECT blob_id, arg_max(format, confidence * 1000000 - reg_order) AS format, max(confidence) AS confidence FROM hm GROUP BY blob_id),
    ex AS (SELECT blob_id, format, ext FROM (SELECT blob_id, ext.format, ext, row_number() OVER (PARTITION BY blob_id ORDER BY length(ext) DESC, ext.format) AS r FROM pg JOIN ext ON ends_with(lower(path), ext)) WHERE r = 1)"""


@register("detect_magic", f"WITH {page_sql()} SELECT blob_id, format, confidence FROM dm")
def detect_magic(spark, sf_dir):
    return detect.detect_magic(pages(spark, sf_dir), S.signatures(spark))


@register("signature_prefix_join", f'WITH {page_sql()} SELECT blob_id, format, confidence FROM pg JOIN sig ON "offset" = 0 AND length(magic) >= 4 AND starts_with(hx, magic)')
def signature_prefix_join(spark, sf_dir):
    return detect.prefix_matches(pages(spark, sf_dir), S.signatures(spark))


@register("detect_by_extension", f"WITH {page_sql()} SELECT blob_id, format, ext FROM ex")
def detect_by_extension(spark, sf_dir):
    return detect.by_extension(pages(spark, sf_dir), S.extensions(spark))


DETECTED = f"WITH {page_sql()}, de AS (SELECT pg.blob_id, coalesce(dm.format, ex.format) AS format, coalesce(dm.confidence, CASE WHEN ex.format IS NOT NULL THEN 0.4::DOUBLE END) AS confidence, length(hx) // 2 AS size FROM pg LEFT JOIN dm USING (blob_id) LEFT JOIN ex USING (blob_id))"


def detected(spark, sf_dir) -> DataFrame:
    return detect.detect(pages(spark, sf_dir), S.signatures(spark), S.extensions(spark))


@register("detect_with_ext_fallback", f"{DETECTED} SELECT blob_id, format, confidence FROM de")
def detect_with_ext_fallback(spark, sf_dir):
    return detected(spark, sf_dir)


@register("format_distribution", f"{DETECTED} SELECT format, count(*) AS n FROM de GROUP BY format")
def format_distribution(spark, sf_dir):
    """One row a format; the null one counts unknown blobs."""
    return detected(spark, sf_dir).groupBy("format").agg(F.count("*").alias("n"))


@register(
    "format_rollup",
    f"""{DETECTED} SELECT category, format, count(*) AS n FROM (SELECT format, CASE WHEN format IN ('Gzip', 'Bzip2', 'Xz', 'Zstd', 'Lz4', 'Lzip', 'Lzop', 'Snappy', 'Compress') THEN 'Stream' WHEN format IN ('Flac', 'Ogg', 'Mp3', 'Midi', 'Riff') THEN 'Audio'
      WHEN format IN ('Mp4', 'Mkv') THEN 'Video' WHEN format LIKE 'Tar_%' THEN 'CompoundTar' WHEN format IS NOT NULL THEN 'Archive' END AS category FROM de) GROUP BY ROLLUP (category, format)""",
)
def format_rollup(spark, sf_dir):
    rows = detected(spark, sf_dir).withColumn("category", S.category(F.col("format")))
    return rows.rollup("category", "format").agg(F.count("*").alias("n"))


@register(
    "setops_formats",
    f"""{DETECTED} SELECT 'union' AS op, format FROM (SELECT format FROM dm UNION SELECT format FROM ex) UNION ALL SELECT 'intersect', format FROM (SELECT format FROM dm INTERSECT SELECT format FROM ex)
    UNION ALL SELECT 'except', format FROM (SELECT format FROM dm EXCEPT SELECT format FROM ex)""",
)
def setops_formats(spark, sf_dir):
    a = detect.detect_magic(pages(spark, sf_dir), S.signatures(spark)).select("format")
    b = detect.by_extension(pages(spark, sf_dir), S.extensions(spark)).select("format")
    named = lambda op, df: df.select(F.lit(op).alias("op"), "format")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", a.subtract(b)))


@register(
    "fuzzy_header",
    f"""WITH {page_sql()}, pb AS (SELECT blob_id, length(hx) // 2 AS z, unnest(regexp_extract_all(hx, '..')) AS byte, unnest(range(length(hx) // 2)) AS pos FROM pg),
    sb AS (SELECT reg_order, format, "offset" AS o, confidence, length(magic) // 2 AS m, unnest(range(length(magic) // 2)) AS i, unnest(regexp_extract_all(magic, '..')) AS byte FROM sig WHERE length(magic) >= 4),
    mt AS (SELECT blob_id, reg_order, format, confidence, m, pos - i - o AS start, count(*) AS n FROM pb JOIN sb USING (byte) WHERE pos - i - o BETWEEN 0 AND 1023 AND pos - i + m <= z GROUP BY ALL),
    cf AS (SELECT *, CASE WHEN n = m THEN confidence ELSE confidence * (n / m) * 0.7::DOUBLE END AS c FROM mt WHERE n = m OR n * 4 >= m * 3 AND n >= 2),
    be AS (SELECT *, row_number() OVER (PARTITION BY blob_id, start, format ORDER BY c DESC, reg_order) AS r FROM cf), tp AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY c DESC, start, format) AS k FROM be WHERE r = 1)
    SELECT blob_id, start AS "offset", format, CASE WHEN n = m THEN 'Exact' ELSE 'Fuzzy' END AS kind, CAST(n AS INT) AS matched, CAST(m AS INT) AS total, round(c, 6) AS confidence FROM tp WHERE k <= 50""",
)
def fuzzy_header(spark, sf_dir):
    return _rounded(detect.fuzzy_headers(pages(spark, sf_dir), S.signatures(spark)), confidence=6)


@register(
    "deep_scan",
    f"""WITH {page_sql()}, pl AS (SELECT blob_id, format, sig.confidence, unnest(list_filter(range(length(hx) // 2), lambda i: substr(hx, 2 * i + 1, length(magic)) = magic)) - sig."offset" AS "offset", hx FROM pg JOIN sig ON contains(hx, magic))
    SELECT blob_id, format, "offset", max(confidence) AS confidence, any_value(substr(hx, CAST(2 * "offset" + 1 AS INT), 32)) AS preview FROM pl WHERE "offset" >= 0 GROUP BY blob_id, format, "offset" """,
)
def deep_scan(spark, sf_dir):
    return detect.deep_scan(pages(spark, sf_dir), S.signatures(spark))


@register(
    "streaming_stats",
    f"WITH {STATS}, c AS (SELECT blob_id, max(pos) // 65536 + 1 AS chunks FROM b GROUP BY blob_id) SELECT blob_id, chunks, total AS n_bytes, round(ent, 6) AS entropy, round(chi, 4) AS chi_square FROM s JOIN c USING (blob_id)",
)
def streaming_stats(spark, sf_dir):
    """64 KiB chunks counted one by one; their histograms are added, as a stream of chunks would have them."""
    rows = blobs(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / 65536).cast("int"))))
    chunks = rows.select("blob_id", F.expr("substring(data, i * 65536 + 1, 65536)").alias("data"))
    stats = byte_stream.histogram_statistics(byte_stream.running_histograms(chunks))
    rows = rows.groupBy("blob_id").agg((F.max("i") + 1).cast("long").alias("chunks")).join(stats, "blob_id")
    return rows.select("blob_id", "chunks", "n_bytes", F.round("entropy", 6).alias("entropy"), F.round("chi_square", 4).alias("chi_square"))


@register("event_sessions", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return _rounded(byte_stream.event_sessions(table(spark, sf_dir, "events")), value=4)
