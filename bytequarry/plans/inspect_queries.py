"""Queries of validators, grids, refined regions, maps, format rules, verbatim finds, partitions and strings of several encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import codecs, ladders, strings
from bytequarry.operators import bytestats, identify, layout, validate
from bytequarry.plans.catalogue import register
from bytequarry.plans.stat_queries import BYTES, STATS, blobs
from bytequarry.plans.window_queries import REGION_SQL, _rounded, hit_sql, hits, window_sql
from bytequarry.session import table
from bytequarry.sources import archives


@register(
    "validate_gzip",
    """WITH p AS (SELECT doc_id AS blob_id, CASE WHEN doc_id % 11 = 0 THEN 9 WHEN doc_id % 13 = 0 THEN 15 ELSE 10 + strlen(text) END AS n, CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 8 END AS method,
      CASE WHEN doc_id % 7 = 0 THEN 224 ELSE 0 END AS flags, doc_id % 4 AS xfl FROM documents WHERE strlen(text) >= 8),
    c AS (SELECT *, CASE WHEN n < 10 THEN ['GZIP_TOO_SHORT'] WHEN method <> 8 THEN ['GZIP_BAD_METHOD']
      ELSE list_filter([CASE WHEN flags & 224 > 0 THEN 'GZIP_RESERVED_FLAGS' END, CASE WHEN xfl NOT IN (0, 2, 4) THEN 'GZIP_UNUSUAL_XFL' END, CASE WHEN n < 18 THEN 'GZIP_NO_TRAILER' END], lambda x: x IS NOT NULL) END AS codes FROM p)
    SELECT blob_id, n >= 10 AND method = 8 AS valid, CASE WHEN n < 10 THEN 0.3::DOUBLE WHEN method <> 8 THEN 0.4::DOUBLE WHEN flags > 0 OR n < 18 THEN 0.75::DOUBLE ELSE 0.85::DOUBLE END AS confidence,
      CASE WHEN n < 10 OR method <> 8 THEN 'Damaged' WHEN flags > 0 OR n < 18 THEN 'Degraded' ELSE 'Good' END AS health, array_to_string(codes, ',') AS codes FROM c""",
)
def validate_gzip(spark, sf_dir):
    """Gzip headers of several makes, by number, before texts; the header level."""
    rows = table(spark, sf_dir, "documents").where("octet_length(text) >= 8")
    part = lambda when, yes, no: F.when(when, F.unhex(F.lit(yes))).otherwise(F.unhex(F.lit(no)))
    n = F.col("doc_id")
    head = F.concat(F.unhex(F.lit("1f8b")), part(n % 5 == 0, "07", "08"), part(n % 7 == 0, "e0", "00"), F.unhex(F.lit("00000000")), F.unhex(F.lpad(F.hex(n % 4), 2, "0")), F.unhex(F.lit("03")))
    data = F.concat(head, F.encode("text", "UTF-8"))
    short = F.when(n % 11 == 0, F.substring(data, 1, 9)).when(n % 13 == 0, F.substring(data, 1, 15)).otherwise(data)
    out = validate.validate(rows.select(n.alias("blob_id"), F.lit("Gzip").alias("format"), short.alias("data"))).where("level = 'Header'")
    return out.select("blob_id", "valid", "confidence", "health", F.array_join("issues.code", ",").alias("codes"))


@register(
    "validate_formats",
    """WITH d AS (SELECT doc_id AS blob_id, unnest(['Gzip', 'Bzip2', 'Zip', 'Tar']) AS format, doc_id % 3 = 0 AS cut FROM documents WHERE strlen(text) >= 100),
    l AS (SELECT *, unnest(['Header', 'Structure', 'Integrity']) AS level FROM d),
    v AS (SELECT *, NOT (cut AND (level = 'Integrity' AND format IN ('Gzip', 'Bzip2', 'Zip', 'Tar') OR level = 'Structure' AND format = 'Zip')) AS valid FROM l)
    SELECT blob_id, format, level, CASE WHEN format = 'Tar' AND cut AND level = 'Structure' THEN TRUE ELSE valid END AS valid,
      CASE WHEN format = 'Gzip' THEN CASE level WHEN 'Header' THEN 0.85::DOUBLE WHEN 'Structure' THEN 0.88::DOUBLE ELSE CASE WHEN cut THEN 0.85::DOUBLE ELSE 0.99::DOUBLE END END
        WHEN format = 'Bzip2' THEN CASE level WHEN 'Header' THEN 0.88::DOUBLE WHEN 'Structure' THEN 0.87::DOUBLE ELSE CASE WHEN cut THEN 0.85::DOUBLE ELSE 0.99::DOUBLE END END
        WHEN format = 'Zip' THEN CASE level WHEN 'Header' THEN 0.9::DOUBLE WHEN 'Structure' THEN CASE WHEN cut THEN 0.5::DOUBLE ELSE 0.92::DOUBLE END ELSE CASE WHEN cut THEN 0.5::DOUBLE ELSE 0.99::DOUBLE END END
        ELSE CASE level WHEN 'Header' THEN CASE WHEN cut THEN 0.88::DOUBLE ELSE 0.92::DOUBLE END WHEN 'Structure' THEN 0.93::DOUBLE ELSE CASE WHEN cut THEN 0.5::DOUBLE ELSE 0.97::DOUBLE END END END AS confidence FROM v""",
)
def validate_formats(spark, sf_dir):
    """Each document packed four ways; every third is cut: streams lose their last 12 bytes, archives all behind their first 570."""
    rows = blobs(spark, sf_dir).where("octet_length(data) >= 100")
    made = {"Gzip": codecs.encode("Gzip")("data"), "Bzip2": codecs.encode("Bzip2")("data"), "Zip": archives.zipped("data"), "Tar": archives.tarred("data")}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), c.alias("data")) for f, c in made.items()])).alias("x")
    rows = rows.select("blob_id", each).select("blob_id", "x.format", "x.data")
    cut = F.when(F.col("format").isin("Gzip", "Bzip2"), F.expr("substring(data, 1, octet_length(data) - 12)")).when(F.col("format") == "Tar", F.expr("substring(data, 1, 570)")).otherwise(F.expr("substring(data, 1, octet_length(data) - 30)"))
    rows = rows.withColumn("data", F.when(F.col("blob_id") % 3 == 0, cut).otherwise(F.col("data")))
    return validate.validate(rows).select("blob_id", "format", "level", "valid", "confidence")


MAGICS = """'504B0304', '377ABCAF271C', '52617221', '1F8B', '425A68', 'FD377A585A00', '28B52FFD', '04224D18', '25504446', '89504E47', 'FFD8FF', '4D5A', '7F454C46', '53514C697465', 'EB52904E544653', 'EB3C90',
'53EF', '55AA', '4546492050415254', '664C6143', '4F676753', '52494646', '7573746172', '789C', '5D0000', 'CEB2CF81', 'D0CF11E0', '4B444D56', '636F6E6563746978', '514649FB', '3C3C3C20'"""


@register(
    "block_grid",
    f"""WITH {BYTES}, z AS (SELECT blob_id, count(*) AS z, greatest(1, count(*) // 256) AS step FROM b GROUP BY blob_id),
    k AS (SELECT b.blob_id, pos // step AS block, byte, count(*) AS n FROM b JOIN z USING (blob_id) WHERE pos // step < 256 GROUP BY ALL),
    t AS (SELECT blob_id, block, sum(n) AS m FROM k GROUP BY ALL),
    e AS (SELECT blob_id, block, 0 - sum(n / m * log2(n / m)) AS ent, max(byte) = 0 AS zero, count(*) AS u, arg_max(byte, n * 256 + 255 - byte) AS top FROM k JOIN t USING (blob_id, block) GROUP BY ALL),
    h AS (SELECT z.blob_id, g.block, encode(d.text)[step * g.block + 1 : step * g.block + least(step, 8)] AS head FROM z JOIN documents AS d ON d.doc_id = z.blob_id, range(256) AS g(block)),
    a AS (SELECT blob_id, h.block, z.step * h.block AS "offset", greatest(0, least(z.step, z.z - z.step * h.block)) AS size, coalesce(ent, 0) AS ent, coalesce(zero, TRUE) AS zero, coalesce(u, 0) AS u, coalesce(top, 0) AS top,
      len(list_filter([{MAGICS}], lambda m: starts_with(hex(head), m))) > 0 AND size > 0 AS known FROM h JOIN z USING (blob_id) LEFT JOIN e USING (blob_id, block))
    SELECT blob_id, CAST(block AS INT) AS block, "offset", size, round(ent, 6) AS entropy, CAST(u AS INT) AS unique_bytes, CAST(top AS INT) AS dominant,
      CASE WHEN zero THEN 'Empty' WHEN known THEN 'HasSignature' WHEN round(ent, 6) < 3 THEN 'LowEntropy' WHEN round(ent, 6) < 5.5 THEN 'Structured' WHEN round(ent, 6) < 7.5 THEN 'Compressed' ELSE 'Random' END AS type FROM a""",
)
def block_grid(spark, sf_dir):
    """Blocks of these texts are smaller than a sample, so all their bytes count."""
    rows = layout.block_grid(blobs(spark, sf_dir).where("octet_length(data) > 0"))
    return _rounded(rows.select("blob_id", "block", "offset", "size", "entropy", "unique_bytes", "dominant", "type"), entropy=6)


_RUN = """{a}c AS (SELECT *, CASE WHEN lag({label}) OVER (PARTITION BY {by} ORDER BY "offset") IS NOT DISTINCT FROM {label} THEN 0 ELSE 1 END AS ch FROM {rows}),
{a}i AS (SELECT *, sum(ch) OVER (PARTITION BY {by} ORDER BY "offset") AS {a}run FROM {a}c)"""


@register(
    "region_refine",
    f"""WITH {window_sql("pos // 256")}, cl AS (SELECT *, {REGION_SQL} AS class FROM win), {_RUN.format(a="x", label="class", by="blob_id", rows="cl")},
    big AS (SELECT blob_id, xrun, min("offset") AS a, CAST(sum(length) AS BIGINT) AS n FROM xi GROUP BY ALL),
    bp AS (SELECT b.blob_id, xrun, a, n, byte, pos, CASE WHEN n > 1024 THEN (pos - a) // 128 ELSE 0 END AS p FROM b JOIN big ON big.blob_id = b.blob_id AND pos >= a AND pos < a + n),
    q AS (SELECT blob_id, xrun, p, byte, count(*) AS n, min(pos) AS o FROM bp GROUP BY ALL), qt AS (SELECT blob_id, xrun, p, CAST(sum(n) AS BIGINT) AS length, min(o) AS "offset" FROM q GROUP BY ALL),
    qe AS MATERIALIZED (SELECT q.blob_id, q.xrun, q.p, qt."offset", length, 0 - sum(n / length * log2(n / length)) AS entropy FROM q JOIN qt USING (blob_id, xrun, p) GROUP BY q.blob_id, q.xrun, q.p, qt."offset", length),
    qc AS (SELECT *, {REGION_SQL} AS class FROM qe), {_RUN.format(a="y", label="class", by="blob_id, xrun", rows="qc")},
    m AS (SELECT q.blob_id, q.xrun, yrun, byte, sum(n) AS n, min(o) AS o FROM q JOIN yi USING (blob_id, xrun, p) GROUP BY ALL),
    mt AS (SELECT blob_id, xrun, yrun, CAST(sum(n) AS BIGINT) AS length, min(o) AS o FROM m GROUP BY ALL),
    f AS (SELECT m.blob_id, mt.o AS "offset", length, 0 - sum(n / length * log2(n / length)) AS entropy FROM m JOIN mt USING (blob_id, xrun, yrun) GROUP BY m.blob_id, xrun, yrun, mt.o, length)
    SELECT blob_id, "offset", length, round(entropy, 6) AS entropy, {REGION_SQL} AS class FROM f""",
)
def region_refine(spark, sf_dir):
    return _rounded(layout.region_refine(blobs(spark, sf_dir)).select("blob_id", "offset", "length", "entropy", "class"), entropy=6)


@register(
    "block_map_ascii",
    f"""WITH {hit_sql()}, s AS (SELECT blob_id, CAST(ceil(size / 64.0) AS BIGINT) AS n, least(n, 80) AS w FROM (SELECT blob_id, any_value(size) AS size FROM hit GROUP BY blob_id)),
    x AS (SELECT blob_id, format, length, "offset", unnest(range("offset" // 64, ("offset" + length - 1) // 64 + 1)) AS b FROM hit),
    o AS (SELECT blob_id, b, format FROM (SELECT *, row_number() OVER (PARTITION BY blob_id, b ORDER BY length, "offset" DESC, format DESC) AS r FROM x) WHERE r = 1),
    c AS (SELECT blob_id, unnest(range(w)) AS cell, n, w FROM s),
    f AS (SELECT c.blob_id, cell, coalesce(arg_min(upper(left(format, 1)), b), '·') AS letter FROM c LEFT JOIN o ON o.blob_id = c.blob_id AND b >= cell * n // w AND b < (cell + 1) * n // w GROUP BY c.blob_id, cell)
    SELECT blob_id, string_agg(letter, '' ORDER BY cell) AS strip FROM f GROUP BY blob_id""",
)
def block_map_ascii(spark, sf_dir):
    return layout.block_map_ascii(hits(spark, sf_dir))


@register(
    "mime_crosscheck",
    """WITH p AS (SELECT page_id AS blob_id, ['Zip', 'Gzip', 'Docx', 'Tar', 'Png'][page_id % 5 + 1] AS format, ['application/ZIP', 'application/gzip', 'application/x-tar', 'text/html', 'application/java-archive', 'application/x-bzip2'][page_id % 6 + 1] AS mime FROM pages)
    SELECT blob_id, format, mime, CASE lower(mime) WHEN 'application/zip' THEN format IN ('Zip', 'Docx') WHEN 'application/gzip' THEN format = 'Gzip' WHEN 'application/x-tar' THEN format = 'Tar' WHEN 'application/java-archive' THEN FALSE WHEN 'application/x-bzip2' THEN FALSE END AS agrees FROM p""",
)
def mime_crosscheck(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod("page_id", F.lit(n)) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("blob_id"), pick(("Zip", "Gzip", "Docx", "Tar", "Png"), 5).alias("format"),
        pick(("application/ZIP", "application/gzip", "application/x-tar", "text/html", "application/java-archive", "application/x-bzip2"), 6).alias("mime"),
    )
    return layout.mime_crosscheck(rows)


@register(
    "convert_tier",
    """WITH f AS (SELECT unnest(['Zip', 'Gzip', 'Zlib', 'Bzip2', 'Tar', 'TarGz', 'TarXz', 'SevenZip']) AS f),
    p AS (SELECT a.f AS source, b.f AS target, o AS optimize, s AS single FROM f AS a, f AS b, (VALUES (TRUE), (FALSE)) AS x(o), (VALUES (TRUE), (FALSE)) AS y(s))
    SELECT source, target, optimize, single, CASE WHEN optimize THEN 3
      WHEN source IN ('Gzip', 'Zlib') AND target IN ('Gzip', 'Zlib') AND source <> target THEN 1 WHEN source = 'Zip' AND target IN ('Gzip', 'Zlib') AND single THEN 1 WHEN source IN ('Gzip', 'Zlib') AND target = 'Zip' THEN 1
      WHEN source IN ('TarGz', 'TarXz') AND target IN ('TarGz', 'TarXz', 'Tar') THEN 2 WHEN source = 'Tar' AND target IN ('TarGz', 'TarXz') THEN 2
      WHEN source IN ('Gzip', 'Zlib', 'Bzip2') AND target IN ('Gzip', 'Zlib', 'Bzip2') THEN 2 ELSE 3 END AS tier FROM p""",
)
def convert_tier(spark, sf_dir):
    names = spark.createDataFrame([(f,) for f in ("Zip", "Gzip", "Zlib", "Bzip2", "Tar", "TarGz", "TarXz", "SevenZip")], "source string")
    flags = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = names.crossJoin(names.withColumnRenamed("source", "target")).withColumn("optimize", flags).withColumn("single", flags)  # a fixed list of 8 formats
    return rows.withColumn("tier", layout.convert_tier(F.col("source"), F.col("target"), F.col("optimize"), F.col("single")))


@register(
    "find_verbatim",
    """WITH p AS (SELECT doc_id AS blob_id, strlen(source) AS s, strlen(text) AS n FROM documents WHERE strlen(text) > 0)
    SELECT blob_id, CASE blob_id % 3 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'Bzip2' ELSE 'not found' END AS method, CAST(CASE blob_id % 3 WHEN 2 THEN -1 ELSE s + 4 END AS BIGINT) AS "offset" FROM p""",
)
def find_verbatim(spark, sf_dir):
    """Texts behind their source's name and four bytes: as they are, packed, or as another text."""
    rows = table(spark, sf_dir, "documents").where("octet_length(text) > 0").select(F.col("doc_id").alias("blob_id"), F.encode("text", "UTF-8").alias("content"), F.encode("source", "UTF-8").alias("s"))
    held = F.when(F.col("blob_id") % 3 == 0, F.col("content")).when(F.col("blob_id") % 3 == 1, codecs.encode("Bzip2")("content")).otherwise(F.lit("-").cast("binary"))
    rows = rows.select("blob_id", "content", F.concat("s", F.unhex(F.lit("00000000")), held, F.lit("end").cast("binary")).alias("archive"))
    return layout.find_verbatim(rows, codecs_to_try=("Bzip2",)).select("blob_id", "method", "offset")


@register(
    "partitions",
    """WITH p AS (SELECT page_id AS blob_id, page_id % 200 + 1 AS n FROM pages),
    a AS (SELECT blob_id, 0 AS index, '0x83' AS type, 512::BIGINT AS "offset", n * 512 AS size, blob_id % 2 = 0 AS active FROM p
      UNION ALL SELECT blob_id, 1, '0x0C', 1024, (n + 1) * 512, FALSE FROM p WHERE blob_id % 3 = 0)
    SELECT blob_id, 'MBR' AS scheme, CAST(index AS INT) AS index, type, "offset", CAST(size AS BIGINT) AS size, active FROM a""",
)
def partitions(spark, sf_dir):
    """Images of three sectors whose boot record has one or two partitions, and one that starts behind the end."""
    little = lambda c: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))
    n, hexed = F.col("page_id") % 200 + 1, lambda x: F.unhex(F.lit(x))
    one = F.concat(F.when(F.col("page_id") % 2 == 0, hexed("80000000")).otherwise(hexed("00000000")), hexed("83000000"), little(F.lit(1)), little(n))
    two = F.when(F.col("page_id") % 3 == 0, F.concat(hexed("000000000c000000"), little(F.lit(2)), little(n + 1))).otherwise(hexed("00" * 16))
    far = F.concat(hexed("0000000007000000"), little(F.lit(999)), little(n))
    data = F.concat(hexed("00" * 446), one, two, far, hexed("00" * 16), hexed("55aa"), hexed("00" * 1024))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("blob_id"), data.alias("data"))
    return layout.partitions(rows).select("blob_id", "scheme", "index", "type", "offset", "size", "active")


@register(
    "text_strings",
    r"""WITH d AS (SELECT doc_id AS blob_id, regexp_replace(text, '[\x{10000}-\x{10FFFF}]', 'éé', 'g') AS t FROM documents),
    m AS (SELECT blob_id, unnest(regexp_extract_all(t, '[\x20-\x7E]{4,}')) AS value, unnest(list_transform(regexp_split_to_array(t, '[\x20-\x7E]{4,}'), lambda x: length(x))) AS gap, unnest(range(len(regexp_split_to_array(t, '[\x20-\x7E]{4,}')))) AS i FROM d),
    o AS (SELECT blob_id, value, sum(gap) OVER w + coalesce(sum(length(value)) OVER (PARTITION BY blob_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM m WINDOW w AS (PARTITION BY blob_id ORDER BY i))
    SELECT blob_id, CAST(2 * place AS BIGINT) AS "offset", CAST(2 * length(value) AS BIGINT) AS length, value FROM o WHERE value IS NOT NULL""",
)
def text_strings(spark, sf_dir):
    """Documents as two-byte characters."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.encode("text", "UTF-16LE").alias("data"))
    return strings.text_strings(rows, encodings=("utf-16le",)).drop("encoding")


HEADER = """
struct Header {
  u8 first;              // of the text
  u16le pair; u16be turned;
  i32be number;
  bits[3] low; bits[7] across; bits[6] high;
  u24 inner;
  char[4] word; u8[first] some;
};
struct u24 { u8 a; u16le b; };
"""


@register(
    "parse_struct",
    f"""WITH {BYTES}, a AS (SELECT blob_id, list(byte ORDER BY pos) AS v, count(*) AS z FROM b WHERE pos < 300 GROUP BY blob_id HAVING count(*) >= 18),
    f AS (SELECT blob_id, unnest([
      {{'path': 'first', 'value': CAST(v[1] AS VARCHAR)}}, {{'path': 'pair', 'value': CAST(v[2] + 256 * v[3] AS VARCHAR)}}, {{'path': 'turned', 'value': CAST(256 * v[4] + v[5] AS VARCHAR)}},
      {{'path': 'number', 'value': CAST(((v[6]::BIGINT * 256 + v[7]) * 256 + v[8]) * 256 + v[9] - CASE WHEN v[6] >= 128 THEN 4294967296 ELSE 0 END AS VARCHAR)}},
      {{'path': 'low', 'value': CAST(v[10] & 7 AS VARCHAR)}}, {{'path': 'across', 'value': CAST(((v[10] + 256 * v[11]) >> 3) & 127 AS VARCHAR)}}, {{'path': 'high', 'value': CAST(v[11] >> 2 AS VARCHAR)}},
      {{'path': 'inner', 'value': NULL}}, {{'path': 'inner.a', 'value': CAST(v[12] AS VARCHAR)}}, {{'path': 'inner.b', 'value': CAST(v[13] + 256 * v[14] AS VARCHAR)}},
      {{'path': 'some', 'value': array_to_string(list_transform(v[19 : 18 + v[1]], lambda x: printf('%02X', x)), '')}}]) AS x, z FROM a)
    SELECT blob_id, x.path AS path, x.value AS value FROM f WHERE x.path <> 'some' OR z > 18""",
)
def parse_struct(spark, sf_dir):
    """Texts of 18 bytes or more read as a made-up header (the four characters are left out of the result: they may be no ASCII)."""
    rows = layout.parse_struct(blobs(spark, sf_dir).where("octet_length(data) >= 18"), HEADER)
    return rows.where("path <> 'word'").select("blob_id", "path", "value")


@register(
    "payload_class",
    f"WITH {STATS} SELECT blob_id, CASE WHEN round(ent, 6) < 1 THEN 'Constant' WHEN round(ent, 6) < 4 THEN 'Uncompressed' WHEN round(ent, 6) < 6.5 THEN 'Structured' WHEN round(ent, 6) < 7.5 THEN 'Compressed' ELSE 'Encrypted' END AS class FROM s",
)
def payload_class(spark, sf_dir):
    rows = bytestats.classes(bytestats.with_counts(blobs(spark, sf_dir)))
    return rows.select("blob_id", ladders.classify_payload(F.col("entropy")).alias("class"))


@register(
    "special_formats",
    """WITH p AS (SELECT page_id AS blob_id, page_id % 5 AS k, strlen(html) AS n, hex(encode(html)) AS hx FROM pages),
    q AS (SELECT *, ['0x' || substr(hx, 3, 2), '0x' || substr(hx, 5, 2), '0x' || substr(hx, 7, 2), '0x' || substr(hx, 9, 2)] AS b FROM p),
    r AS (SELECT *, b[1]::BIGINT + 256 * b[2]::BIGINT + 65536 * b[3]::BIGINT + 16777216 * b[4]::BIGINT AS size FROM q WHERE n >= 10)
    SELECT blob_id, CASE k WHEN 0 THEN 'RefPack' WHEN 1 THEN 'RefPack' WHEN 2 THEN 'Lzma' WHEN 3 THEN 'Tar' ELSE CASE WHEN n >= 13 AND size BETWEEN 1 AND 1073741824 THEN 'Lzma' END END AS format FROM r""",
)
def special_formats(spark, sf_dir):
    """Pages behind the marks that the heuristics know, by number."""
    hexed, h = (lambda x: F.unhex(F.lit(x))), F.encode("html", "UTF-8")
    kind = F.pmod("page_id", F.lit(5))
    data = F.when(kind == 0, F.concat(hexed("10fb"), h)).when(kind == 1, F.concat(hexed("f000000011fb"), h)).when(kind == 2, F.concat(hexed("5d00001000"), h))
    data = data.when(kind == 3, F.concat(hexed("f1" + "00" * 256), F.lit(b"ustar"), h)).otherwise(h)
    rows = table(spark, sf_dir, "pages").where("octet_length(html) >= 10").select(F.col("page_id").alias("blob_id"), data.alias("data"))
    return rows.select("blob_id", identify.special_format(F.col("data")).alias("format"))


@register(
    "payload_facts",
    """WITH d AS (SELECT source, text, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
    r AS (SELECT source, avg((n + 12) / n) AS avg_ratio FROM d GROUP BY source), c AS (SELECT source, text, count(*) AS k FROM d GROUP BY ALL), t AS (SELECT source, bool_and(TRUE) FILTER (k > 1) AS deterministic FROM c GROUP BY source),
    b AS (SELECT source, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM d), h AS (SELECT source, byte, count(*) AS n FROM b GROUP BY ALL), z AS (SELECT source, sum(n) AS z FROM h GROUP BY source),
    e AS (SELECT source, -sum(n / z * log2(n / z)) AS bits FROM h JOIN z USING (source) GROUP BY source)
    SELECT source, round(avg_ratio, 6) AS avg_ratio, deterministic, round(bits, 6) AS payload_entropy, bits > 6.5 AS compressed FROM r JOIN t USING (source) JOIN e USING (source)""",
)
def payload_facts(spark, sf_dir):
    """A made-up tool that puts eight bytes before a document and four behind it; sources stand for tools."""
    data = F.encode("text", "UTF-8")
    rows = table(spark, sf_dir, "documents").where("octet_length(text) > 0").select("source", data.alias("input"), F.concat(F.lit(b"HEADER01"), data, F.lit(b"FOOT")).alias("output"))
    return _rounded(identify.payload_facts(rows, 8, 4, group_cols=("source",)), avg_ratio=6, payload_entropy=6)


@register("compression_identify")
def compression_identify(spark, sf_dir):
    """Documents packed with Bzip2, with the size that they should have."""
    rows = blobs(spark, sf_dir).where("octet_length(data) > 0").select("blob_id", codecs.encode("Bzip2")("data").alias("data"), F.octet_length("data").alias("n"))
    return identify.compression_identify(rows, "n")
