"""Queries of the relational operators, strings, discovery and fingerprints."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders, strings
from bytequarry.operators import bytestats, fingerprint, relational, segmentation, trial, windows
from bytequarry.plans.catalogue import register
from bytequarry.plans.stat_queries import BYTES, STATS, blobs
from bytequarry.plans.window_queries import _rounded, window_sql
from bytequarry.session import table
from bytequarry.sources import archives
from bytequarry.sources import signatures as S


@register("filter_project", "SELECT doc_id, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def filter_project(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en' and n_chars > 1000").select("doc_id", "source", "n_chars")


@register("slice_bytes", "SELECT doc_id AS blob_id, hex(encode(text)[17:48]) AS part FROM documents")
def slice_bytes(spark, sf_dir):
    return blobs(spark, sf_dir).select("blob_id", F.hex(relational.slice_bytes(F.col("data"), 16, 32)).alias("part"))


# Blobs of three kinds, by number: 1,024 bytes of digests, a text, a picture's magic before such bytes.
DIGESTS_SQL = "array_to_string(list_transform(range(32), lambda i: upper(sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)))), '')"
MIXED_SQL = f"""m AS (SELECT doc_id AS blob_id, CASE doc_id % 3 WHEN 0 THEN {DIGESTS_SQL} WHEN 1 THEN hex(encode(text)) ELSE '89504E470D0A1A0A' || {DIGESTS_SQL} END AS hx FROM documents),
b AS MATERIALIZED (SELECT blob_id, unnest(list_transform(regexp_extract_all(hx, '..'), lambda x: ('0x' || x)::INT)) AS byte FROM m),
h AS (SELECT blob_id, byte, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT blob_id, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY blob_id),
s AS (SELECT h.blob_id, total, -sum(n / total * log2(n / total)) AS ent, 256.0::DOUBLE / total * sum(n::DOUBLE * n) - total AS chi,
  sum(n) FILTER (byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13)) / total > 0.85 AND total >= 8 AS text FROM h JOIN t USING (blob_id) GROUP BY h.blob_id, total)"""


def mixed_blobs(spark, sf_dir):
    """Documents as blobs of the three kinds above."""
    digests = F.unhex(F.concat(*[F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f":{i}")), 256) for i in range(32)]))
    kind = F.pmod("doc_id", F.lit(3))
    data = F.when(kind == 0, digests).when(kind == 1, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), digests))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), data.alias("data"))


INCOMPRESSIBLE = f"WITH {MIXED_SQL}, i AS (SELECT blob_id FROM s WHERE chi < 310 AND total >= 64)"


def _incompressible(spark, sf_dir):
    return bytestats.incompressible(mixed_blobs(spark, sf_dir)).where("incompressible").select(F.col("blob_id").alias("doc_id"))


@register("semi_join_incompressible", f"{INCOMPRESSIBLE} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT blob_id FROM i)")
def semi_join_incompressible(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(_incompressible(spark, sf_dir), "doc_id", "left_semi").select("doc_id", "source")


@register("anti_join_incompressible", f"{INCOMPRESSIBLE} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT blob_id FROM i)")
def anti_join_incompressible(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(_incompressible(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "source")


@register(
    "lookup_left_join",
    """WITH k(name, kind) AS (VALUES ('gzip', 'stream'), ('ZIP', 'archive'), ('Png', 'image')), p AS (SELECT page_id, ['GZIP', 'zip', 'Tar', 'PNG', 'gZip', NULL][page_id % 6 + 1] AS name FROM pages)
    SELECT page_id, p.name, kind FROM p LEFT JOIN k ON lower(p.name) = lower(k.name)""",
)
def lookup_left_join(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("GZIP", "zip", "Tar", "PNG", "gZip")], F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(names, (F.pmod("page_id", F.lit(6)) + 1).cast("int")).alias("name"))
    kinds = spark.createDataFrame([("gzip", "stream"), ("ZIP", "archive"), ("Png", "image")], "key string, kind string")
    return relational.lookup(rows, kinds, "name", "key", "kind")


@register(
    "archive_info",
    """SELECT source, count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS total_size, count(*) FILTER (strlen(text) >= 1000) AS large, 'Deflate' AS methods FROM documents GROUP BY source""",
)
def archive_info(spark, sf_dir):
    """A zip of each source's documents, told by its entries."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("data"))
    found = archives.archive_entries(archives.create_archives(rows, "source"), "source", "archive")
    methods = F.array_join(F.sort_array(F.collect_set("method")), ",")
    return found.groupBy("source").agg(F.count("*").alias("entries"), F.sum("size").alias("total_size"), F.count_if(F.col("size") >= 1000).alias("large"), methods.alias("methods"))


@register(
    "entry_name_filter",
    "SELECT page_id, url FROM pages WHERE lower(url) = '825' OR ends_with(lower(url), '/685') OR regexp_extract(lower(url), '([^/]*)$', 1) = '685'",
)
def entry_name_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(relational.name_matches(F.col("url"), "685")).select("page_id", "url")


GROUPS_SQL = r"""CASE WHEN ext IN ('.cs', '.java', '.c', '.cpp', '.h', '.hpp', '.py', '.js', '.ts', '.go', '.rs', '.rb', '.swift', '.kt', '.scala', '.lua', '.pl', '.r', '.m', '.mm', '.f', '.f90', '.asm', '.s') THEN 0
  WHEN ext IN ('.xml', '.html', '.htm', '.xhtml', '.svg', '.xaml', '.csproj', '.sln', '.slnx', '.props', '.targets', '.json', '.yaml', '.yml', '.toml', '.ini', '.cfg', '.conf', '.properties') THEN 1
  WHEN ext IN ('.txt', '.md', '.rst', '.tex', '.csv', '.tsv', '.log', '.rtf') THEN 2
  WHEN ext IN ('.exe', '.dll', '.so', '.dylib', '.sys', '.obj', '.o', '.lib', '.a', '.pdb', '.elf', '.bin', '.wasm') THEN 3
  WHEN ext IN ('.jpg', '.jpeg', '.png', '.gif', '.webp', '.bmp', '.ico', '.tif', '.tiff') THEN 4
  WHEN ext IN ('.mp3', '.mp4', '.avi', '.mkv', '.wav', '.flac', '.aac', '.ogg', '.m4a', '.webm', '.mov', '.wmv') THEN 5
  WHEN ext IN ('.zip', '.rar', '.7z', '.gz', '.bz2', '.xz', '.zst', '.lz4', '.br', '.lzma', '.tar') THEN 6
  WHEN ext IN ('.db', '.sqlite', '.mdb', '.dat', '.idx') THEN 7 ELSE -1 END"""
ENTRIES_SQL = r"SELECT *, lower(regexp_extract(path, '(\.[^./\\]*)$', 1)) AS ext FROM (SELECT page_id, page_id AS seq, url || ['.zip', '.TXT', '.PNG', '.html', '', '.exe', '.py', '.hpp', '.tsv', '.toml', '.o'][page_id % 11 + 1] AS path, strlen(html) AS size, page_id % 13 = 0 AS packed FROM pages)"


def entries(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".zip", ".TXT", ".PNG", ".html", "", ".exe", ".py", ".hpp", ".tsv", ".toml", ".o"))), (F.pmod("page_id", F.lit(11)) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("seq"), F.concat("url", ext).alias("path"), F.octet_length("html").cast("long").alias("size"))
    return rows.withColumn("group", relational.solid_group(F.col("path"), F.col("page_id") % 13 == 0))


@register("solid_groups", f"SELECT page_id, CASE WHEN packed THEN -2 ELSE {GROUPS_SQL} END AS \"group\" FROM ({ENTRIES_SQL})")
def solid_groups(spark, sf_dir):
    return entries(spark, sf_dir).select("page_id", "group")


@register(
    "solid_block_plan",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT page_id, size, g, row_number() OVER (PARTITION BY g ORDER BY seq) AS k FROM (SELECT *, CASE WHEN packed THEN -2 ELSE {GROUPS_SQL} END AS g FROM ({ENTRIES_SQL}))),
    r AS (SELECT page_id, g, k, size AS held, 0 AS block FROM e WHERE k = 1 UNION ALL
      SELECT e.page_id, e.g, e.k, CASE WHEN r.held + e.size > 50000 THEN e.size ELSE r.held + e.size END, CASE WHEN r.held + e.size > 50000 THEN r.block + 1 ELSE r.block END FROM r JOIN e ON e.g = r.g AND e.k = r.k + 1)
    SELECT page_id, g AS "group", block FROM r""",
)
def solid_block_plan(spark, sf_dir):
    return relational.solid_blocks(entries(spark, sf_dir), 50_000).select("page_id", "group", "block")


@register(
    "common_header_footer",
    """WITH d AS (SELECT hex(encode(html)) AS x FROM pages), p AS (SELECT x, unnest(range(64)) AS i FROM d),
    h AS (SELECT i, min(substr(x, 2 * i + 1, 2)) AS a, max(substr(x, 2 * i + 1, 2)) AS b, min(length(x)) // 2 AS n FROM p GROUP BY i),
    f AS (SELECT i, min(substr(x, length(x) - 2 * i - 1, 2)) AS a, max(substr(x, length(x) - 2 * i - 1, 2)) AS b, min(length(x)) // 2 AS n FROM p GROUP BY i),
    hb AS (SELECT coalesce(min(i) FILTER (a <> b OR i >= n), 64) AS stop FROM h), fb AS (SELECT coalesce(min(i) FILTER (a <> b OR i >= n), 64) AS stop FROM f)
    SELECT (SELECT coalesce(string_agg(a, '' ORDER BY i), '') FROM h, hb WHERE i < stop) AS header, (SELECT coalesce(string_agg(a, '' ORDER BY i DESC), '') FROM f, fb WHERE i < stop) AS footer""",
)
def common_header_footer(spark, sf_dir):
    return relational.common_ends(table(spark, sf_dir, "pages").select(F.col("page_id").alias("run"), F.encode("html", "UTF-8").alias("data")))


@register("determinism_pairs", "SELECT a.doc_id AS first, b.doc_id AS second FROM documents AS a JOIN documents AS b ON md5(a.text) = md5(b.text) AND a.text = b.text AND b.doc_id = (SELECT min(c.doc_id) FROM documents AS c WHERE c.text = a.text AND c.doc_id > a.doc_id)")
def determinism_pairs(spark, sf_dir):
    """Each output with the next equal one: as many rows as there are repeats, not pairs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    rows = rows.withColumn("second", F.lead("doc_id").over(Window.partitionBy("digest").orderBy("doc_id")))
    return rows.where("second is not null").select(F.col("doc_id").alias("first"), "second")


@register(
    "size_fields",
    """WITH p AS (SELECT page_id, strlen(html) AS n FROM pages), h AS (SELECT page_id, n, '4D5A' || printf('%04X', n % 65536) || printf('%08X', n) || 'FFFF' || printf('%02X%02X%02X%02X', n & 255, (n >> 8) & 255, (n >> 16) & 255, n >> 24) AS x FROM p),
    f AS (SELECT page_id, n, o, w, substr(x, 2 * o + 1, 2 * w) AS part FROM h, range(0, 14) AS r(o), (VALUES (2), (4)) AS v(w) WHERE o + w <= length(x) // 2),
    e AS (SELECT n, o, w, 'BE' AS endian, ('0x' || part)::BIGINT AS v FROM f UNION ALL
          SELECT n, o, w, 'LE', ('0x' || substr(part, 2 * w - 1, 2) || substr(part, 2 * w - 3, 2) || CASE WHEN w = 4 THEN substr(part, 3, 2) || substr(part, 1, 2) ELSE '' END)::BIGINT FROM f),
    a AS (SELECT o, w, endian FROM e GROUP BY ALL HAVING bool_and(v = n))
    SELECT o AS "offset", max(w) AS width, endian FROM a GROUP BY o, endian""",
)
def size_fields(spark, sf_dir):
    """Headers are made that hold each page's size: 2 bytes at 2, 4 big-endian at 4, 4 little-endian at 10."""
    rows = table(spark, sf_dir, "pages").select(F.encode("html", "UTF-8").alias("input"))
    n = F.octet_length("input")
    low = F.format_string("%02X%02X%02X%02X", n.bitwiseAND(F.lit(255)), F.shiftright(n, 8).bitwiseAND(F.lit(255)), F.shiftright(n, 16).bitwiseAND(F.lit(255)), F.shiftright(n, 24))
    head = F.concat(F.lit("4D5A"), F.format_string("%04X", n % 65536), F.format_string("%08X", n), F.lit("FFFF"), low)
    return relational.size_fields(rows.select("input", F.unhex(head).alias("output")), 14)


@register("hashes", "SELECT doc_id AS blob_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hashes(spark, sf_dir):
    return blobs(spark, sf_dir).select("blob_id", F.md5("data").alias("md5"), F.sha1("data").alias("sha1"), F.sha2("data", 256).alias("sha256"))


@register("bit_count", f"WITH {BYTES} SELECT blob_id, CAST(sum(bit_count(byte::UTINYINT)) AS BIGINT) AS bits FROM b GROUP BY blob_id")
def bit_count(spark, sf_dir):
    rows = bytestats.with_counts(blobs(spark, sf_dir))
    weighted = F.transform("counts", lambda x, i: x * F.bit_count(i))
    return rows.select("blob_id", bytestats.total(weighted).alias("bits"))


HITS_SQL = """WITH d AS (SELECT doc_id AS blob_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: chr(('0x' || x)::INT)), '') AS t FROM documents),
m AS (SELECT blob_id, unnest(regexp_extract_all(t, '{p}')) AS value, unnest(list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x))) AS gap, unnest(range(len(regexp_split_to_array(t, '{p}')))) AS i FROM d)
SELECT blob_id, CAST(sum(gap + coalesce(length(value), 0)) OVER (PARTITION BY blob_id ORDER BY i) - length(value) AS BIGINT) AS "offset", value FROM m QUALIFY value IS NOT NULL"""


@register("ascii_strings", HITS_SQL.format(p="[\\x20-\\x7E]{4,}"))
def ascii_strings(spark, sf_dir):
    return strings.pattern_hits(blobs(spark, sf_dir), "[\\x20-\\x7E]{4,}")


@register("regex_search", HITS_SQL.format(p="[0-9]+"))
def regex_search(spark, sf_dir):
    return strings.pattern_hits(blobs(spark, sf_dir), "[0-9]+")


@register(
    "format_size",
    """SELECT l_orderkey, l_linenumber, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f', round(n / 1024.0::DOUBLE, 1)) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', round(n / 1048576.0::DOUBLE, 1)) || ' MB'
    ELSE printf('%.1f', round(n / 1073741824.0::DOUBLE, 1)) || ' GB' END AS size FROM (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * l_partkey * l_linenumber AS BIGINT) AS n FROM lineitem)""",
)
def format_size(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * F.col("l_partkey") * F.col("l_linenumber")).cast("long").alias("n"))
    return rows.select("l_orderkey", "l_linenumber", strings.format_size(F.col("n")).alias("size"))


@register("entropy_ramp", f"WITH {STATS} SELECT blob_id, substr('{strings.RAMP}', CAST(least(floor(round(ent, 6) / 8 * {len(strings.RAMP)}), {len(strings.RAMP) - 1}) AS INT) + 1, 1) AS ramp FROM s")
def entropy_ramp(spark, sf_dir):
    rows = bytestats.with_counts(blobs(spark, sf_dir))
    return rows.select("blob_id", strings.entropy_ramp(F.round(bytestats.entropy(F.col("counts"), F.col("n")), 6)).alias("ramp"))


@register("method_spec", "SELECT p_partkey, lower(rtrim(x, '+')) AS name, ends_with(x, '+') AS optimize FROM (SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '' END AS x FROM part)")
def method_spec(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "+").otherwise("")).alias("x"))
    name, optimize = strings.method_spec(F.col("x"))
    return rows.select("p_partkey", name.alias("name"), optimize.alias("optimize"))


@register(
    "decode_timestamps",
    "SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS unix, epoch_us(o_orderdate) // 1000000 - 11644473600 AS file_time, epoch_us(o_orderdate) // 1000000 - 2082844800 AS hfs, (epoch_us(o_orderdate) // 1000000) // 86400 * 86400 - 2209161600 AS ole_days FROM orders",
)
def decode_timestamps(spark, sf_dir):
    """Order times in seconds, read in several encodings, and given back as seconds of the Unix epoch."""
    value = F.unix_timestamp("o_orderdate")
    found = strings.timestamps(value)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.unix_seconds(found[k]).alias(k) for k in ("unix", "file_time", "hfs", "ole_days")])


@register("delta_encode", f"WITH {BYTES} SELECT blob_id, pos, CAST((byte - coalesce(lag(byte, 2) OVER (PARTITION BY blob_id ORDER BY pos), 0) + 256) % 256 AS INT) AS delta FROM b")
def delta_encode(spark, sf_dir):
    return windows.delta(blobs(spark, sf_dir), 2)


@register(
    "rle_runs",
    f"""WITH {BYTES}, c AS (SELECT *, CASE WHEN lag(byte) OVER w = byte THEN 0 ELSE 1 END AS ch FROM b WINDOW w AS (PARTITION BY blob_id ORDER BY pos)),
    r AS (SELECT blob_id, sum(ch) OVER (PARTITION BY blob_id ORDER BY pos) AS run FROM c), n AS (SELECT blob_id, run, count(*) AS n FROM r GROUP BY ALL)
    SELECT blob_id, CAST(sum(2 * ((n + 254) // 255)) AS BIGINT) AS rle_bytes FROM n GROUP BY blob_id""",
)
def rle_runs(spark, sf_dir):
    """Size of each blob as (count, value) pairs."""

    @kernels.kernel(pa.int64())
    def size(data: pa.Array) -> pa.Array:
        return kernels.each(data, lambda v: len(strings.rle_pairs(v.tobytes())), pa.int64())

    return blobs(spark, sf_dir).select("blob_id", size("data").alias("rle_bytes"))


@register(
    "cusum_peak",
    f"""WITH {window_sql("pos // 256")}, m AS (SELECT blob_id, "offset", CAST(round(round(entropy, 6) * 1000000) AS HUGEINT) AS e FROM win),
    wk AS (SELECT blob_id, "offset", count(*) OVER (PARTITION BY blob_id) AS n,
      abs(sum(e) OVER o * count(*) OVER (PARTITION BY blob_id) - sum(e) OVER (PARTITION BY blob_id) * count(*) OVER o) AS walk FROM m WINDOW o AS (PARTITION BY blob_id ORDER BY "offset")),
    f AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY walk DESC, "offset") AS r FROM wk)
    SELECT blob_id, "offset", CAST(walk AS DOUBLE) / n / 1e6 AS peak FROM f WHERE r = 1""",
)
def cusum_peak(spark, sf_dir):
    return segmentation.cusum_peak(_rounded(windows.entropy_tumbling(blobs(spark, sf_dir)), entropy=6))


@register(
    "repeated_patterns",
    """WITH d AS (SELECT doc_id AS blob_id, encode(text) AS x, strlen(text) AS z FROM documents), l AS (SELECT unnest([15, 16, 17]) AS n),
    g AS (SELECT blob_id, l.n AS len, unnest(list_transform(range(z - l.n + 1), lambda i: hex(x[i + 1 : i + l.n]))) AS pattern FROM d, l WHERE z // 4 >= l.n),
    c AS (SELECT blob_id, len, pattern, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 4 AND pattern <> repeat(left(pattern, 2), len)),
    o AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY n DESC, len DESC, pattern) AS k FROM c),
    u AS (SELECT blob_id, unnest(list_transform(range(o.len - l.n + 1), lambda i: substr(pattern, 2 * i + 1, 2 * l.n))) AS sub, k FROM o JOIN l ON l.n < o.len),
    e AS (SELECT blob_id, sub, min(k) AS first FROM u GROUP BY ALL), s AS (SELECT o.* FROM o LEFT JOIN e ON e.blob_id = o.blob_id AND e.sub = o.pattern WHERE first IS NULL OR first > k),
    r AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY k) AS place FROM s) SELECT blob_id, pattern, n FROM r WHERE place <= 100""",
)
def repeated_patterns(spark, sf_dir):
    """Lengths 15 to 17, so that the SQL, which knows no way around comparing all patterns of a text, ends."""
    return segmentation.repeated_patterns(blobs(spark, sf_dir), (15, 17), 4)


@register(
    "alignment",
    f"""WITH {BYTES}, w AS (SELECT blob_id, pos, byte <> 32 AS own, count(*) OVER (PARTITION BY blob_id) AS z,
      sum(CAST(byte = 32 AS INT)) OVER (PARTITION BY blob_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS near FROM b),
    e AS (SELECT blob_id, a, own, near FROM w JOIN (SELECT unnest([4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) AS a) ON pos > 0 AND pos % a = 0 WHERE z >= 16),
    s AS (SELECT blob_id, a, count(*) FILTER ((near >= 1 AND own) OR near >= 2) AS padded, count(*) AS total FROM e GROUP BY ALL)
    SELECT blob_id, CAST(a AS INT) AS alignment, padded, total, least(1.0::DOUBLE, padded / total + CASE WHEN a IN (4, 8, 16, 512, 4096) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS confidence
    FROM s WHERE padded >= 2 AND padded / total > 0.05""",
)
def alignment(spark, sf_dir):
    """Texts whose spaces are zero bytes."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.encode(F.replace("text", F.lit(" "), F.lit("\0")), "UTF-8").alias("data"))
    return segmentation.alignment(rows)


@register(
    "success_rule",
    f"""WITH {MIXED_SQL}, sig(magic, "offset", confidence) AS (VALUES {', '.join(f"('{m.upper()}', {o}, {c}::DOUBLE)" for _, m, o, c, *_ in S.SIGNATURES)}),
    marked AS (SELECT DISTINCT blob_id FROM m JOIN sig ON confidence >= 0.8 WHERE len(list_filter(range("offset", 32), lambda i: i + length(magic) // 2 <= 32 AND substr(hx, 2 * i + 1, length(magic)) = magic)) > 0 AND length(hx) >= 16),
    x AS (SELECT a.blob_id, a.total AS n_in, a.ent AS e_in, a.text AS t_in, b.total AS n_out, b.ent AS e_out, b.text AS t_out, b.blob_id IN (SELECT blob_id FROM marked) AS known FROM s AS a JOIN s AS b ON b.blob_id = a.blob_id + 1)
    SELECT blob_id, CASE WHEN n_out = 0 OR n_out > n_in * 100 THEN FALSE WHEN e_in - e_out >= 0.5 AND n_out >= n_in THEN TRUE WHEN n_out > n_in * 1.2 AND e_in - e_out > 0.3 THEN TRUE
      WHEN t_out AND NOT t_in THEN TRUE WHEN known THEN TRUE ELSE FALSE END AS success FROM x""",
)
def success_rule(spark, sf_dir):
    """The next blob stands for the output of a decoder: texts behind digests, pictures behind texts, digests behind pictures."""
    rows = mixed_blobs(spark, sf_dir)
    other = rows.select((F.col("blob_id") - 1).alias("blob_id"), F.col("data").alias("output"))
    return rows.join(other, "blob_id").select("blob_id", trial.success("data", "output").alias("success"))


@register(
    "format_suggest",
    """WITH t AS (SELECT source, sum(n_chars) * 1000 AS total FROM documents GROUP BY source), s AS (SELECT source, unnest([
      {'format': 'Zip', 'score': 80 + CASE WHEN total < 104857600 THEN 5 ELSE 0 END}, {'format': 'SevenZip', 'score': 65 + CASE WHEN total > 10485760 THEN 15 ELSE 0 END}, {'format': 'TarGz', 'score': 55 + CASE WHEN contains(source, 'e') THEN 5 ELSE 0 END},
      {'format': 'TarXz', 'score': 50 + CASE WHEN total > 52428800 THEN 10 ELSE 0 END}, {'format': 'TarZst', 'score': 50 + CASE WHEN total > 104857600 THEN 10 ELSE 0 END}]) AS x FROM t)
    SELECT source, x.format AS format, CAST(x.score AS INT) AS score FROM s""",
)
def format_suggest(spark, sf_dir):
    """Sources with an e in their name stand for inputs with folders."""
    totals = table(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars") * 1000).alias("total"))
    rows = totals.select("source", F.explode(relational.suggest(F.col("total"), "any", F.lit(False), F.contains("source", F.lit("e")))).alias("x"))
    return rows.select("source", "x.format", "x.score")


@register("fingerprints")
def fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(blobs(spark, sf_dir))


@register(
    "fingerprint_rules",
    """WITH d AS (SELECT doc_id AS blob_id, encode(CASE doc_id % 4 WHEN 0 THEN translate(text, 'etaoinsrhldc ', array_to_string(list_transform([1, 2, 3, 1, 2, 1, 3, 1, 2, 1, 1, 2, 1], lambda x: chr(x)), '')) WHEN 1 THEN regexp_replace(text, '(.)', '\\1\\1\\1', 'g')
      WHEN 2 THEN array_to_string(list_transform([6, 2, 3, 3, 4, 5, 9], lambda x: chr(x)), '') || text ELSE text END) AS x FROM documents),
    b AS MATERIALIZED (SELECT blob_id, unnest(list_transform(regexp_extract_all(hex(x), '..'), lambda c: ('0x' || c)::INT)) AS byte, unnest(range(octet_length(x))) AS pos FROM d),
    h AS (SELECT blob_id, byte, count(*) AS n FROM b GROUP BY ALL),
    s AS (SELECT blob_id, sum(n) AS z, sum(n) FILTER (byte < 4) AS low, coalesce(sum(n) FILTER (byte >= 128), 0) AS high, coalesce(max(n) FILTER (byte = 0), 0) AS n0, coalesce(max(n) FILTER (byte = 1), 0) AS n1,
      coalesce(max(n) FILTER (byte = 2), 0) AS n2, coalesce(max(n) FILTER (byte = 3), 0) AS n3 FROM h GROUP BY blob_id),
    e AS (SELECT blob_id, round(-sum(n / z * log2(n / z)), 6) AS ent FROM h JOIN s USING (blob_id) GROUP BY blob_id),
    r AS (SELECT blob_id, count(*) FILTER (ch) AS runs FROM (SELECT blob_id, byte IS DISTINCT FROM lag(byte) OVER (PARTITION BY blob_id ORDER BY pos) AS ch FROM b) GROUP BY blob_id),
    f AS (SELECT blob_id, w, count(*) AS k, count(*) FILTER (bit_count(byte) BETWEEN 2 AND 6) / count(*) AS share FROM b JOIN s USING (blob_id), (VALUES (9), (17)) AS v(w) WHERE pos % w = 0 AND pos < z - w GROUP BY ALL),
    l AS (SELECT blob_id, max(CASE WHEN k >= 3 THEN share ELSE 0 END) AS flags FROM f GROUP BY blob_id),
    u AS (SELECT blob_id, count(*) FILTER (byte BETWEEN 1 AND 20) / count(*) AS fits, count(DISTINCT byte) FILTER (byte BETWEEN 1 AND 20) AS lengths FROM b JOIN (SELECT blob_id, byte AS first FROM b WHERE pos = 0 AND byte > 0) USING (blob_id) WHERE pos BETWEEN 1 AND first GROUP BY blob_id),
    a AS (SELECT *, coalesce(low, 0) / z AS lo, (2 * z - runs) / runs AS mr FROM s JOIN e USING (blob_id) JOIN r USING (blob_id) LEFT JOIN l USING (blob_id) LEFT JOIN u USING (blob_id)),
    c AS (SELECT blob_id, CASE WHEN ent < 4 THEN 'Plaintext' WHEN ent < 6 THEN 'Structured' WHEN ent < 7.5 THEN 'Dictionary-Compressed' WHEN ent < 7.95 THEN 'Strong-Compression' ELSE 'Encrypted/Random' END AS algorithm,
        CASE WHEN ent < 4 THEN 0.7 WHEN ent < 6 THEN 0.5 WHEN ent < 7.5 THEN 0.6 WHEN ent < 7.95 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM a WHERE z >= 16
      UNION ALL SELECT blob_id, 'MTF', least(0.85, 0.3 + CASE WHEN lo > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN lo > 0.7 THEN 0.1 ELSE 0 END + CASE WHEN n0 > n1 AND n1 > n2 AND n2 > n3 THEN 0.15 ELSE 0 END + CASE WHEN high / z < 0.1 THEN 0.1 ELSE 0 END)::DOUBLE FROM a WHERE z >= 16 AND lo >= 0.3
      UNION ALL SELECT blob_id, 'BWT', least(0.75, 0.3 + CASE WHEN mr > 3 THEN 0.15 ELSE 0 END + CASE WHEN mr > 5 THEN 0.1 ELSE 0 END + CASE WHEN ent > 3 AND ent < 7.5 THEN 0.1 ELSE 0 END + CASE WHEN runs < z // 2 THEN 0.1 ELSE 0 END)::DOUBLE FROM a WHERE z >= 32 AND mr >= 2
      UNION ALL SELECT blob_id, 'LZ/LZSS', least(0.7::DOUBLE, 0.3 + flags * 0.4) FROM a WHERE z >= 18 AND flags >= 0.5
      UNION ALL SELECT blob_id, 'Huffman', least(0.7::DOUBLE, 0.3 + fits * 0.3 + CASE WHEN lengths >= 3 THEN 0.1 ELSE 0 END) FROM a WHERE z >= 8 AND fits >= 0.7 AND lengths BETWEEN 2 AND 15)
    SELECT blob_id, algorithm, round(confidence, 6) AS confidence FROM c WHERE NOT (algorithm = 'MTF' AND confidence < 0.5) AND NOT (algorithm = 'BWT' AND confidence < 0.4)""",
)
def fingerprint_rules(spark, sf_dir):
    """Five rules, over texts of four makes by number: letters that are low bytes, tripled letters, a table of lengths in front, and as they are."""
    kind, text = F.pmod("doc_id", F.lit(4)), F.col("text")
    made = (
        F.when(kind == 0, F.translate("text", "etaoinsrhldc ", "\1\2\3\1\2\1\3\1\2\1\1\2\1"))
        .when(kind == 1, F.regexp_replace("text", "([^\n])", "$1$1$1"))
        .when(kind == 2, F.concat(F.lit("\6\2\3\3\4\5\t"), text))
        .otherwise(text)
    )
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), F.encode(made, "UTF-8").alias("data"))
    found = fingerprint.fingerprints(rows).where(~F.col("algorithm").isin("Deflate", "RLE", "LZW", "Arithmetic"))
    return found.select("blob_id", "algorithm", F.round("confidence", 6).alias("confidence"))


@register(
    "fingerprint_deflate",
    """WITH d AS (SELECT doc_id AS blob_id, octet_length(encode(text)) AS n, list_transform(regexp_extract_all(hex(encode(text)[1:5]), '..'), lambda x: ('0x' || x)::INT) AS b FROM documents),
    k AS (SELECT *, (b[1] >> 1) & 3 AS kind, b[1] + b[2] * 256 + b[3] * 65536 AS w FROM d WHERE n >= 3)
    SELECT blob_id, CASE WHEN kind = 0 THEN 0.85::DOUBLE WHEN kind = 1 THEN 0.55::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM k
    WHERE (kind = 0 AND n >= 5 AND xor(b[2] + b[3] * 256, b[4] + b[5] * 256) = 65535) OR kind = 1 OR (kind = 2 AND n >= 4 AND ((w >> 3) & 31) <= 29 AND ((w >> 8) & 31) <= 29)""",
)
def fingerprint_deflate(spark, sf_dir):
    return fingerprint.fingerprints(blobs(spark, sf_dir)).where("algorithm = 'Deflate'").select("blob_id", "confidence")


@register(
    "fingerprint_rle",
    f"""WITH {BYTES}, p AS (SELECT blob_id, count(*) FILTER (pos % 2 = 0 AND byte BETWEEN 1 AND 127 AND pos + 1 < z) AS low, any_value(z) // 2 AS pairs, any_value(z) AS z, count(DISTINCT byte) FILTER (pos % 2 = 1) AS odd
      FROM b JOIN (SELECT blob_id, count(*) AS z FROM b GROUP BY blob_id) USING (blob_id) GROUP BY blob_id), c AS (SELECT blob_id, z, low / pairs AS r, least(0.85::DOUBLE, 0.3::DOUBLE + low / pairs * 0.4::DOUBLE + (1 - odd / 256.0::DOUBLE) * 0.15::DOUBLE) AS conf FROM p WHERE z >= 4)
    SELECT blob_id, round(conf, 6) AS confidence FROM c WHERE r >= 0.4 AND conf >= 0.4""",
)
def fingerprint_rle(spark, sf_dir):
    rows = fingerprint.fingerprints(blobs(spark, sf_dir)).where("algorithm = 'RLE'")
    return rows.select("blob_id", F.round("confidence", 6).alias("confidence"))


@register("boundaries")
def boundaries(spark, sf_dir):
    return segmentation.boundaries(blobs(spark, sf_dir))


@register("field_length")
def field_length(spark, sf_dir):
    return segmentation.field_length(blobs(spark, sf_dir))


@register("semi_structured_rollup", f"WITH {STATS} SELECT source, {ladders.ladder_sql('round(ent, 6)', ladders.REGION)} AS class, count(*) AS n FROM s JOIN documents ON doc_id = blob_id GROUP BY CUBE (source, class)")
def semi_structured_rollup(spark, sf_dir):
    rows = bytestats.classes(bytestats.with_counts(blobs(spark, sf_dir)))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), "source")
    return rows.join(documents, "blob_id").cube("source", "class").agg(F.count("*").alias("n"))
