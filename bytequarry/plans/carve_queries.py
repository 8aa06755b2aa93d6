"""Queries of carving."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.operators import carve
from bytequarry.plans.catalogue import register
from bytequarry.plans.window_queries import pages
from bytequarry.session import table
from bytequarry.sources import signatures


@register("carve_files")
def carve_files(spark, sf_dir):
    """Payloads in web pages that have magics in front of them."""
    return carve.carve(pages(spark, sf_dir), signatures.signatures(spark))


@register(
    "payload_length",
    """WITH p AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS n FROM pages)
    SELECT page_id, 'Gif' AS format, CASE WHEN contains(html, ';') THEN 6 + strlen(left(html, instr(html, ';'))) END::BIGINT AS length FROM p
    UNION ALL SELECT page_id, 'Pdf', 5 + n + 5 + 2 FROM p
    UNION ALL SELECT page_id, 'Riff', least(8 + n, 8 + page_id % 700) FROM p
    UNION ALL SELECT page_id, 'Bmp', CASE WHEN 10 + page_id % 900 BETWEEN 14 AND 6 + n THEN 10 + page_id % 900 END FROM p
    UNION ALL SELECT page_id, 'Zip', 4 + n + least(25, 22 + page_id % 7) FROM p
    UNION ALL SELECT page_id, 'Gzip', 3 + n FROM p
    UNION ALL SELECT page_id, 'Png', 8 + 12 + n + 12 FROM p
    UNION ALL SELECT page_id, 'Jpeg', 3 + n + 2 FROM p
    UNION ALL SELECT page_id, 'Bzip2', 4 + n + 6 + 4 FROM p
    UNION ALL SELECT page_id, 'Mp4', 12 + 8 + n FROM p
    UNION ALL SELECT page_id, 'Nothing', NULL FROM p""",
)
def payload_length(spark, sf_dir):
    """Payloads of several formats made around each page, some with other bytes behind them."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("h"))
    n, hexed = F.octet_length("h"), lambda x: F.unhex(F.lit(x))
    number = lambda value, order: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in order]))
    big, little = (3, 2, 1, 0), (0, 1, 2, 3)
    text = lambda x: F.lit(x).cast("binary")
    made = {
        "Gif": (text("GIF89a"), F.col("h")),
        "Pdf": (text("%PDF-"), F.col("h"), text("%%EOF\r\n"), text("tail")),
        "Riff": (text("RIFF"), number(F.col("page_id") % 700, little), F.col("h")),
        "Bmp": (text("BM"), number(10 + F.col("page_id") % 900, little), F.col("h")),
        "Zip": (hexed("504b0304"), F.col("h"), hexed("504b0506" + "00" * 16), F.substring(number(F.col("page_id") % 7, little), 1, 2), text("xyz")),
        "Gzip": (hexed("1f8b08"), F.col("h"), hexed("1f8b0800")),
        "Png": (hexed("89504e470d0a1a0a"), number(n, big), text("tEXt"), F.col("h"), hexed("00000000"), hexed("00000000"), text("IEND"), hexed("ae426082"), text("tail")),
        "Jpeg": (hexed("ffd8ff"), F.col("h"), hexed("ffd9"), text("tail")),
        "Bzip2": (text("BZh9"), F.col("h"), hexed("177245385090"), text("crc.more")),
        "Mp4": (number(F.lit(12), big), text("ftypisom"), number(n + 8, big), text("mdat"), F.col("h"), hexed("00000003"), text("none")),
        "Nothing": (F.col("h"),),
    }
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.concat(*parts).alias("data")) for f, parts in made.items()])).alias("x")
    return rows.select("page_id", each).select("page_id", "x.format", carve.probed_length("x.data", "x.format").alias("length"))
