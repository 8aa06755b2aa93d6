"""Relational operators over blobs, entries and runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extension families of solid blocks, by group number.
EXTENSION_GROUPS = {
    0: ".cs .java .c .cpp .h .hpp .py .js .ts .go .rs .rb .swift .kt .scala .lua .pl .r .m .mm .f .f90 .asm .s",
    1: ".xml .html .htm .xhtml .svg .xaml .csproj .sln .slnx .props .targets .json .yaml .yml .toml .ini .cfg .conf .properties",
    2: ".txt .md .rst .tex .csv .tsv .log .rtf",
    3: ".exe .dll .so .dylib .sys .obj .o .lib .a .pdb .elf .bin .wasm",
    4: ".jpg .jpeg .png .gif .webp .bmp .ico .tif .tiff",
    5: ".mp3 .mp4 .avi .mkv .wav .flac .aac .ogg .m4a .webm .mov .wmv",
    6: ".zip .rar .7z .gz .bz2 .xz .zst .lz4 .br .lzma .tar",
    7: ".db .sqlite .mdb .dat .idx",
}
OTHER_GROUP, INCOMPRESSIBLE_GROUP = -1, -2


def extension(name: Column) -> Column:
    """The last extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))


def slice_bytes(data: Column, offset: int, length: int) -> Column:
    return F.substring(data, offset + 1, length)


def name_matches(name: Column, wanted: str) -> Column:
    """Equal whatever the case, or equal to the path's end behind a slash, or to its last part."""
    low, want = F.lower(name), wanted.lower()
    return (low == want) | F.endswith(low, F.lit("/" + want)) | (F.regexp_extract(low, r"([^/]*)$", 1) == want)


def solid_group(name: Column, incompressible: Column) -> Column:
    """The group of the name's extension; -1 for other names, -2 for incompressible entries."""
    out = F.when(incompressible, F.lit(INCOMPRESSIBLE_GROUP))
    ext = extension(name)
    for group, names in EXTENSION_GROUPS.items():
        out = out.when(ext.isin(names.split()), F.lit(group))
    return out.otherwise(F.lit(OTHER_GROUP))


def solid_blocks(entries: DataFrame, max_bytes: int, group_col: str = "group", size_col: str = "size", order_col: str = "seq") -> DataFrame:
    """Adds ``block``: entries of a group fill blocks in order; one is closed when the next entry would exceed ``max_bytes``.

    The fill depends on all entries before it, so a group is packed in order by
    one reader; rows stream through it in Arrow batches, none is held.
    """
    schema = entries.schema.simpleString()[7:-1] + ",block:int"
    columns = entries.columns
    g, s = columns.index(group_col), columns.index(size_col)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, block, held = None, 0, 0
        for batch in batches:
            out = []
            for key, size in zip(batch.iloc[:, g], batch.iloc[:, s]):
                if key != group:
                    group, block, held = key, 0, 0
                elif held + size > max_bytes:
                    block, held = block + 1, 0
                held += size
                out.append(block)
            yield batch.assign(block=pd.array(out, "int32"))

    return entries.repartition(group_col).sortWithinPartitions(group_col, order_col).mapInPandas(pack, schema)


def common_ends(outputs: DataFrame, most: int = 64, run_col: str = "run", data_col: str = "data") -> DataFrame:
    """header, footer: hex of the longest common start and end of all outputs, of ``most`` bytes at most.

    Only the ends of the outputs leave the scan: ``most`` bytes of each.
    """
    ends = outputs.select(F.substring(data_col, 1, most).alias("head"), F.expr(f"right({data_col}, {int(most)})").alias("tail"))

    def agreed(column: str, at: str, name: str, order: Column) -> DataFrame:
        spots = ends.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("p"), F.col(column).alias("d"))
        byte = F.when(F.col("p") <= F.octet_length("d"), F.hex(F.expr(f"substring(d, {at}, 1)")))
        same = spots.select("p", byte.alias("b")).groupBy("p").agg(F.min("b").alias("x"), F.max("b").alias("y"), F.count("b").alias("m"), F.count("*").alias("runs"))
        run = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # ``most`` rows
        ok = same.withColumn("ok", F.min(((F.col("x") == F.col("y")) & (F.col("m") == F.col("runs"))).cast("int")).over(run)).where("ok = 1")
        return ok.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "x"))), lambda s: s["x"]), "").alias(name))

    return agreed("head", "p", "header", F.col("p")).join(agreed("tail", "-p", "footer", -F.col("p")))


def size_fields(runs: DataFrame, header: int = 32, in_col: str = "input", out_col: str = "output") -> DataFrame:
    """offset, width, endian: header fields that equal the input's size in every run; the widest of an offset is kept."""
    places = F.explode(F.sequence(F.lit(0), F.lit(header - 1))).alias("offset")
    rows = runs.select(F.octet_length(in_col).alias("size"), F.substring(out_col, 1, header).alias("head"), places)
    rows = rows.withColumn("width", F.explode(F.array(F.lit(4), F.lit(2)))).where(F.col("offset") + F.col("width") <= F.octet_length("head"))
    part = F.expr("substring(head, offset + 1, width)")
    value = F.conv(F.hex(part), 16, 10).cast("long")
    swapped = F.expr("aggregate(sequence(1, width), 0L, (s, i) -> s + cast(conv(hex(substring(head, offset + i, 1)), 16, 10) as long) * cast(pow(256, i - 1) as long))")
    rows = rows.select("offset", "width", "size", F.explode(F.array(F.struct(F.lit("BE").alias("endian"), value.alias("v")), F.struct(F.lit("LE").alias("endian"), swapped.alias("v")))).alias("f"))
    rows = rows.groupBy("offset", "width", F.col("f.endian").alias("endian")).agg(F.bool_and(F.col("f.v") == F.col("size")).alias("always")).where("always")
    rank = F.row_number().over(Window.partitionBy("offset", "endian").orderBy(F.desc("width")))
    return rows.withColumn("r", rank).where("r = 1").select("offset", "width", "endian")


def lookup(rows: DataFrame, table: DataFrame, name_col: str, key_col: str, *columns: str) -> DataFrame:
    """All of ``rows`` with columns of the table's row whose key is equal whatever the case; null if there is none. The table is small (names of formats, types, codecs) and broadcast."""
    known = table.select(F.lower(key_col).alias("__key"), *columns).dropDuplicates(["__key"])
    return rows.join(F.broadcast(known), F.lower(name_col) == F.col("__key"), "left").drop("__key")


def suggest(total: Column, platform: str, single: Column, folders: Column | None = None) -> Column:
    """Scores of archive formats for inputs of ``total`` bytes, as an array of (format, score).

    ``single`` tells of one input file, ``folders`` of a folder among the inputs.
    """
    folders = F.lit(False) if folders is None else folders
    mib = 1024 * 1024
    add = lambda when, x: F.when(when, x).otherwise(0)
    on = lambda *names: F.lit(platform in names)
    items = [
        ("Zip", 70 + add(on("cross", "any"), 10) + add(total < 100 * mib, 5)),
        ("SevenZip", 65 + add(total > 10 * mib, 15) + add(on("windows"), 5)),
        ("TarGz", 55 + add(on("linux"), 25) + add(folders, 5)),
        ("TarXz", 50 + add(on("linux"), 20) + add(total > 50 * mib, 10)),
        ("TarZst", 50 + add(total > 100 * mib, 10)),
        ("Gzip", F.when(single & ~folders, 60)),
        ("Zstd", F.when(single & ~folders, 55)),
    ]
    scored = F.array(*[F.struct(F.lit(name).alias("format"), score.cast("int").alias("score")) for name, score in items])
    return F.filter(scored, lambda s: s["score"].isNotNull())
