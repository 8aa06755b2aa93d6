"""Archives as tables: entries of zip, tar and compressed streams, recursive extraction, and writing."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions import kernels
from bytequarry.functions.codecs import DECODERS

ENTRY = "entry_index int, name string, size long, packed_size long, method string, is_dir boolean, is_encrypted boolean, content binary, error string"
#: Largest entry that is brought out.
ENTRY_BYTES = 256 << 20
#: Contents of one volume of a written archive.
ARCHIVE_BYTES = 64 << 20
# Magics of compressed streams and the decoder of each.
STREAMS = {b"\x1f\x8b\x08": "Gzip", b"BZh": "Bzip2", b"\xfd7zXZ\x00": "Xz"}
METHODS = {0: "Store", 8: "Deflate", 12: "Bzip2", 14: "Lzma"}


def entries_of(data: bytes) -> Iterator[tuple]:
    """(index, name, size, packed size, method, is directory, is encrypted, content) of each entry; nothing for other blobs.

    Entries above ENTRY_BYTES and encrypted ones have no content.
    """
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for i, e in enumerate(archive.infolist()):
                locked = bool(e.flag_bits & 1)
                content = None if e.is_dir() or locked or e.file_size > ENTRY_BYTES else archive.read(e)
                yield i, e.filename, e.file_size, e.compress_size, METHODS.get(e.compress_type, str(e.compress_type)), e.is_dir(), locked, content
    elif data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as archive:
            for i, e in enumerate(archive):
                file = archive.extractfile(e) if e.isfile() and e.size <= ENTRY_BYTES else None
                yield i, e.name, e.size, e.size, "Store", e.isdir(), False, file.read() if file else None
    else:
        for magic, name in STREAMS.items():
            if data.startswith(magic):
                content = DECODERS[name](data, ENTRY_BYTES)
                yield 0, "data", len(content), len(data), name, False, False, content


def archive_entries(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id and the columns of ENTRY, a row an entry.

    A damaged archive gives the entries before the damage and a row with an
    ``error`` and nothing else; an entry that is left out for its size has one, too.
    """
    kind = blobs.schema[id_col].dataType.simpleString()
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary(), pa.string()]
    names = [c.split(" ")[0] for c in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                rows = []
                try:
                    for row in entries_of(data.as_py() or b""):
                        rows.append((*row, f"larger than {ENTRY_BYTES} bytes" if row[7] is None and row[2] > ENTRY_BYTES else None))
                except Exception as problem:  # damaged in any way: what came before is kept
                    rows.append((*[None] * 8, f"{type(problem).__name__}: {problem}"))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), batch.column(0).type), *columns], [id_col, *names])

    return blobs.select(id_col, data_col).mapInArrow(run, f"{id_col} {kind}, {ENTRY}")


def recursive_extract(blobs: DataFrame, depth: int = 10, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, depth, path, size, sha256 of all entries, those of nested archives too: a level at a time, until none is left."""
    from bytequarry.session import materialize

    level = blobs.select(id_col, F.lit("").alias("path"), F.col(data_col).alias("data"))
    out = None
    for d in range(1, depth + 1):
        tagged = level.select(F.struct(id_col, "path").alias("k"), "data").withColumn("k", F.to_json("k"))
        found = archive_entries(tagged, "k", "data").where("content is not null")
        key = F.from_json("k", f"{id_col} {blobs.schema[id_col].dataType.simpleString()}, path string")
        found = found.select(key.alias("k"), "name", "content").select(f"k.{id_col}", F.concat_ws("/", F.nullif("k.path", F.lit("")), "name").alias("path"), F.col("content").alias("data"))
        level = materialize(found, f"level-{d}")
        if not level.limit(1).count():
            break
        rows = level.select(id_col, F.lit(d).alias("depth"), "path", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha256"))
        out = rows if out is None else out.unionByName(rows)
    empty = blobs.limit(0).select(id_col, F.lit(0).alias("depth"), F.lit("").alias("path"), F.lit(0).cast("long").alias("size"), F.lit("").alias("sha256"))
    return empty if out is None else out


def create_zip(names: list[str], contents: list[bytes]) -> bytes:
    """An archive with fixed dates, so equal entries give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in zip(names, contents):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
    return out.getvalue()


def create_tar(names: list[str], contents: list[bytes]) -> bytes:
    """An archive without dates and owners, so equal entries give equal bytes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as archive:
        for name, content in zip(names, contents):
            entry = tarfile.TarInfo(name)
            entry.size = len(content or b"")
            archive.addfile(entry, io.BytesIO(content or b""))
    return out.getvalue()


@kernels.kernel(pa.binary())
def zipped(blobs: pa.Array) -> pa.Array:
    """A column function: a zip of each blob as its only entry."""
    return pa.array([None if b.as_py() is None else create_zip(["data"], [b.as_py()]) for b in blobs], pa.binary())


@kernels.kernel(pa.binary())
def tarred(blobs: pa.Array) -> pa.Array:
    """A column function: a tar of each blob as its only entry."""
    return pa.array([None if b.as_py() is None else create_tar(["data"], [b.as_py()]) for b in blobs], pa.binary())


def create_archives(entries: DataFrame, group_col: str, name_col: str = "name", data_col: str = "data", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """group, volume, archive: the entries of each group as zips, in the order of their names.

    A group whose contents are larger than ``archive_bytes`` goes to several
    volumes, cut between names, each made by a task of its own; an entry larger
    than that has a volume to itself. Repeated names stay in one volume's order.
    """
    kind = entries.schema[group_col].dataType.simpleString()
    rows = entries.select(F.col(group_col).alias("__group"), F.col(name_col).alias("__name"), F.col(data_col).alias("__data"))
    # To lay out the volumes a task sees the names and sizes of a group, never contents.
    sizes = entries.select(F.col(group_col).alias("__g"), F.col(name_col).alias("__n"), F.octet_length(data_col).cast("long").alias("__size")).groupBy("__g", "__n").agg(F.sum("__size").alias("__size"))
    upto = Window.partitionBy("__g").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    volumes = sizes.select("__g", "__n", F.floor((F.sum("__size").over(upto) - F.coalesce("__size", F.lit(0))) / archive_bytes).cast("int").alias("volume"))
    volumes = volumes.withColumn("volume", F.coalesce("volume", F.lit(0)))
    placed = rows.join(volumes, F.col("__group").eqNullSafe(F.col("__g")) & F.col("__name").eqNullSafe(F.col("__n")))
    placed = placed.select(F.col("__group").alias(group_col), "volume", "__name", "__data")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("__name")
        packed = create_zip(table.column("__name").to_pylist(), table.column("__data").to_pylist())
        return pa.table({group_col: table.column(group_col)[:1], "volume": table.column("volume")[:1], "archive": pa.array([packed], pa.binary())})

    return placed.groupBy(group_col, "volume").applyInArrow(build, f"{group_col} {kind}, volume int, archive binary")
