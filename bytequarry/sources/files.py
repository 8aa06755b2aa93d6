"""Files as blobs, and sinks for what is found in them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.operators import relational
from bytequarry.sources import archives


def scan_directory(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """blob_id (of the path), path, ext, size, modified, data: the files of a folder that match a pattern.

    Sizes are filtered before contents are read. The source is Spark's own, so it
    reads whatever file system the session knows; a file is one row, of 2 GiB at most.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(folder)
    if max_bytes is not None:
        rows = rows.where(F.col("length") <= max_bytes)
    return rows.select(
        F.xxhash64("path").alias("blob_id"), "path", relational.extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("data")
    )


def entry_by_path(blobs: DataFrame, wanted: str, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Entries of the archives whose name is the wanted one, whatever its case, or ends in it behind a slash."""
    rows = archives.archive_entries(blobs, id_col, data_col)
    return rows.where(F.col("error").isNull() & relational.name_matches(F.col("name"), wanted))


def write_strings(found: DataFrame, folder: str) -> None:
    """Text files of lines ``0xOFFSET ENCODING value`` (id, encoding, offset, value of strings), by id and offset within a file."""
    line = F.format_string("0x%08X %-8s %s", "offset", "encoding", "value")
    found.sortWithinPartitions("blob_id", "offset").select(line.alias("value")).write.text(folder)


def write_carved(carved: DataFrame, blobs: DataFrame, folder: str, extensions: dict[str, str], id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """Writes each carved payload as ``ID/offset_0xOFFSET.ext`` and returns id, file, bytes, as a table of what was written.

    A blob's spans are brought together first (they are small), so that its bytes
    travel once. Names follow from the spans, so a task that runs again writes the
    same files again. The files are written while the result is computed.
    ``folder`` is a URI of a file system that Arrow knows.
    """
    kind = blobs.schema[id_col].dataType.simpleString()
    spans = carved.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("offset", "length", "format"))).alias("spans"))
    rows = blobs.select(id_col, F.col(data_col).alias("data")).join(spans, id_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            ids, names, sizes = [], [], []
            for key, data, found in zip(*(batch.column(i) for i in range(3))):
                place = f"{path}/{key.as_py()}"
                system.create_dir(place, recursive=True)
                for span in found.as_py():
                    name = f"offset_0x{span['offset']:08X}{extensions.get(span['format'], '.bin')}"
                    part = data.as_buffer()[span["offset"] : span["offset"] + span["length"]]
                    with system.open_output_stream(f"{place}/{name}", compression=None) as out:
                        out.write(part)
                    ids.append(key.as_py())
                    names.append(f"{key.as_py()}/{name}")
                    sizes.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], [id_col, "file", "bytes"])

    return rows.mapInArrow(write, f"{id_col} {kind}, file string, bytes long")
