"""Shared definitions of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash draws use 13 hexadecimal digits, so every draw is exact in a double.
DRAW_DIGITS = 13
DRAW_RANGE = float(16**DRAW_DIGITS)
#: Stands for a null id wherever ids are hashed.
NULL_ID = "\\N"


def id_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_ID))


def draw(*parts: Column | str) -> Column:
    """A uniform integer in [0, 16^13) as a double, decided by the text of ``parts``."""
    texts = [F.lit(p) if isinstance(p, str) else p for p in parts]
    digits = F.substring(F.md5(F.concat(*texts).cast("binary")), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double")


#: Rows that a Python worker turns into objects at a time, and that travel to it at a time.
SLICE_ROWS, BATCH_ROWS = 500, 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(rows: DataFrame) -> DataFrame:
    """``rows``, whose texts go to Python workers in batches of BATCH_ROWS at most.

    Spark's own 10,000 rows are many megabytes of text, held on both sides at
    once. The setting is the session's, and stays: plans read it when they run.
    """
    spark = rows.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return rows


def give_back() -> None:
    """Returns memory that a task has freed to the system, which the workers of later stages share with this one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones; memory of the last ones is given back at the end of the task."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
    give_back()


def training_texts(picked: DataFrame, rows: DataFrame, most_bytes: int, *extra: str) -> list[tuple]:
    """(id, text, *extra) of the rows that ``picked`` names, in the order of the draw.

    ``rows`` has __id, __text, __hash (of the text) and ``extra``; ``picked`` has
    __h, __id, __hash and __bytes of a bounded number of them. Rows are named by id
    and text, so a repeated id brings no more texts than were picked; equal rows
    come once. Texts that would take the sum of bytes above ``most_bytes`` are
    left out.
    """
    names, left = [], most_bytes
    for row in sorted(picked.distinct().collect()):
        if row["__bytes"] <= left:
            names.append((row["__id"], row["__hash"]))
            left -= row["__bytes"]
    if not names:
        return []
    named = picked.sparkSession.createDataFrame(names, "__id string, __hash long")
    texts = rows.join(F.broadcast(named), ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash", *extra])
    place = {name: i for i, name in enumerate(names)}
    found = sorted(texts.collect(), key=lambda r: (place[r["__id"], r["__hash"]], *(r[x] for x in extra)))
    return [(r["__id"], r["__text"], *(r[x] for x in extra)) for r in found]
