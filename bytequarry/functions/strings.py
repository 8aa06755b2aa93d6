"""Strings in blobs and small text functions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels

#: Characters of rising entropy.
RAMP = " .:-=+*#%@"


def latin1(data: str) -> Column:
    """Bytes as characters of the same numbers, so that places in the text are places in the bytes."""
    return F.decode(data, "ISO-8859-1")


def pattern_hits(blobs: DataFrame, pattern: str, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, offset, value: matches of a regular expression over the bytes, from left to right."""
    rows = blobs.select(id_col, F.explode(kernels.pattern_matches(pattern)(data_col)).alias("x"))
    return rows.select(id_col, "x.offset", "x.value")


def _wide(data: bytes, least: int, order: str) -> Iterator[tuple[int, int, str]]:
    """Printable runs of two-byte characters at even places."""
    v = np.frombuffer(data[: len(data) // 2 * 2], np.dtype("<u2" if order == "little" else ">u2"))
    fine = np.concatenate([[False], (v >= 0x20) & (v < 0x7F), [False]])
    edges = np.flatnonzero(fine[1:] != fine[:-1]).reshape(-1, 2)
    for a, b in edges[edges[:, 1] - edges[:, 0] >= least].tolist():
        yield 2 * a, 2 * (b - a), v[a:b].astype(np.uint8).tobytes().decode("ascii")


_UTF8 = (
    rb"[\t\n\r\x20-\x7e]|\xc2[\xa0-\xbf]|[\xc3-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def _bridged(data: bytes, least: int, gap: int) -> Iterator[tuple[int, int, str]]:
    """Runs of printable UTF-8 characters, over gaps of fewer than ``gap`` other bytes; a gap's bytes show as dots and are no characters."""
    run = re.compile(rb"(?:" + _UTF8 + rb")+", re.S)
    start = end = None
    text, count = "", 0
    for m in run.finditer(data):
        if start is not None and 0 < m.start() - end < gap and data[m.start()] >= 0x20:
            text += "." * (m.start() - end)
        else:
            if start is not None and count >= least:
                yield start, end - start, text
            start, text, count = m.start(), "", 0
        part = m[0].decode("utf-8")
        text, count, end = text + part, count + len(part), m.end()
    if start is not None and count >= least:
        yield start, end - start, text


#: Encodings of ``text_strings``, each a function of bytes, least length and gap.
ENCODINGS = {
    "ascii": lambda data, least, gap: ((m.start(), len(m[0]), m[0].decode("ascii")) for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)),
    "utf-16le": lambda data, least, gap: _wide(data, least, "little"),
    "utf-16be": lambda data, least, gap: _wide(data, least, "big"),
    "utf-8": _bridged,
}
_STRINGS = pa.list_(pa.struct([("encoding", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("value", pa.string())]))


def text_strings(blobs: DataFrame, least: int = 4, gap: int = 0, encodings: Sequence[str] = ("ascii", "utf-16le", "utf-16be", "utf-8"), id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, encoding, offset, length, value: runs of ``least`` printable characters or more.

    Two-byte characters stand at even places. UTF-8 runs take tabs and line ends
    along and may bridge gaps of fewer than ``gap`` other bytes. ``length`` is in
    bytes; values are whole. Null and empty blobs have none.
    """

    @kernels.kernel(_STRINGS)
    def found(blobs: pa.Array) -> pa.Array:
        rows, sizes, null = [], [], []
        for blob in blobs:
            data, before = blob.as_py(), len(rows)
            for name in encodings if data else ():
                rows += [(name, *x) for x in ENCODINGS[name](data, least, gap)]
            sizes.append(len(rows) - before)
            null.append(data is None)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.string(), pa.int64(), pa.int64(), pa.string()))]
        return kernels._lists(sizes, null, ("encoding", "offset", "length", "value"), columns)

    return blobs.select(id_col, F.explode(found(data_col)).alias("x")).select(id_col, "x.*")


def format_size(n: Column) -> Column:
    """Bytes, or kibi-, mebi- or gibibytes with one decimal."""
    scaled = lambda power: F.round(n / float(1024**power), 1)
    out = F.when(n < 1024, F.format_string("%d B", n))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", scaled(power)), F.lit(" " + unit)))
    return out.otherwise(F.concat(F.format_string("%.1f", scaled(3)), F.lit(" GB")))


def entropy_ramp(entropy: Column) -> Column:
    at = F.least(F.floor(entropy / 8.0 * len(RAMP)), F.lit(len(RAMP) - 1)).cast("int")
    return F.substring(F.lit(RAMP), at + 1, F.lit(1))


def method_spec(spec: Column) -> tuple[Column, Column]:
    """(name, optimize) of a method such as ``deflate+``."""
    return F.lower(F.regexp_replace(spec, r"\++$", "")), F.endswith(spec, F.lit("+"))


def timestamps(value: Column) -> dict[str, Column]:
    """A number read in several encodings, as UTC timestamps."""
    after = lambda start, seconds: F.timestamp_seconds(F.lit(start) + seconds)
    return {
        "unix": F.timestamp_seconds(value),
        "file_time": after(-11644473600, value),
        "hfs": after(-2082844800, value),
        "net_ticks": after(-62135596800, value + 62135596800),
        "ole_days": F.timestamp_seconds(F.lit(-2209161600) + F.floor(value / 86400) * 86400),
    }


def rle_pairs(v: bytes) -> bytes:
    """(count, value) pairs, counts up to 255."""
    out, at = bytearray(), 0
    while at < len(v):
        end = at + 1
        while end < len(v) and v[end] == v[at] and end - at < 255:
            end += 1
        out += bytes((end - at, v[at]))
        at = end
    return bytes(out)
