"""Validators of five formats at three levels: header fields, structure, and integrity.

A rule gives an issue (severity, code, offset); an error at a level makes the
blob invalid there. Confidence and health follow from the issues by the tables
below. One kernel checks a blob at all levels.
"""

from __future__ import annotations

import bz2
import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels

INFO, WARNING, ERROR = "Info", "Warning", "Error"
LEVELS = ("Header", "Structure", "Integrity")


class Issue(NamedTuple):
    severity: str
    code: str
    offset: int | None = None


# Confidence of a valid level without issues, with infos only, and with warnings.
CLEAN = {
    ("Gzip", "Header"): (0.85, 0.85, 0.75), ("Gzip", "Structure"): (0.88, 0.88, 0.88), ("Gzip", "Integrity"): (0.99, 0.99, 0.99),
    ("Bzip2", "Header"): (0.88, 0.88, 0.78), ("Bzip2", "Structure"): (0.87, 0.87, 0.87), ("Bzip2", "Integrity"): (0.99, 0.99, 0.99),
    ("Tar", "Header"): (0.92, 0.88, 0.80), ("Tar", "Structure"): (0.93, 0.93, 0.93), ("Tar", "Integrity"): (0.97, 0.97, 0.97),
    ("Zip", "Header"): (0.90, 0.90, 0.80), ("Zip", "Structure"): (0.92, 0.75, 0.75), ("Zip", "Integrity"): (0.99, 0.99, 0.99),
    ("SevenZip", "Header"): (0.92, 0.75, 0.75), ("SevenZip", "Structure"): (0.93, 0.93, 0.93),
}
# Confidence of an invalid level by its error.
FAILED = {
    "GZIP_TOO_SHORT": 0.3, "GZIP_BAD_METHOD": 0.4, "GZIP_TRUNCATED": 0.6, "GZIP_CRC_MISMATCH": 0.95, "GZIP_DECOMPRESS_FAILED": 0.85,
    "BZ2_TOO_SHORT": 0.3, "BZ2_BAD_VERSION": 0.4, "BZ2_BAD_BLOCKSIZE": 0.4, "BZ2_DECOMPRESS_FAILED": 0.85,
    "TAR_TOO_SHORT": 0.3, "TAR_BAD_CHECKSUM": 0.4, "TAR_STRUCTURE_FAILED": 0.6, "TAR_INTEGRITY_FAILED": 0.5,
    "ZIP_TOO_SHORT": 0.3, "ZIP_BAD_SIGNATURE": 0.2, "ZIP_HEADER_OVERFLOW": 0.4, "ZIP_CD_OFFSET_OOB": 0.6, "ZIP_CD_ENTRY_TRUNCATED": 0.75, "ZIP_CD_BAD_SIG": 0.75, "ZIP_STRUCTURE_FAILED": 0.5, "ZIP_INTEGRITY_FAILED": 0.5,
    "7Z_TOO_SHORT": 0.3, "7Z_START_HEADER_CRC": 0.4, "7Z_NEGATIVE_OFFSET": 0.4, "7Z_NEXT_HEADER_TRUNCATED": 0.6, "7Z_NEXT_HEADER_CRC": 0.7, "7Z_STRUCTURE_FAILED": 0.5,
}
# Confidence of an archive by whether any entry came out whole, if not all did.
SOME_ENTRIES, NO_ENTRIES = {"Zip": 0.90, "Tar": 0.88}, 0.5
ZIP_METHODS, TAR_FLAGS = (0, 8, 9, 12, 14, 93, 98, 99), b"\0" + b"01234567LKxgMS"

_int = int.from_bytes


def _gzip_header(d: bytes) -> Iterator[Issue]:
    if len(d) < 10:
        yield Issue(ERROR, "GZIP_TOO_SHORT")
    elif d[2] != 8:
        yield Issue(ERROR, "GZIP_BAD_METHOD", 2)
    else:
        if d[3] & 0xE0:
            yield Issue(WARNING, "GZIP_RESERVED_FLAGS", 3)
        if d[8] not in (0, 2, 4):
            yield Issue(INFO, "GZIP_UNUSUAL_XFL", 8)
        if len(d) < 18:
            yield Issue(WARNING, "GZIP_NO_TRAILER")


def _gzip_structure(d: bytes) -> Iterator[Issue]:
    if len(d) < 18:
        yield Issue(ERROR, "GZIP_TRUNCATED")
    elif len(d) > 20 and not any(d[-4:]):
        yield Issue(INFO, "GZIP_ISIZE_ZERO")


def _gzip_integrity(d: bytes) -> Iterator[Issue]:
    crc = size = 0
    rest = d
    try:
        while rest:  # members one behind the other; the trailer checks are made here, so that they can be told apart
            head = zlib.decompressobj(-15)
            start = _gzip_body(rest)
            out = head.decompress(rest[start:])
            if not head.eof or len(head.unused_data) < 8:
                raise ValueError("cut")
            stored, told = _int(head.unused_data[:4], "little"), _int(head.unused_data[4:8], "little")
            crc, size = zlib.crc32(out), len(out) & 0xFFFFFFFF
            if stored != crc:
                yield Issue(ERROR, "GZIP_CRC_MISMATCH")
                return
            if told != size:
                yield Issue(WARNING, "GZIP_SIZE_MISMATCH")
            rest = head.unused_data[8:].lstrip(b"\0")
    except (ValueError, IndexError, zlib.error):
        yield Issue(ERROR, "GZIP_DECOMPRESS_FAILED")


def _gzip_body(d: bytes) -> int:
    """Where the packed bytes begin, behind the optional header fields."""
    if d[:3] != b"\x1f\x8b\x08" or len(d) < 10:
        raise ValueError("no member")
    flags, at = d[3], 10
    if flags & 4:
        at += 2 + _int(d[at : at + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            at = d.index(b"\0", at) + 1
    return at + 2 * bool(flags & 2)


def _bzip2_header(d: bytes) -> Iterator[Issue]:
    if len(d) < 4:
        yield Issue(ERROR, "BZ2_TOO_SHORT")
    elif d[2] != 0x68:
        yield Issue(ERROR, "BZ2_BAD_VERSION", 2)
    elif not 0x31 <= d[3] <= 0x39:
        yield Issue(ERROR, "BZ2_BAD_BLOCKSIZE", 3)
    elif len(d) >= 10 and d[4:10].hex() not in ("314159265359", "177245385090"):
        yield Issue(WARNING, "BZ2_NO_BLOCK_MAGIC", 4)


def _bzip2_structure(d: bytes) -> Iterator[Issue]:
    if len(d) < 14:
        yield Issue(WARNING, "BZ2_VERY_SHORT")


def _bzip2_integrity(d: bytes) -> Iterator[Issue]:
    try:
        run = bz2.BZ2Decompressor()
        run.decompress(d)
        if not run.eof:
            raise EOFError
    except (OSError, EOFError, ValueError):
        yield Issue(ERROR, "BZ2_DECOMPRESS_FAILED")


def _tar_header(d: bytes) -> Iterator[Issue]:
    if len(d) < 512:
        yield Issue(ERROR, "TAR_TOO_SHORT")
        return
    if d[257:262] != b"ustar":
        yield Issue(WARNING, "TAR_NO_USTAR")
    digits = d[148:156].split(b"\0")[0].strip(b" ")
    if digits and all(c in b"01234567" for c in digits) and int(digits, 8) != sum(d[:148]) + 8 * 32 + sum(d[156:512]):
        yield Issue(ERROR, "TAR_BAD_CHECKSUM")
        return
    if d[156] not in TAR_FLAGS:
        yield Issue(INFO, "TAR_UNUSUAL_TYPEFLAG", 156)
    if len(d) % 512:
        yield Issue(INFO, "TAR_UNALIGNED")


def _tar_entries(d: bytes) -> list[tuple[int, int, int]]:
    """(type, start of the data, size) of each entry up to a zero block or the end; raises at a header that is none."""
    out, at = [], 0
    while at + 512 <= len(d) and any(d[at : at + 512]):
        head = d[at : at + 512]
        digits, told = (head[x:y].split(b"\0")[0].strip(b" ") for x, y in ((124, 136), (148, 156)))
        size = _int(head[125:136], "big") if head[124] & 0x80 else int(digits or b"0", 8)
        if int(told or b"0", 8) != sum(head[:148]) + 8 * 32 + sum(head[156:]):
            raise ValueError("a header's sum is wrong")
        out.append((head[156], at + 512, size))
        at += 512 + -(-size // 512) * 512
    return out


def _tar_structure(d: bytes) -> Iterator[Issue | tuple[int, int]]:
    try:
        count = len(_tar_entries(d))
        yield count, count
    except ValueError:
        yield Issue(ERROR, "TAR_STRUCTURE_FAILED")


def _tar_integrity(d: bytes) -> Iterator[Issue | tuple[int, int]]:
    try:
        entries, whole = _tar_entries(d), 0
        for kind, start, size in entries:
            if kind != 0x35 and start + size > len(d):
                yield Issue(ERROR, "TAR_ENTRY_TRUNCATED", start - 512)
            else:
                whole += 1
        yield whole, len(entries)
    except ValueError:
        yield Issue(ERROR, "TAR_INTEGRITY_FAILED")


def _zip_header(d: bytes) -> Iterator[Issue]:
    if len(d) < 30:
        yield Issue(ERROR, "ZIP_TOO_SHORT")
    elif d[:4] not in (b"PK\x03\x04", b"PK\x05\x06"):
        yield Issue(ERROR, "ZIP_BAD_SIGNATURE", 0)
    elif d[2] == 3:
        if _int(d[4:6], "little") > 63:
            yield Issue(WARNING, "ZIP_HIGH_VERSION", 4)
        if _int(d[8:10], "little") not in ZIP_METHODS:
            yield Issue(WARNING, "ZIP_UNKNOWN_METHOD", 8)
        if 30 + _int(d[26:28], "little") + _int(d[28:30], "little") > len(d):
            yield Issue(ERROR, "ZIP_HEADER_OVERFLOW")


def _zip_structure(d: bytes) -> Iterator[Issue | tuple[int, int]]:
    end = d.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(d):
        yield Issue(ERROR, "ZIP_STRUCTURE_FAILED")
        return
    count, size, at = _int(d[end + 10 : end + 12], "little"), _int(d[end + 12 : end + 16], "little"), _int(d[end + 16 : end + 20], "little")
    if at > len(d):
        yield Issue(ERROR, "ZIP_CD_OFFSET_OOB")
        return
    if at + size > len(d):
        yield Issue(WARNING, "ZIP_CD_TRUNCATED")
    whole = 0
    for _ in range(count):
        if at + 46 > len(d):
            yield Issue(ERROR, "ZIP_CD_ENTRY_TRUNCATED", at)
            break
        if d[at : at + 4] != b"PK\x01\x02":
            yield Issue(ERROR, "ZIP_CD_BAD_SIG", at)
            break
        at += 46 + sum(_int(d[at + i : at + i + 2], "little") for i in (28, 30, 32))
        whole += 1
    yield whole, count


def _zip_integrity(d: bytes) -> Iterator[Issue | tuple[int, int]]:
    try:
        with zipfile.ZipFile(io.BytesIO(d)) as archive:
            whole, entries = 0, archive.infolist()
            for e in entries:
                try:
                    with archive.open(e) as content:
                        while content.read(1 << 20):
                            pass
                    whole += 1
                except Exception:  # an entry can be damaged in any way
                    yield Issue(ERROR, "ZIP_ENTRY_EXTRACT_FAILED", e.header_offset)
            yield whole, len(entries)
    except (zipfile.BadZipFile, ValueError, OSError):
        yield Issue(ERROR, "ZIP_INTEGRITY_FAILED")


def _seven_header(d: bytes) -> Iterator[Issue]:
    if len(d) < 32:
        yield Issue(ERROR, "7Z_TOO_SHORT")
        return
    if d[6]:
        yield Issue(WARNING, "7Z_UNKNOWN_MAJOR_VERSION", 6)
    if _int(d[8:12], "little") != zlib.crc32(d[12:32]):
        yield Issue(ERROR, "7Z_START_HEADER_CRC", 8)
        return
    offset, size = _int(d[12:20], "little", signed=True), _int(d[20:28], "little", signed=True)
    if offset < 0 or size < 0:
        yield Issue(ERROR, "7Z_NEGATIVE_OFFSET")
    elif 32 + offset + size > len(d):
        yield Issue(WARNING, "7Z_HEADER_BEYOND_EOF")


def _seven_structure(d: bytes) -> Iterator[Issue]:
    offset, size = _int(d[12:20], "little", signed=True), _int(d[20:28], "little", signed=True)
    if len(d) < 32 or offset < 0 or size < 0:
        yield Issue(ERROR, "7Z_STRUCTURE_FAILED")
    elif 32 + offset + size > len(d):
        yield Issue(ERROR, "7Z_NEXT_HEADER_TRUNCATED")
    elif zlib.crc32(d[32 + offset : 32 + offset + size]) != _int(d[28:32], "little"):
        yield Issue(ERROR, "7Z_NEXT_HEADER_CRC")


#: Rules by format and level. What 7z holds can't be unpacked here, so it has no third level.
RULES: dict[tuple[str, str], Callable[[bytes], Iterator]] = {
    ("Gzip", "Header"): _gzip_header, ("Gzip", "Structure"): _gzip_structure, ("Gzip", "Integrity"): _gzip_integrity,
    ("Bzip2", "Header"): _bzip2_header, ("Bzip2", "Structure"): _bzip2_structure, ("Bzip2", "Integrity"): _bzip2_integrity,
    ("Tar", "Header"): _tar_header, ("Tar", "Structure"): _tar_structure, ("Tar", "Integrity"): _tar_integrity,
    ("Zip", "Header"): _zip_header, ("Zip", "Structure"): _zip_structure, ("Zip", "Integrity"): _zip_integrity,
    ("SevenZip", "Header"): _seven_header, ("SevenZip", "Structure"): _seven_structure,
}


def check(data: bytes, form: str, level: str) -> dict | None:
    """The outcome of one level, or None if there are no rules for it."""
    rules = RULES.get((form, level))
    if rules is None:
        return None
    found = list(rules(data))
    entries = next((x for x in found if not isinstance(x, Issue)), None)
    issues = [x for x in found if isinstance(x, Issue)]
    worst = {i.severity for i in issues}
    broken = next((i.code for i in issues if i.code in FAILED), None)
    clean, informed, warned = CLEAN[form, level]
    if broken:
        valid, confidence, health = False, FAILED[broken], "Damaged"
    elif entries and (ERROR in worst or entries[0] < entries[1]):
        valid, confidence = entries[0] > 0, SOME_ENTRIES[form] if entries[0] else NO_ENTRIES
        health = "Damaged" if not entries[0] else "Degraded" if entries[0] < entries[1] else "Good"
    else:
        valid, confidence = True, warned if WARNING in worst else informed if worst else clean
        health = "Degraded" if WARNING in worst else "Perfect" if level == "Integrity" else "Good"
    valid_entries, total_entries = entries or (None, None)
    return {"level": level, "valid": valid, "confidence": confidence, "health": health, "issues": [i._asdict() for i in issues], "valid_entries": valid_entries, "total_entries": total_entries}


_ISSUES = pa.list_(pa.struct([("severity", pa.string()), ("code", pa.string()), ("offset", pa.int64())]))
_OUTCOMES = pa.list_(
    pa.struct([("level", pa.string()), ("valid", pa.bool_()), ("confidence", pa.float64()), ("health", pa.string()), ("issues", _ISSUES), ("valid_entries", pa.int64()), ("total_entries", pa.int64())])
)


@kernels.kernel(_OUTCOMES)
def outcomes(blobs: pa.Array, formats: pa.Array) -> pa.Array:
    """A column function: the outcome of each level for a blob taken as of a format; null blobs, and formats without rules, have none."""
    out = []
    for data, form in zip(blobs, formats.to_pylist()):
        data = data.as_py()
        rows = [] if data is None else [check(data, form, level) for level in LEVELS]
        out.append([r for r in rows if r])
    return pa.array(out, _OUTCOMES)


def validate(blobs: DataFrame, id_col: str = "blob_id", format_col: str = "format", data_col: str = "data") -> DataFrame:
    """id, format, level, valid, confidence, health, issues, valid_entries, total_entries: a row a blob and level."""
    rows = blobs.select(id_col, F.col(format_col).alias("format"), F.explode(outcomes(data_col, format_col)).alias("o"))
    return rows.select(id_col, "format", "o.*")
