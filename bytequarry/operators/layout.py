"""Grids, refined regions, maps as text, partition tables, verbatim finds, and rules over formats."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import kernels, ladders, templates
from bytequarry.operators import windows

#: Blocks of a grid, and bytes of a block that are looked at: more are reached by drilling into the block.
GRID, SAMPLE = 256, 4096
_BLOCK = pa.struct([
    ("block", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("entropy", pa.float64()), ("zero", pa.bool_()), ("signature", pa.string()),
    ("unique_bytes", pa.int32()), ("dominant", pa.int32()), ("expandable", pa.bool_()),
])
# Magics that mark a block of a grid, the first that fits.
BLOCK_SIGNATURES = """
ZIP 504b0304, 7z 377abcaf271c, RAR 52617221, GZIP 1f8b, BZ2 425a68, XZ fd377a585a00, Zstd 28b52ffd, LZ4 04224d18, PDF 25504446, PNG 89504e47, JPEG ffd8ff,
PE/EXE 4d5a, ELF 7f454c46, SQLite 53514c697465, NTFS eb52904e544653, FAT eb3c90, ext 53ef, MBR boot 55aa, GPT 4546492050415254, FLAC 664c6143, OGG 4f676753,
RIFF 52494646, TAR 7573746172, zlib 789c, LZMA 5d0000, Brotli ceb2cf81, OLE2/CFB d0cf11e0, VMDK 4b444d56, VHD 636f6e6563746978, QCOW 514649fb, VDI 3c3c3c20
"""


def grid_blocks(v: np.ndarray, offset: int = 0, size: int = 0) -> list[dict]:
    """The 256 blocks of a region (size 0: to the end), each by its first bytes; blocks behind the end are empty."""
    size = size if size > 0 else len(v) - offset
    step = max(1, size // GRID)
    magics = [(name, bytes.fromhex(m)) for name, _, m in (x.strip().rpartition(" ") for x in BLOCK_SIGNATURES.split(","))]
    out = []
    for i in range(GRID):
        at = offset + i * step
        held = max(0, min(step, len(v) - at))
        part = v[at : at + min(SAMPLE, held)]
        counts = kernels.histogram_of(part)
        head = part[:64].tobytes()
        out.append({
            "block": i, "offset": at, "size": held, "entropy": float(kernels.entropy_of(counts)), "zero": int(counts[0]) == len(part),
            "signature": next((n for n, m in magics if head.startswith(m)), None), "unique_bytes": int((counts > 0).sum()),
            "dominant": int(counts.argmax()) if len(part) else 0, "expandable": held > SAMPLE,
        })
    return out


def block_grid(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data", offset_col: str | None = None, size_col: str | None = None) -> DataFrame:
    """id, block, offset, size, entropy, zero, signature, unique_bytes, dominant, expandable, type: 16 x 16 blocks a blob.

    With ``offset_col`` and ``size_col`` the region that they name is cut instead:
    drilling into a block passes its own. Empty blobs have 256 empty blocks.
    """

    @kernels.kernel(pa.list_(_BLOCK))
    def cut(blobs: pa.Array, offsets: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = [[] if v is None else grid_blocks(v, o or 0, s or 0) for v, o, s in zip(kernels.views(blobs), offsets.to_pylist(), sizes.to_pylist())]
        return pa.array(rows, pa.list_(_BLOCK))

    region = [F.col(c).cast("long") if c else F.lit(0).cast("long") for c in (offset_col, size_col)]
    rows = blobs.select(id_col, F.explode(cut(F.col(data_col), *region)).alias("b")).select(id_col, "b.*")
    return rows.withColumn("type", ladders.classify_block(F.round("entropy", 6), F.col("zero"), F.col("signature").isNotNull()))


def region_refine(blobs: DataFrame, window: int = 256, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, offset, length, entropy, chi_square, mean, class: merged regions, those above four windows probed again.

    A large region is cut into windows of half the size (64 bytes at least), these
    are classified and merged, and each part's facts are those of its own bytes.
    """
    window = max(16, window)
    probe = max(window // 2, 64)

    @kernels.kernel(kernels.SPANS)
    def refined(blobs: pa.Array) -> pa.Array:
        def cut(v):
            spans = []
            for start, length, counts in kernels._merged(v, window):
                if length <= 4 * window:
                    spans.append((start, length, counts))
                else:
                    spans += [(start + s, n, c) for s, n, c in kernels._merged(v[start : start + length], probe)]
            if not spans:
                return []
            starts, lengths, counts = zip(*spans)
            return [kernels._facts(np.array(starts), np.array(lengths), np.stack(counts))]

        return kernels.span_lists(blobs, cut)

    rows = windows.span_rows(blobs, refined(data_col), id_col)
    return rows.withColumn("class", ladders.classify_region(F.round("entropy", 6)))


def block_map_ascii(spans: DataFrame, size_col: str = "size", block: int = 64, columns: int = 80, id_col: str = "blob_id") -> DataFrame:
    """id, strip: one character a cell, the first letter of the innermost format that covers the cell's first covered block, or a middle dot.

    Blocks are dealt to ``columns`` cells evenly; there are fewer cells if there
    are fewer blocks. ``spans`` has offset, length and format, and the blob's size.
    """
    blocks = F.ceil(F.col(size_col) / block).cast("long")
    width = F.least(blocks, F.lit(columns))
    sizes = spans.groupBy(id_col).agg(F.first(size_col).alias(size_col)).select(id_col, blocks.alias("__n"), width.alias("__w"))
    cover = F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("length") - 1) / block))
    owned = spans.where("length > 0").select(id_col, F.explode(cover).alias("b"), (-F.col("length")).alias("l"), "offset", "format")
    inner = owned.groupBy(id_col, "b").agg(F.max(F.struct("l", "offset", "format"))["format"].alias("f"))
    cell = F.floor(((F.col("b") + 1) * F.col("__w") - 1) / F.col("__n"))
    inner = inner.join(sizes, id_col).where(F.col("b") < F.col("__n")).groupBy(id_col, cell.alias("cell")).agg(F.min_by("f", "b").alias("f"))
    lists = inner.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.upper(F.substring("f", 1, 1))))).alias("m"))
    letters = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__w") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit("·")))
    return sizes.join(lists, id_col, "left").select(id_col, F.array_join(letters, "").alias("strip"))


# Formats that a MIME type can stand for.
_ZIPPED = "Zip Jar War Ear Apk Ipa Xpi Crx Epub Odt Ods Odp Docx Xlsx Pptx Cbz Maff Kmz Appx NuPkg"
MIME = {
    "application/gzip": "Gzip", "application/x-gzip": "Gzip", "application/x-bzip2": "Bzip2", "application/x-xz": "Xz", "application/x-lzma": "Lzma",
    "application/zstd": "Zstd", "application/x-zstd": "Zstd", "application/x-lz4": "Lz4", "application/zip": _ZIPPED, "application/x-7z-compressed": "SevenZip",
    "application/x-rar-compressed": "Rar", "application/x-tar": "Tar", "application/x-cpio": "Cpio", "application/x-lzh-compressed": "Lzh", "application/x-arj": "Arj",
    "application/vnd.ms-cab-compressed": "Cab", "application/x-archive": "Ar", "application/x-iso9660-image": "Iso9660", "application/x-compress": "Compress",
    "application/x-rpm": "Rpm", "application/x-deb": "Deb", "application/x-ace-compressed": "Ace", "application/java-archive": "Jar", "application/epub+zip": "Epub",
    "application/pdf": "Pdf", "application/x-stuffit": "StuffIt", "application/x-lzip": "Lzip",
}


def mime_crosscheck(detected: DataFrame, id_col: str = "blob_id", format_col: str = "format", mime_col: str = "mime") -> DataFrame:
    """id, format, mime, agrees: whether the format is one that the MIME type (whatever its case) can stand for; null for types that are not known."""
    spark = detected.sparkSession
    known = F.broadcast(spark.createDataFrame([(m, f.split()) for m, f in MIME.items()], "__mime string, __formats array<string>"))
    rows = detected.join(known, F.lower(mime_col) == F.col("__mime"), "left")
    return rows.select(id_col, F.col(format_col).alias("format"), F.col(mime_col).alias("mime"), F.when(F.col("__mime").isNotNull(), F.coalesce(F.array_contains("__formats", F.col(format_col)), F.lit(False))).alias("agrees"))


# Stream formats, those of them that hold raw deflate, and the outer codec of compound archives.
STREAMS = "Gzip Zlib Bzip2 Xz Lzma Zstd Lz4 Brotli Lzip Snappy Compress".split()
DEFLATED = ("Gzip", "Zlib")
COMPOUND_TARS = "TarGz TarBz2 TarXz TarZst TarLz4 TarLz TarBr".split()


def convert_tier(source: Column, target: Column, optimize: Column, single_deflate: Column) -> Column:
    """How a conversion can be made: 1 moves the packed bytes, 2 swaps the wrapper, 3 packs anew.

    ``optimize`` (a better encoder is asked for) always packs anew. A zip gives its
    packed bytes to gzip or zlib only if it is one deflated entry, which
    ``single_deflate`` tells.
    """
    deflated, stream, wrapped = (lambda c: c.isin(*DEFLATED)), (lambda c: c.isin(*STREAMS)), (lambda c: c.isin(*COMPOUND_TARS))
    moved = deflated(source) & deflated(target) & (source != target) | (source == "Zip") & deflated(target) & single_deflate | deflated(source) & (target == "Zip")
    swapped = wrapped(source) & (wrapped(target) | (target == "Tar")) | (source == "Tar") & wrapped(target) | stream(source) & stream(target)
    return F.when(optimize, 3).when(moved, 1).when(swapped, 2).otherwise(3)


_FOUND = pa.struct([("method", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def find_verbatim(pairs: DataFrame, content_col: str = "content", archive_col: str = "archive", id_col: str = "blob_id", codecs_to_try: tuple[str, ...] = ("Deflate", "Zlib", "Bzip2", "Lzma", "Xz")) -> DataFrame:
    """id, method, offset, length: where an archive holds a content, as it is or packed by one of the codecs; -1 and ``not found`` if nowhere.

    An empty content is found at 0. Packed forms are compared without what depends on a container.
    """
    from bytequarry.functions import codecs

    @kernels.kernel(_FOUND)
    def search(contents: pa.Array, archives: pa.Array) -> pa.Array:
        out = []
        for content, archive in zip(contents.to_pylist(), archives.to_pylist()):
            if content is None or archive is None:
                out.append(None)
                continue
            found = {"method": "not found", "offset": -1, "length": 0}
            if (at := archive.find(content)) >= 0:
                found = {"method": "verbatim", "offset": at, "length": len(content)}
            else:
                for name in codecs_to_try:
                    packed = codecs.ENCODERS[name](content)
                    if (at := archive.find(packed)) >= 0:
                        found = {"method": name, "offset": at, "length": len(packed)}
                        break
            out.append(found)
        return pa.array(out, _FOUND)

    return pairs.select(id_col, search(content_col, archive_col).alias("f")).where("f is not null").select(id_col, "f.*")


SECTOR = 512
#: Types of a container of further partitions.
_EXTENDED = (0x05, 0x0F, 0x85)


def _mbr_entries(sector: bytes) -> list[tuple[int, int, int, bool]]:
    """(type, first sector, sectors, active) of the four entries."""
    out = []
    for at in range(446, 510, 16):
        e = sector[at : at + 16]
        out.append((e[4], int.from_bytes(e[8:12], "little"), int.from_bytes(e[12:16], "little"), e[0] == 0x80))
    return out


def partitions_of(d: bytes) -> list[dict]:
    """Partitions of a disk image: of its GUID table if it has one, else of its boot record with the chain of extended ones."""
    row = lambda scheme, i, kind, start, size, active, name: {"scheme": scheme, "index": i, "type": kind, "offset": start * SECTOR, "size": size * SECTOR, "active": active, "name": name}
    if d[SECTOR : SECTOR + 8] == b"EFI PART":
        first, count, width = (int.from_bytes(d[SECTOR + a : SECTOR + b], "little") for a, b in ((72, 80), (80, 84), (84, 88)))
        out = []
        if width >= 128 and first * SECTOR + count * width <= len(d):
            for at in range(first * SECTOR, first * SECTOR + count * width, width):
                e = d[at : at + width]
                if any(e[:16]):
                    start, last, flags = (int.from_bytes(e[a : a + 8], "little") for a in (32, 40, 48))
                    name = e[56 : 56 + min(72, width - 56)].decode("utf-16-le", "replace").rstrip("\0")
                    out.append(row("GPT", len(out), str(uuid.UUID(bytes_le=bytes(e[:16]))).upper(), start, last - start + 1, bool(flags & 4), name))
        if out:
            return out
    if len(d) < SECTOR or d[510:512] != b"\x55\xaa":
        return []
    out = []
    for kind, start, size, active in _mbr_entries(d[:SECTOR]):
        if kind in _EXTENDED:
            place, seen = start, set()
            while place and place not in seen and (place + 1) * SECTOR <= len(d):
                seen.add(place)
                (inner, a, n, on), (following, b, m, _), *_ = _mbr_entries(d[place * SECTOR : (place + 1) * SECTOR])
                if inner and n:
                    out.append(row("EBR", len(out), f"0x{inner:02X}", place + a, n, on, None))
                if not following or not m:
                    break
                place = start + b
        elif kind:
            out.append(row("MBR", len(out), f"0x{kind:02X}", start, size, active, None))
    return [p for p in out if p["offset"] < len(d) and p["size"] > 0]


_PARTITIONS = pa.list_(pa.struct([("scheme", pa.string()), ("index", pa.int32()), ("type", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("active", pa.bool_()), ("name", pa.string())]))


def partitions(blobs: DataFrame, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, scheme, index, type, offset, size, active, name: a row a partition; blobs without a table have none."""

    @kernels.kernel(_PARTITIONS)
    def read(blobs: pa.Array) -> pa.Array:
        return pa.array([[] if b.as_py() is None else partitions_of(b.as_py()) for b in blobs], _PARTITIONS)

    return blobs.select(id_col, F.explode(read(data_col)).alias("p")).select(id_col, "p.*")


_FIELDS = pa.list_(pa.struct([("path", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("value", pa.string())]))


def parse_struct(blobs: DataFrame, template: str, struct: str | None = None, id_col: str = "blob_id", data_col: str = "data") -> DataFrame:
    """id, path, type, offset, size, value: the fields that a structure template reads from the start of each blob, in order.

    A faulty template is an error before any blob is read. Null and empty blobs have no fields.
    """
    templates.parse(template)

    @kernels.kernel(_FIELDS)
    def read(blobs: pa.Array) -> pa.Array:
        return pa.array([[] if b.as_py() is None else templates.read(template, b.as_py(), struct) for b in blobs], _FIELDS)

    return blobs.select(id_col, F.explode(read(data_col)).alias("f")).select(id_col, "f.*")
