"""Signatures of formats as a small table.

The order of the list is the order of registration, which decides ties.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions.scan import Signature

# Format, magic in hexadecimal, offset of the magic, confidence, extensions.
SIGNATURES = [
    ("SevenZip", "377abcaf271c", 0, 0.95, ".7z"),
    ("Zip", "504b0304", 0, 0.9, ".zip"),
    ("Zip", "504b0506", 0, 0.9, ".zip"),
    ("Gzip", "1f8b08", 0, 0.9, ".gz"),
    ("Bzip2", "425a68", 0, 0.85, ".bz2"),
    ("Xz", "fd377a585a00", 0, 0.95, ".xz"),
    ("Zstd", "28b52ffd", 0, 0.9, ".zst"),
    ("Lz4", "04224d18", 0, 0.9, ".lz4"),
    ("Lzip", "4c5a4950", 0, 0.9, ".lz"),
    ("Lzop", "894c5a4f000d0a1a0a", 0, 0.95, ".lzo"),
    ("Snappy", "ff060000734e61507059", 0, 0.95, ".sz"),
    ("Compress", "1f9d", 0, 0.8, ".Z"),
    ("Rar", "526172211a07", 0, 0.95, ".rar"),
    ("Tar", "7573746172", 257, 0.9, ".tar"),
    ("Cab", "4d534346", 0, 0.9, ".cab"),
    ("Ar", "213c617263683e0a", 0, 0.95, ".a .ar .deb"),
    ("Cpio", "303730373031", 0, 0.9, ".cpio"),
    ("Cpio", "303730373037", 0, 0.9, ".cpio"),
    ("Rpm", "edabeedb", 0, 0.95, ".rpm"),
    ("Xar", "78617221", 0, 0.9, ".xar .pkg"),
    ("Arj", "60ea", 0, 0.7, ".arj"),
    ("Lzh", "2d6c68", 2, 0.8, ".lzh .lha"),
    ("Wim", "4d5357494d000000", 0, 0.95, ".wim"),
    ("Chm", "49545346", 0, 0.9, ".chm"),
    ("SquashFs", "68737173", 0, 0.9, ".squashfs"),
    ("CramFs", "453dcd28", 0, 0.9, ".cramfs"),
    ("Ext", "53ef", 1080, 0.7, ".ext4"),
    ("Iso", "4344303031", 32769, 0.95, ".iso"),
    ("Qcow2", "514649fb", 0, 0.95, ".qcow2"),
    ("Vmdk", "4b444d56", 0, 0.9, ".vmdk"),
    ("Vhdx", "7668647866696c65", 0, 0.95, ".vhdx"),
    ("Png", "89504e470d0a1a0a", 0, 0.95, ".png"),
    ("Jpeg", "ffd8ff", 0, 0.85, ".jpg .jpeg"),
    ("Gif", "474946383761", 0, 0.95, ".gif"),
    ("Gif", "474946383961", 0, 0.95, ".gif"),
    ("Bmp", "424d", 0, 0.5, ".bmp"),
    ("Tiff", "49492a00", 0, 0.85, ".tif .tiff"),
    ("Tiff", "4d4d002a", 0, 0.85, ".tif .tiff"),
    ("Psd", "38425053", 0, 0.9, ".psd"),
    ("Pdf", "255044462d", 0, 0.95, ".pdf"),
    ("Elf", "7f454c46", 0, 0.95, ".elf .so"),
    ("Pe", "4d5a", 0, 0.6, ".exe .dll"),
    ("MachO", "cffaedfe", 0, 0.9, ".dylib"),
    ("JavaClass", "cafebabe", 0, 0.8, ".class"),
    ("Wasm", "0061736d", 0, 0.95, ".wasm"),
    ("Sqlite", "53514c69746520666f726d6174203300", 0, 0.98, ".sqlite .db"),
    ("Parquet", "50415231", 0, 0.9, ".parquet"),
    ("Orc", "4f5243", 0, 0.8, ".orc"),
    ("Arrow", "4152524f5731", 0, 0.95, ".arrow .feather"),
    ("Avro", "4f626a01", 0, 0.95, ".avro"),
    ("Numpy", "934e554d5059", 0, 0.95, ".npy"),
    ("Hdf5", "894844460d0a1a0a", 0, 0.95, ".h5 .hdf5"),
    ("NetCdf", "43444601", 0, 0.9, ".nc"),
    ("Riff", "52494646", 0, 0.7, ".wav .avi .webp"),
    ("Flac", "664c6143", 0, 0.95, ".flac"),
    ("Ogg", "4f676753", 0, 0.9, ".ogg .opus"),
    ("Mp3", "494433", 0, 0.8, ".mp3"),
    ("Midi", "4d546864", 0, 0.95, ".mid"),
    ("Mp4", "66747970", 4, 0.85, ".mp4 .m4a .mov"),
    ("Mkv", "1a45dfa3", 0, 0.9, ".mkv .webm"),
    ("Ole", "d0cf11e0a1b11ae1", 0, 0.95, ".doc .xls .ppt .msi"),
    ("Rtf", "7b5c72746631", 0, 0.9, ".rtf"),
    ("Dex", "6465780a", 0, 0.95, ".dex"),
    ("Woff", "774f4646", 0, 0.95, ".woff"),
    ("Woff2", "774f4632", 0, 0.95, ".woff2"),
    ("Warc", "574152432f", 0, 0.9, ".warc"),
    ("Pcap", "d4c3b2a1", 0, 0.9, ".pcap"),
    ("PcapNg", "0a0d0d0a", 0, 0.85, ".pcapng"),
    ("Torrent", "64383a616e6e6f756e6365", 0, 0.9, ".torrent"),
    ("Script", "2321", 0, 0.6, ".sh .py"),
    # Local ones for text blobs, whose magics are plain text.
    ("Html", "3c21444f4354595045", 0, 0.9, ".html .htm"),
    ("Xml", "3c3f786d6c", 0, 0.9, ".xml"),
    ("Json", "7b22", 0, 0.6, ".json"),
]

# Extensions of more than one part, which win over single ones.
COMPOUND = [("TarGz", ".tar.gz"), ("TarBz2", ".tar.bz2"), ("TarXz", ".tar.xz"), ("TarZst", ".tar.zst"), ("TarLz4", ".tar.lz4"), ("TarLz", ".tar.lz"), ("TarBr", ".tar.br")]


# Formats that are no archives, by category; archives are all others.
CATEGORIES = {
    "Stream": "Gzip Bzip2 Xz Zstd Lz4 Lzip Lzop Snappy Compress",
    "CompoundTar": "TarGz TarBz2 TarXz TarZst TarLz4 TarLz TarBr",
    "Audio": "Flac Ogg Mp3 Midi Riff",
    "Video": "Mp4 Mkv",
}


def category(form: Column) -> Column:
    """The category of a format; null for none."""
    out = F.when(form.isNull(), F.lit(None))
    for name, forms in CATEGORIES.items():
        out = out.when(form.isin(forms.split()), F.lit(name))
    return out.otherwise(F.lit("Archive"))


@lru_cache(maxsize=1)
def known() -> list[Signature]:
    """The list for functions over bytes."""
    return [Signature(f, bytes.fromhex(m), o, c) for f, m, o, c, *_ in SIGNATURES]


def signatures(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """reg_order, format, magic, offset, confidence. The rows are the list's (and ``extra``), so broadcasting them is safe."""
    rows = [(i, f, bytes.fromhex(m), o, c) for i, (f, m, o, c, *_) in enumerate([*SIGNATURES, *(extra or [])])]
    return spark.createDataFrame(rows, "reg_order int, format string, magic binary, offset int, confidence double")


def extensions(spark: SparkSession) -> DataFrame:
    """format, ext: of the formats and of the compound ones."""
    rows = {(f, e) for f, _, _, _, exts in SIGNATURES for e in exts.split()} | set(COMPOUND)
    return spark.createDataFrame(sorted(rows), "format string, ext string")
