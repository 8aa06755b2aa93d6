import random
import struct
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import codecs, crypto, ecc, strings, templates
from bytequarry.operators import identify, layout, validate
from bytequarry.sources import archives

TEXT = b"some text that is long enough to be packed well, again and again. " * 20


def blobs(spark, *data):
    return spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "blob_id int, data binary")


def outcome(data, form, level):
    found = validate.check(data, form, level)
    return found["valid"], found["confidence"], found["health"], [i["code"] for i in found["issues"]]


def test_gzip_levels():
    packed = codecs.ENCODERS["Gzip"](TEXT)
    assert [outcome(packed, "Gzip", x)[:3] for x in validate.LEVELS] == [(True, 0.85, "Good"), (True, 0.88, "Good"), (True, 0.99, "Perfect")]
    wrong = packed[:-8] + bytes(4) + packed[-4:]
    assert outcome(wrong, "Gzip", "Integrity") == (False, 0.95, "Damaged", ["GZIP_CRC_MISMATCH"])
    size = packed[:-4] + bytes(4)
    assert outcome(size, "Gzip", "Integrity") == (True, 0.99, "Degraded", ["GZIP_SIZE_MISMATCH"])
    assert outcome(size, "Gzip", "Structure") == (True, 0.88, "Good", ["GZIP_ISIZE_ZERO"])
    assert outcome(packed[:-12], "Gzip", "Integrity") == (False, 0.85, "Damaged", ["GZIP_DECOMPRESS_FAILED"])
    assert outcome(packed + packed, "Gzip", "Integrity")[0] and outcome(b"\x1f\x8b", "Gzip", "Header")[3] == ["GZIP_TOO_SHORT"]
    named = packed[:3] + b"\x08" + packed[4:10] + b"name\0" + packed[10:]
    assert outcome(named, "Gzip", "Integrity")[:2] == (True, 0.99)


def test_other_formats():
    packed = codecs.ENCODERS["Bzip2"](TEXT)
    assert outcome(packed, "Bzip2", "Header") == (True, 0.88, "Good", []) and outcome(packed, "Bzip2", "Integrity")[2] == "Perfect"
    assert outcome(b"BZx9", "Bzip2", "Header")[3] == ["BZ2_BAD_VERSION"] and outcome(b"BZh0", "Bzip2", "Header")[3] == ["BZ2_BAD_BLOCKSIZE"]
    assert outcome(b"BZh9junkjunkjunk", "Bzip2", "Header") == (True, 0.78, "Degraded", ["BZ2_NO_BLOCK_MAGIC"])
    tar = archives.create_tar(["a", "b"], [TEXT, b"x" * 700])
    assert outcome(tar, "Tar", "Header") == (True, 0.92, "Good", []) and validate.check(tar, "Tar", "Integrity")["total_entries"] == 2
    assert outcome(b"A" + tar[1:], "Tar", "Header")[3] == ["TAR_BAD_CHECKSUM"] and outcome(b"A" + tar[1:], "Tar", "Structure")[3] == ["TAR_STRUCTURE_FAILED"]
    short = tar[: 512 + 1536 + 512 + 100]
    assert outcome(short, "Tar", "Integrity") == (True, 0.88, "Degraded", ["TAR_ENTRY_TRUNCATED"])
    made = archives.create_zip(["a", "b"], [TEXT, TEXT[::-1]])
    assert [outcome(made, "Zip", x)[:3] for x in validate.LEVELS] == [(True, 0.90, "Good"), (True, 0.92, "Good"), (True, 0.99, "Perfect")]
    hurt = bytearray(made)
    hurt[40] ^= 0xFF
    assert outcome(bytes(hurt), "Zip", "Integrity") == (True, 0.90, "Degraded", ["ZIP_ENTRY_EXTRACT_FAILED"])
    assert outcome(made[:-30], "Zip", "Structure")[3] == ["ZIP_STRUCTURE_FAILED"] and outcome(b"junk" * 20, "Zip", "Header")[3] == ["ZIP_BAD_SIGNATURE"]
    body = b"next header"
    start = struct.pack("<qqI", 5, len(body), zlib.crc32(body))
    seven = b"7z\xbc\xaf\x27\x1c\0\4" + zlib.crc32(start).to_bytes(4, "little") + start + b"12345" + body
    assert outcome(seven, "SevenZip", "Header") == (True, 0.92, "Good", []) and outcome(seven, "SevenZip", "Structure") == (True, 0.93, "Good", [])
    assert outcome(seven[:-1], "SevenZip", "Structure")[3] == ["7Z_NEXT_HEADER_TRUNCATED"] and outcome(seven[:-1] + b"?", "SevenZip", "Structure")[3] == ["7Z_NEXT_HEADER_CRC"]
    assert validate.check(seven, "SevenZip", "Integrity") is None


def test_validators_never_fail(spark):
    draw = random.Random(2)
    for form, level in validate.RULES:
        for head in (b"\x1f\x8b\x08", b"BZh9", b"PK\x03\x04", b"PK\x05\x06", b"7z\xbc\xaf\x27\x1c", b""):
            for n in (0, 1, 8, 30, 600, 1200):
                assert validate.check(head + draw.randbytes(n), form, level)["confidence"] > 0
    rows = blobs(spark, codecs.ENCODERS["Gzip"](TEXT), None, b"").withColumn("format", F.lit("Gzip"))
    out = validate.validate(rows).collect()
    assert [(r["blob_id"], r["level"], r["valid"]) for r in out] == [(0, x, True) for x in validate.LEVELS] + [(2, "Header", False), (2, "Structure", False), (2, "Integrity", True)]


def test_partition_tables(spark):
    entry = lambda kind, start, count, active=0: bytes([active, 0, 0, 0, kind, 0, 0, 0]) + start.to_bytes(4, "little") + count.to_bytes(4, "little")
    sector = lambda *entries: bytes(446) + b"".join(entries).ljust(64, b"\0") + b"\x55\xaa"
    image = sector(entry(0x83, 1, 2, 0x80), entry(0x05, 3, 9)) + bytes(1024) + sector(entry(0x0B, 1, 1), entry(0x05, 2, 2)) + bytes(512) + sector(entry(0x82, 1, 1)) + bytes(512)
    got = [(p["scheme"], p["type"], p["offset"], p["size"], p["active"]) for p in layout.partitions_of(image)]
    assert got == [("MBR", "0x83", 512, 1024, True), ("EBR", "0x0B", 2048, 512, False), ("EBR", "0x82", 3072, 512, False)]
    loop = sector(entry(0x05, 1, 9)) + sector(entry(0, 0, 0), entry(0x05, 0, 5))
    assert layout.partitions_of(loop) == []
    kind = uuid.uuid4()
    header = b"EFI PART".ljust(72, b"\0") + (2).to_bytes(8, "little") + (4).to_bytes(4, "little") + (128).to_bytes(4, "little")
    table = bytes(128) + kind.bytes_le + bytes(16) + (34).to_bytes(8, "little") + (40).to_bytes(8, "little") + (4).to_bytes(8, "little") + "data".encode("utf-16-le").ljust(72, b"\0") + bytes(256)
    disk = sector(entry(0xEE, 1, 99)) + header.ljust(512, b"\0") + table.ljust(512, b"\0")
    (found,) = layout.partitions(blobs(spark, disk, None, b"x")).collect()
    assert tuple(found) == (0, "GPT", 0, str(kind).upper(), 34 * 512, 7 * 512, True, "data")


def test_grid_drills_down(spark):
    data = b"PK\x03\x04" + bytes(70_000) + random.Random(1).randbytes(60_000)
    rows = layout.block_grid(blobs(spark, data, b"", None))
    first = {r["block"]: r for r in rows.where("blob_id = 0").collect()}
    step = len(data) // 256
    assert first[0]["type"] == "HasSignature" and first[0]["signature"] == "ZIP" and first[50]["type"] == "Empty" and first[200]["type"] == "Random" and first[200]["size"] == step
    assert rows.where("blob_id = 1 and type = 'Empty' and size = 0").count() == 256 and rows.where("blob_id = 2").count() == 0
    region = blobs(spark, data).withColumn("o", F.lit(200 * step)).withColumn("s", F.lit(step))
    inner = layout.block_grid(region, offset_col="o", size_col="s").collect()
    assert inner[0]["offset"] == 200 * step and inner[255]["offset"] == 200 * step + 255 * (step // 256)


def test_strings_of_several_encodings(spark):
    data = b"\1plain\2" + "wide text".encode("utf-16-le") + b"\2\2" + "big".encode("utf-16-be") + b"\3" + "grüße".encode() + b"\xff\xfe" + b"ok"
    rows = {(r["encoding"], r["offset"]): (r["length"], r["value"]) for r in strings.text_strings(blobs(spark, data + b"\0", None, b""), least=5, gap=3).collect()}
    assert rows["ascii", 1] == (5, "plain") and rows["utf-16be", 8] == (16, "ide text")
    assert ("utf-16le", 7) not in rows  # odd places are not looked at
    at = data.index("grüße".encode())
    bridged = next(v for (e, o), v in rows.items() if e == "utf-8" and o <= at < o + v[0])
    assert bridged[1].endswith("grüße..ok")
    plain = list(strings.ENCODINGS["utf-8"]("é€😀x\x00abc".encode(), 4, 0))
    assert plain == [(0, 10, "é€😀x")]


def test_find_verbatim_and_tiers(spark):
    rows = spark.createDataFrame([(1, bytearray(TEXT), bytearray(b"..." + TEXT)), (2, bytearray(TEXT), bytearray(b"." + codecs.ENCODERS["Deflate"](TEXT))), (3, bytearray(TEXT), bytearray(b"no")), (4, None, bytearray(b"no"))], "blob_id int, content binary, archive binary")
    assert {tuple(r) for r in layout.find_verbatim(rows).collect()} == {(1, "verbatim", 3, len(TEXT)), (2, "Deflate", 1, len(codecs.ENCODERS["Deflate"](TEXT))), (3, "not found", -1, 0)}


@pytest.mark.parametrize("size", [0, 1, 63, 4096, 70_000])
def test_rotations_and_window_kernels_on_odd_sizes(spark, size):
    data = random.Random(size).choices(b"abc\0", k=size)
    assert codecs.bwt_decode(codecs.bwt_encode(bytes(data)), size) == bytes(data)


def values(kind, data):
    (row,) = templates.read(f"struct S {{ {kind} x; }};", bytes.fromhex(data))
    return row["value"]


@pytest.mark.parametrize(
    ("kind", "data", "value"),
    [
        ("u8", "ff", "255"), ("i8", "ff", "-1"), ("u16le", "0102", "513"), ("u16be", "0102", "258"), ("i64be", "ff" * 8, "-1"), ("u64le", "ff" * 8, str(2**64 - 1)), ("u128be", "00" * 15 + "0a", "0x" + "0" * 31 + "A"),
        ("i128le", "fe" + "ff" * 15, "-2"), ("f16le", "003c", "1.0"), ("f32be", "3f800000", "1.0"), ("doublele", "000000000000f03f", "1.0"), ("bf16be", "3f80", "1.0"), ("bf16le", "803f", "1.0"),
        ("fp8e4m3", "38", "1.0"), ("fp8e4m3", "7f", "nan"), ("fp8e4m3", "7e", "448.0"), ("fp8e5m2", "3c", "1.0"), ("fp8e5m2", "7c", "inf"), ("fp8e5m2", "01", repr(2.0**-16)),
        ("unixts32le", "80436d38", "2000-01-01T00:00:00"), ("filetime", "00803ed5deb19d01", "1970-01-01T00:00:00"), ("netticks", "00" * 8, "0001-01-01T00:00:00"), ("hfsdate", "7c25b080", "1970-01-01T00:00:00"),
        ("oledate", "0000000000c8e240", "2005-04-22T00:00:00"), ("dosdate", "2158", "2024-01-01"), ("dostime", "2060", "12:01:00"), ("unix64be", "ff" * 7 + "00", "1969-12-31T23:55:44"),
        ("q8.8", "80ff", "-0.5"), ("uq16.16", "00800100", "1.5"), ("q32.32", "0000008001000000", "1.5"), ("bcd16", "3412", "1234"), ("bcd8", "9f", "9?"),
        ("rgb", "010203", "#010203"), ("bgra", "03020104", "#01020304"), ("rgb565", "00f8", "#FF0000"), ("rgba5551", "0100", "#000000FF"), ("rgb555", "e003", "#00FF00"),
        ("ipv4", "7f000001", "127.0.0.1"), ("ipv6", "00" * 15 + "01", "::1"), ("mac", "0a0b0c0d0e0f", "0A:0B:0C:0D:0E:0F"), ("fourcc", "49484452", "IHDR"), ("bool", "02", "true"),
        ("guid", "33221100554477668899aabbccddeeff", "00112233-4455-6677-8899-AABBCCDDEEFF"),
    ],
)
def test_field_types(kind, data, value):
    assert values(kind, data) == value


def test_templates(spark):
    zipped = archives.create_zip(["name.txt"], [TEXT])
    rows = {r["path"]: (r["offset"], r["size"], r["value"]) for r in templates.read(templates.BUILT_IN["Zip"], zipped)}
    assert rows["name"] == (30, 8, "name.txt") and rows["method"][2] == "8" and rows["date"][2] == "1980-01-01" and rows["extra"] == (38, 0, "")
    text = "struct A { u8 n; u16le[n] list; B b; bits[4] lo; bits[12] hi; u8 next; u16be[*] rest; char last; };\nstruct B { char[2] s; } // done"
    got = [(r["path"], r["type"], r["offset"], r["size"], r["value"]) for r in templates.read(text, bytes.fromhex("02 0100 0200 6869 21 43 09 0001 0002 ff"))]
    assert got == [
        ("n", "u8", 0, 1, "2"), ("list", "u16le[2]", 1, 4, None), ("list[0]", "u16le", 1, 2, "1"), ("list[1]", "u16le", 3, 2, "2"), ("b", "B", 5, 0, None), ("b.s", "char[2]", 5, 2, "hi"),
        ("lo", "bits[4]", 7, 1, "1"), ("hi", "bits[12]", 7, 2, str(0x432)), ("next", "u8", 9, 1, "9"), ("rest", "u16be[2]", 10, 4, None), ("rest[0]", "u16be", 10, 2, "1"), ("rest[1]", "u16be", 12, 2, "2"), ("last", "char", 14, 1, "ÿ"),
    ]
    assert templates.read("struct A { u32le a; u8[missing] b; u32le c; };", b"\1\0\0\0\5") [1]["size"] == 0
    for wrong in ("", "u8 x;", "struct A { u8 x }", "struct A { what x; };", "struct A { u8 x;", "struct A { struct B { } }"):
        with pytest.raises(ValueError):
            layout.parse_struct(blobs(spark, b""), wrong)
    with pytest.raises(ValueError):
        templates.read("struct A { A again; };", b"x")
    assert layout.parse_struct(blobs(spark, None, b"", b"\7"), "struct A { u8 x; };").collect()[0][0] == 2
    assert all(templates.read(t, bytes(100)) for t in templates.BUILT_IN.values())


def test_identification(spark):
    packed = codecs.ENCODERS["Zlib"](TEXT)
    rows = blobs(spark, packed, None, b"").withColumn("n", F.lit(len(TEXT)))
    out = identify.compression_identify(rows, "n").collect()
    assert out and {r["blob_id"] for r in out} == {0}
    assert ("Zlib", len(TEXT), 1.0) in [(r["codec"], r["output_size"], r["confidence"]) for r in out] and [r["confidence"] for r in out] == sorted((r["confidence"] for r in out), reverse=True)
    marks = identify.stream_marks(blobs(spark, b".." + packed + b"\x28\xb5\x2f\xfd", bytes(63) + b"\x78\x9c", bytes(64) + b"\x78\x9c", None)).collect()
    assert (0, 2, "DEFLATE (zlib)") in [tuple(r) for r in marks] and (1, 63, "DEFLATE (zlib)") in [tuple(r) for r in marks] and not any(r["blob_id"] == 2 for r in marks)
    runs = spark.createDataFrame([(bytearray(b"a" * 10), bytearray(b"H" + bytes(range(256)) + b"F")), (bytearray(b"a" * 10), bytearray(b"H" + bytes(range(256)) + b"G")), (bytearray(b""), bytearray(b"H"))], "input binary, output binary")
    facts = identify.payload_facts(runs, 1, 1).first()
    assert (facts["avg_ratio"], facts["deterministic"], facts["payload_entropy"], facts["compressed"]) == (25.8, False, 8.0, True)


def test_recovery_blocks():
    draw = random.Random(5)
    assert ecc.multiply(2, 0x80) == 0x1D and ecc.multiply(0, 7) == 0
    for n, extra in ((1, 1), (5, 3), (10, 4), (17, 17)):
        shards = [draw.randbytes(50) for _ in range(n)]
        made = ecc.parity(shards, extra)
        for _ in range(5):
            gone = draw.sample(range(n + extra), extra)
            left = [None if i in gone else s for i, s in enumerate(shards)]
            assert ecc.recover(left, [None if n + i in gone else s for i, s in enumerate(made)]) == shards
    with pytest.raises(ValueError):
        ecc.recover([None, b"x"], [None])


def test_keys_and_ciphers(spark):
    rows = spark.createDataFrame([(bytearray(b"password"), bytearray(b"salt")), (None, bytearray(b"salt"))], "p binary, s binary")
    keys = [r["k"] for r in rows.select(crypto.derived_key(2, 20, "sha1")("p", "s").alias("k")).collect()]
    assert bytes(keys[0]).hex() == "ea6c014dc72d6f8ccd1ed92ace1d41f0d8de8957" and keys[1] is None
    key, vector = F.unhex(F.lit("2b7e151628aed2a6abf7158809cf4f3c")), F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))
    plain = F.unhex(F.lit("6bc1bee22e409f96e93d7e117393172a"))
    row = spark.range(1).select(crypto.aes_cbc_encrypt(plain, key, vector).alias("e")).select("e", crypto.aes_cbc_decrypt(F.col("e"), key).alias("d"), crypto.aes_cbc_decrypt(F.substring("e", 1, 20), key).alias("bad")).first()
    assert bytes(row["e"])[16:32].hex() == "7649abac8119b246cee98e9b12e9197d" and bytes(row["d"]).hex() == "6bc1bee22e409f96e93d7e117393172a" and row["bad"] is None
