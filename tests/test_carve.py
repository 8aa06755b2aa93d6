from bytequarry.functions import scan
from bytequarry.operators import carve, detect
from bytequarry.sources import archives, signatures


def chunk(kind, data):
    return len(data).to_bytes(4, "big") + kind + data + b"crc."


def test_known_payloads_are_carved(spark):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b"x" * 200) + chunk(b"IEND", b"")
    packed = archives.create_zip(["a"], [bytes(range(256)) * 4])
    image = b"." * 50 + png + b"-" * 33 + packed + b"." * 70
    rows = spark.createDataFrame([(0, bytearray(image)), (1, bytearray(b"nothing here")), (2, None), (3, bytearray(b""))], "blob_id int, data binary")
    out = {(r["blob_id"], r["format"], r["offset"], r["length"]): r["confidence"] for r in carve.carve(rows, signatures.signatures(spark)).collect()}
    assert out == {(0, "Png", 50, len(png)): 0.95, (0, "Zip", 83 + len(png), len(packed)): 0.9}


def test_lengths():
    length = scan.payload_length
    assert length(b"GIF89a" + b"." * 20 + b";more", "Gif") == 27 and length(b"GIF89a", "Gif") is None
    assert length(b"BM" + (30).to_bytes(4, "little") + b"." * 40, "Bmp") == 30 and length(b"BM" + (99).to_bytes(4, "little"), "Bmp") is None
    assert length(b"RIFF" + (20).to_bytes(4, "little") + b"." * 50, "Wav") == 28 and length(b"RIFF" + (20).to_bytes(4, "little"), "Riff") == 8
    assert length(b"x", "Zip") is None and length(b"x", "Nothing") is None and length(b"", "Png") is None
    assert length(b"..%PDF-1%%EOF\r\n%%EOF\n\nrest", "Pdf", 2) == 20 and length(b"%PDF-", "Pdf") is None
    assert length(b"\x89PNG\r\n\x1a\n" + chunk(b"IEND", b"") + b"rest", "Png") == 20
    head = b"n".ljust(124, b"\0") + b"00000000012\0".ljust(388, b"\0")
    assert length(head + b"x" * 10 + bytes(502) + bytes(1024) + b"rest", "Tar") == 512 * 4 and length(b"9" * 600, "Tar") is None
    page = lambda flags, data: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(data)]) + data
    assert length(page(0, b"abc") + page(4, b"d") + b"OggS more", "Ogg") == 31 + 29
    assert length(b"fLaC....fLaC", "Flac") == 8 and length(b"\xfd7zXZ\0....YZ..", "Xz") == 12
    assert length((16).to_bytes(4, "big") + b"ftyp" + b"." * 8 + (1).to_bytes(4, "big") + b"mdat" + (20).to_bytes(8, "big") + b"...." + b"\0\0\0\1\0\0\0\0", "Mp4") == 36


def test_masked_and_overlapping_magics(spark):
    assert list(scan.places(b"aaaa", b"aa")) == [0, 1, 2]
    assert list(scan.places(b"x1Yz_x2Yz", b"x0Yz", b"\xff\xf0\xff\xff")) == [0, 5]
    assert list(scan.places(b"\x12\x34\x1f", b"\x10", b"\xf0")) == [0, 2]
    rows = spark.createDataFrame([(1, bytearray(b"..x7Yz..")), (2, None)], "blob_id int, data binary")
    table = spark.createDataFrame([(0, "Odd", bytearray(b"x0Yz"), 1, 0.8, bytearray(b"\xff\xf0\xff\xff"))], "reg_order int, format string, magic binary, offset int, confidence double, mask binary")
    assert [tuple(r) for r in detect.deep_scan(rows, table).collect()] == [(1, "Odd", 1, 0.8, b".x7Yz..".hex().upper())]
