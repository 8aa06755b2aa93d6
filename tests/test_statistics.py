import math
import random

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import codecs, kernels, ladders, strings
from bytequarry.operators import bytestats, detect, fingerprint, intervals, relational, segmentation, trial, windows
from bytequarry.sources import archives, signatures


def blobs(spark, *data):
    return spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "blob_id int, data binary")


def test_known_answers(spark):
    every = bytes(range(256))
    out = bytestats.statistics(blobs(spark, b"\xaa" * 256, every, b"\0" * 128 + b"\1" * 128, every * 100, b"\x42" * 1024, b"\0" * 100, b"", None)).orderBy("blob_id").collect()
    assert [r["entropy"] for r in out[:3]] == pytest.approx([0, 8, 1])
    assert out[3]["chi_square"] == pytest.approx(0) and out[4]["chi_square"] > 1000 and out[5]["mean"] == 0
    assert (out[6]["entropy"], out[6]["chi_square"], out[6]["p_value"], out[6]["unique_bytes"], out[6]["least_common"]) == (0, 0, 1, 0, 0)
    assert out[7]["entropy"] is None
    assert (out[2]["most_common"], out[2]["least_common"], out[0]["unique_bytes"]) == (0, 0, 1)


def test_checksums(spark):
    row = blobs(spark, b"123456789").select(*[codecs.checksum(n)("data").alias(n) for n in ("crc32", "crc32c", "adler32", "crc16", "crc64")]).first()
    assert (row["crc32"], row["crc32c"], row["adler32"], row["crc16"], int(row["crc64"])) == (0xCBF43926, 0xE3069283, 0x091E01DE, 0xBB3D, 0x995DC9BBDF1939FA)


@pytest.mark.parametrize("name", sorted(codecs.ENCODERS))
def test_round_trips(name):
    for pattern, data in trial.patterns(1024).items():
        packed = codecs.ENCODERS[name](data)
        assert codecs.DECODERS[name](packed, len(data) + 1) == data, pattern
    assert codecs.DECODERS[name](codecs.ENCODERS[name](b""), 1) == b""


def test_decoders_stop_and_fail_softly(spark):
    bomb = codecs.ENCODERS["Zlib"](bytes(10**6))
    assert len(codecs.DECODERS["Zlib"](bomb, 1000)) == 1000
    out = blobs(spark, codecs.ENCODERS["Zlib"](b"words " * 3)[:-6], None, b"junk").select(codecs.decode("Zlib")("data").alias("d")).collect()
    assert [r["d"] for r in out] == [None] * 3


TEXT = b"some text that is long enough to be packed well, again and again. " * 20


def test_chains(spark):
    data = codecs.ENCODERS["Gzip"](codecs.ENCODERS["Bzip2"](TEXT))
    out = trial.chain_layers(blobs(spark, data, None, b"")).orderBy("depth").collect()
    assert [(r["blob_id"], r["algorithm"], r["output_size"]) for r in out][:2] == [(0, "Gzip", len(codecs.ENCODERS["Bzip2"](TEXT))), (0, "Bzip2", len(TEXT))]
    assert all(r["blob_id"] == 0 for r in out) and out[0]["input_size"] == len(data) and out[0]["confidence"] == 0.3
    packed = archives.create_zip(["a/", "b.txt"], [b"", codecs.ENCODERS["Xz"](TEXT)])
    layers = trial.chain_of(packed)
    assert [(x["algorithm"], x["confidence"]) for x in layers[:2]] == [("Zip", 0.9), ("Xz", 0.3)] and layers[1]["output_size"] == len(TEXT)
    stored = b"\0" + len(TEXT).to_bytes(2, "little") + (len(TEXT) ^ 0xFFFF).to_bytes(2, "little") + TEXT
    assert ("Deflate", 0.85) in fingerprint.of_blob(stored)
    pairs = b"".join(bytes((20 + 7 * i % 100, 97 + i % 2)) for i in range(60))
    (first,) = trial.chain_of(pairs, 1)  # a fingerprint goes before the blind order
    assert first["algorithm"] == "RLE" and first["confidence"] > 0.4 and first["output_size"] == sum(pairs[::2])


def test_trials(spark):
    packed = codecs.ENCODERS["Gzip"](TEXT)
    rows = trial.trial_decode(blobs(spark, packed, TEXT[:7], None, b"")).collect()
    assert [(r["rank"], r["algorithm"], r["kind"], r["error"]) for r in rows if r["blob_id"] == 0] == [(0, "Gzip", "magic", None)]  # a magic stops the slow ones
    assert not any(r["blob_id"] == 2 for r in rows) and all(r["rank"] is None for r in rows if r["blob_id"] == 3)
    every = trial.trial_decode(blobs(spark, packed), every=True).collect()
    done = [r for r in every if r["error"] is None]
    assert [r["rank"] for r in done] == list(range(len(done))) and [r["output_entropy"] for r in done] == sorted(r["output_entropy"] for r in done)
    found = {(r["algorithm"], r["kind"]): r for r in every}
    assert found["Gzip", "stream"]["improved"] and found["Gzip", "stream"]["output_size"] == len(TEXT) and found["Xz", "stream"]["error"]
    opened = trial.attempts(archives.create_zip(["a"], [TEXT]), True)
    assert ("Zip", "archive", len(TEXT)) in [a[:3] for a in opened]


def test_success_rule():
    noise = random.Random(1).randbytes(2000)
    assert trial.succeeded(noise, TEXT * 2) and trial.succeeded(noise, b"plain text here") and not trial.succeeded(TEXT, noise) and not trial.succeeded(noise, b"")
    assert trial.succeeded(TEXT, b"\x89PNG\r\n\x1a\n" + noise[:50]) and not trial.succeeded(TEXT, noise[:8])
    assert trial.succeeded(noise, noise[:3] + b"\x28\xb5\x2f\xfd" + noise[:50])  # a signature anywhere in the first bytes
    assert not trial.succeeded(b"x" * 10, b"y" * 1001) and not trial.succeeded(noise, noise[::-1], "BWT")


def test_blob_and_table_fingerprints_agree(spark):
    draw = random.Random(8)
    kinds = [TEXT, draw.randbytes(3000), bytes(500), b"ab" * 99, bytes(draw.choices([0, 1, 2, 200], [8, 4, 2, 1], k=900)), b"\x05\x03\x04\x05\x06\x07" + draw.randbytes(40), b"ab", b""]
    kinds += [codecs.ENCODERS[n](TEXT) for n in ("Deflate", "RLE", "MTF", "BWT", "LZW", "LZSS", "Huffman", "Gzip")] + [draw.randbytes(n) for n in (3, 4, 5, 8, 17, 18, 33)]
    names = set(trial.SUGGESTED)
    want = {(i, a): c for i, data in enumerate(kinds) for a, c in fingerprint.of_blob(data)}
    got = {(r["blob_id"], r["algorithm"]): r["confidence"] for r in fingerprint.fingerprints(blobs(spark, *kinds)).collect() if r["algorithm"] in names}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 10


def test_more_checksums(spark):
    row = blobs(spark, b"abc", None).select(*[codecs.checksum(n)("data").alias(n) for n in ("xxh32", "xxh64")], codecs.blake2b()("data").alias("b")).collect()
    assert (row[0]["xxh32"], int(row[0]["xxh64"])) == (0x32D153FF, 0x44BC2CF5AD770999) and tuple(row[1]) == (None, None, None)
    assert row[0]["b"].startswith("ba80a53f981c4d0d") and len(row[0]["b"]) == 128


def test_headers_that_are_nearly_right(spark):
    png = bytes.fromhex("89504e470d0a1a0a")
    hurt = b"X" * 10 + png[:6] + b"??" + b" " * 30
    rows = detect.fuzzy_headers(blobs(spark, hurt, png + b"rest", b"", None, b"." * 1030 + png), signatures.signatures(spark)).collect()
    found = {(r["blob_id"], r["offset"], r["format"]): (r["kind"], r["matched"], r["total"], r["confidence"]) for r in rows}
    assert found[0, 10, "Png"] == ("Fuzzy", 6, 8, pytest.approx(0.95 * 0.75 * 0.7)) and found[1, 0, "Png"] == ("Exact", 8, 8, 0.95)
    assert not any(b in (2, 3, 4) and f == "Png" for b, _, f in found)
    assert not detect.fuzzy_headers(blobs(spark, hurt), signatures.signatures(spark), fuzzy=False).where("format = 'Png'").count()


def test_codecs_on_bytes_that_are_not_theirs():
    draw = random.Random(6)
    for name, decode in codecs.DECODERS.items():
        for _ in range(60):
            try:
                assert len(decode(draw.randbytes(draw.randint(0, 60)), 5000)) <= 5000, name
            except Exception as problem:
                assert not isinstance(problem, (MemoryError, RecursionError, AssertionError)), name


def test_incompressible_and_solid_groups(spark):
    names = {"a.RS": 0, "x/y.csproj": 1, "n.tsv": 2, "l.o": 3, "p.Jpeg": 4, "s.flac": 5, "z.tar": 6, "d.idx": 7, "none": -1, "q.docx": -1}
    rows = spark.createDataFrame([(n, False) for n in names] + [("a.rs", True)], "name string, packed boolean")
    got = [(r["name"], r["g"]) for r in rows.select("name", relational.solid_group(F.col("name"), F.col("packed")).alias("g")).collect()]
    assert got == [*names.items(), ("a.rs", -2)]


def test_windows_and_regions(spark):
    random.seed(1)
    step = bytes(4096) + bytes(random.randrange(256) for _ in range(4096))
    rows = windows.entropy_tumbling(blobs(spark, step, b"", b"abc"), 256)
    assert rows.where("blob_id = 0").count() == 32 and rows.where("blob_id = 1").count() == 0 and rows.where("blob_id = 2").first()["length"] == 3
    regions = windows.region_merge(blobs(spark, step)).orderBy("offset").collect()
    assert (regions[0]["offset"], regions[0]["length"], regions[0]["entropy"]) == (0, 4096, 0)
    found = segmentation.boundaries(blobs(spark, step)).orderBy("offset").collect()
    assert len(found) >= 2 and abs(found[1]["offset"] - 4096) <= 256  # the last window before the change
    island = bytes(4096) + bytes(random.randrange(256) for _ in range(4096)) + bytes(4096)
    spans = windows.high_entropy_spans(windows.entropy_heatmap(blobs(spark, island)), 7.0).collect()
    assert [(r["offset"], r["end"]) for r in spans] == [(4096, 8192)]


def test_ladders(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.0, 5.9, 7.5, 7.95)], "e double")
    got = [r[0] for r in rows.select(ladders.classify_region(F.col("e"))).collect()]
    assert got == ["Constant/empty", "Plaintext/structured", "Structured data", "Strong compression", "Encrypted/random"]


def test_detection(spark):
    sig, ext = signatures.signatures(spark), signatures.extensions(spark)
    rows = spark.createDataFrame(
        [(0, bytearray(b"7z\xbc\xaf\x27\x1c\0\0"), "a.bin"), (1, bytearray(b"\xfd7zXZ\0\0\0"), "b"), (2, bytearray(b"nothing"), "x.TAR.GZ"), (3, bytearray(b""), "plain"), (4, None, None)],
        "blob_id int, data binary, path string",
    )
    out = {r["blob_id"]: (r["format"], r["confidence"]) for r in detect.detect(rows, sig, ext).collect()}
    assert out == {0: ("SevenZip", 0.95), 1: ("Xz", 0.95), 2: ("TarGz", 0.4), 3: (None, None), 4: (None, None)}
    hits = detect.deep_scan(blobs(spark, b"..PK\x03\x04..PK\x03\x04\x89PNG\r\n\x1a\n"), sig).collect()
    assert {(r["format"], r["offset"]) for r in hits} == {("Zip", 2), ("Zip", 8), ("Png", 12)}
    fuzzy = detect.fuzzy_headers(blobs(spark, b"\x89PNX\r\n\x1a\n"), sig).where("format = 'Png'").first()
    assert fuzzy["confidence"] == pytest.approx(0.95 * 7 / 8 * 0.7)


def test_intervals_equal_the_greedy_rule(spark):
    rnd = random.Random(4)
    rows = [(b, rnd.randrange(40), rnd.randrange(1, 15), rnd.choice("xyz"), 60) for b in range(20) for _ in range(12)]
    spans = spark.createDataFrame(rows, "blob_id int, offset int, length int, format string, size int")
    want = set()
    for b in range(20):
        kept = []
        for _, o, n, f, _ in sorted({r for r in rows if r[0] == b}, key=lambda r: (r[1], -r[2], r[3])):
            if not any(x <= o and o + n <= x + m for x, m, _ in kept):
                kept.append((o, n, f))
        want |= {(b, *k) for k in kept}
    got = intervals.outermost(spans.distinct(), "format").select("blob_id", "offset", "length", "format").collect()
    assert {tuple(r) for r in got} == want
    for r in intervals.asof_next(spans.drop("length")).collect():
        later = [o for b, o, *_ in rows if b == r["blob_id"] and o > r["offset"]]
        assert r["length"] == min(later, default=60) - r["offset"]


def test_solid_blocks_equal_the_greedy_rule(spark):
    rnd = random.Random(2)
    rows = [(g, i, rnd.randrange(1, 50)) for g in (-1, 0, 3) for i in range(200)]
    out = relational.solid_blocks(spark.createDataFrame(rows, "group int, seq int, size int"), 100).collect()
    for g in (-1, 0, 3):
        held = block = 0
        for r in sorted((r for r in out if r["group"] == g), key=lambda r: r["seq"]):
            if held and held + r["size"] > 100:
                held, block = 0, block + 1
            held += r["size"]
            assert r["block"] == block


def test_strings_and_patterns(spark):
    rows = strings.pattern_hits(blobs(spark, b"\0\0hello\xffworld\0ab", b"", None), "[\\x20-\\x7E]{4,}").collect()
    assert {(r["blob_id"], r["offset"], r["value"]) for r in rows} == {(0, 2, "hello"), (0, 8, "world")}
    found = segmentation.repeated_patterns(blobs(spark, b"ABCDEFGHIJKLMNOP" * 16), (8, 8)).collect()
    assert {r["n"] for r in found} <= {15, 16} and len(found) == 16


def test_archives(spark):
    entries = spark.createDataFrame([("a", "x.txt", bytearray(b"one")), ("a", "y.txt", bytearray(b"two" * 100)), ("b", "z", None)], "g string, name string, data binary")
    made = archives.create_archives(entries, "g")
    out = archives.archive_entries(made, "g", "archive").collect()
    assert {(r["g"], r["name"], r["size"]) for r in out} == {("a", "x.txt", 3), ("a", "y.txt", 300), ("b", "z", 0)}
    small = archives.create_archives(spark.createDataFrame([("a", f"n{i}", bytearray(b"x" * 100)) for i in range(7)] + [("a", "n3", bytearray(b"y")), (None, "m", None)], "g string, name string, data binary"), "g", archive_bytes=250)
    parts = {(r["g"], r["volume"]): archives.entries_of(bytes(r["archive"])) for r in small.collect()}
    names = {k: [e[1] for e in v] for k, v in parts.items()}
    assert names == {("a", 0): ["n0", "n1", "n2"], ("a", 1): ["n3", "n3", "n4"], ("a", 2): ["n5", "n6"], (None, 0): ["m"]}
    cut = archives.archive_entries(blobs(spark, archives.create_tar(["one", "two"], [b"1" * 600, b"2" * 600])[:2200])).collect()
    assert [r["name"] for r in cut if r["error"] is None] == ["one"] and any(r["error"] for r in cut)
    nested = archives.create_zip(["in.zip"], [archives.create_zip(["deep.gz"], [codecs.ENCODERS["Gzip"](b"core")])])
    found = archives.recursive_extract(blobs(spark, nested, b"no archive", None)).collect()
    assert {(r["depth"], r["path"], r["size"]) for r in found if r["depth"] == 3} == {(3, "in.zip/deep.gz/data", 4)}
    assert archives.recursive_extract(blobs(spark, b"")).count() == 0


def test_fingerprints(spark):
    out = {(r["blob_id"], r["algorithm"]): r["confidence"] for r in fingerprint.fingerprints(blobs(spark, b"\x01\x05\x00\xfa\xffhello", bytes([3, 65]) * 40, b"", b"\0" * 60 + b"\1" * 20 + b"\2" * 10 + b"\3" * 5)).collect()}
    assert out[0, "Deflate"] == 0.85 and out[1, "RLE"] == pytest.approx(0.3 + 0.4 + (1 - 1 / 256) * 0.15)
    assert not any(b == 2 for b, _ in out) and out[3, "MTF"] == pytest.approx(0.85)


def test_serial_correlation_wraps(spark):
    data = bytes([1, 5, 9, 2, 2, 7])
    mean = sum(data) / 6
    num = sum((a - mean) * (b - mean) for a, b in zip(data, data[1:] + data[:1]))
    want = num / math.fsum((a - mean) ** 2 for a in data)
    assert blobs(spark, data).select(kernels.serial_correlation("data")).first()[0] == pytest.approx(want)


def test_field_lengths_up_to_4096_and_of_low_confidence(spark):
    draw = random.Random(3)
    faint = bytearray(draw.randbytes(4000))
    for i in range(0, 4000, 40):  # one byte in twenty stays the same over 40 bytes
        faint[i], faint[i + 13] = 7, 9
    rows = segmentation.field_length(blobs(spark, draw.randbytes(3000) * 4, bytes(faint), b"short")).collect()
    assert [(r["lag"], r["confidence"]) for r in rows if r["blob_id"] == 0] == [(3000, 1.0)]
    found = {r["lag"]: r["confidence"] for r in rows if r["blob_id"] == 1}
    assert 0.02 <= found[40] < 0.1 and all(lag % 40 == 0 for lag in found) and not any(r["blob_id"] == 2 for r in rows)


def test_trials_decode_whole_outputs_or_fail(monkeypatch):
    for text in (random.Random(4).randbytes(800_000).hex().encode(), b"words and words again. " * 1000):
        assert trial.attempt(codecs.ENCODERS["Gzip"](text), "Gzip", "stream") == text
    packed = codecs.ENCODERS["Gzip"](random.Random(4).randbytes(800_000).hex().encode())
    assert trial.chain_of(packed, 1)[0]["output_size"] == 1_600_000
    monkeypatch.setattr(codecs, "OUTPUT_BYTES", 1000)
    with pytest.raises(ValueError):
        trial.attempt(codecs.ENCODERS["Gzip"](text), "Gzip", "stream")


def test_incompressible_reads_the_middle_of_long_blobs(spark):
    even = bytes(range(256)) * 512
    rows = bytestats.incompressible(blobs(spark, even + b"a" * 100_000 + even, even * 3)).orderBy("blob_id").collect()
    counts = [1024 + 100_000 * (i == 97) for i in range(256)]
    assert rows[0]["chi_square"] == pytest.approx(256 * sum(n * n for n in counts) / sum(counts) - sum(counts))
    assert [r["incompressible"] for r in rows] == [False, True]
