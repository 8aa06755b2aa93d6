import lzma
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bytequarry.functions import blocks, codecs, many
from bytequarry.operators import trial


def odd_blobs():
    draw = random.Random(7)
    text = "".join(draw.choice(["the ", "quick ", "aaaa", "\n", "Größe "]) for _ in range(900)).encode()
    out = [b"", b"a", b"ab", b"aaaa", b"", bytes(300), b"a" * 5000, b"ab" * 800, b"abc" * 50, b"mississippi" * 9, text, text * 3, draw.randbytes(3000), draw.randbytes(700) + b"q" * 4000]
    out += [b"x" * 3000 + b"y" + b"x" * 3000, bytes(draw.choices(b"ab", k=5000)), bytes(range(256)) * 5, bytes.fromhex("ff00") * 200 + bytes(513), *trial.patterns(2048).values()]
    out += [bytes(draw.choices(range(draw.randint(1, 256)), k=draw.randint(0, 400))) for _ in range(150)]
    return [*out, b"x" * 70_000 + b"y" + b"x" * 70_000, b""]


ALONE = {name: (codecs.ENCODERS[name], codecs.DECODERS[name]) for name in many.ENCODERS}


@pytest.mark.parametrize("name", sorted(many.ENCODERS))
def test_streams_of_many_blobs_are_those_of_each(name):
    blobs = odd_blobs()
    packed = many.ENCODERS[name](blobs)
    assert packed == [ALONE[name][0](b) for b in blobs]
    assert codecs.decode_each(name, packed, 1 << 20) == blobs
    assert many.ENCODERS[name]([]) == [] and many.ENCODERS[name]([b""] * 3) == [ALONE[name][0](b"")] * 3


@pytest.mark.parametrize("name", sorted(many.DECODERS))
def test_many_broken_streams_are_judged_as_each_alone(name):
    draw = random.Random(3)
    blobs = [b for b in odd_blobs() if len(b) < 6000][:90]
    streams = []
    for packed in map(ALONE[name][0], blobs):
        broken = bytearray(packed)
        for _ in range(draw.randint(0, 2)):
            if broken:
                broken[draw.randrange(len(broken))] = draw.randrange(256)
        streams.append(bytes(broken[: draw.choice([len(broken), len(broken), max(0, len(broken) - draw.randint(0, 9))])]))
    streams += [draw.randbytes(draw.randint(0, 60)) for _ in range(60)]
    for limit in (1 << 20, 200):
        want = codecs._each(lambda b, most=limit: codecs.decode_whole(name, b, most), streams)
        assert codecs.decode_each(name, streams, limit) == want


def test_xz_streams_are_those_of_the_preset():
    for blob in (b for b in odd_blobs() if b):
        packed = codecs.ENCODERS["Xz"](blob)
        assert packed == lzma.compress(blob) and codecs.DECODERS["Xz"](packed, len(blob) + 1) == blob


def test_round_trips_tell_a_codec_that_fails(spark, monkeypatch):
    rows = spark.createDataFrame([(0, bytearray(b"some text")), (1, None), (2, bytearray()), (3, bytearray(b"zz" * 500))], "blob_id int, data binary")
    out = rows.select("blob_id", F.explode(codecs.round_trips(("LZ77", "Xz", "Deflate"))("data")).alias("c")).select("blob_id", "c.*").collect()
    assert {tuple(r) for r in out} == {(i, c, True) for i in range(4) for c in ("LZ77", "Xz", "Deflate")} and len(out) == 12
    monkeypatch.setitem(many.ENCODERS, "LZ77", lambda blobs: [b[:-1] for b in blobs])
    monkeypatch.setitem(codecs.DECODERS, "Xz", lambda data, limit: b"zz")
    packed = codecs.encode_each("LZ77", [b"abcabcabc", None])
    assert codecs.decode_each("LZ77", packed, 99) == [None, None]


def test_round_trip_query_has_a_row_for_null_texts(spark, tmp_path):
    texts = [(1, "one text"), (2, None), (3, ""), (4, "Größe " * 40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["codec_round_trip"](spark, str(tmp_path)).collect()
    assert len(out) == 60 and all(r["same"] is True for r in out) and {r["blob_id"] for r in out} == {1, 2, 3, 4}


def test_own_codecs_keep_up_with_a_table():
    """Round trips of the six codecs by arrays; one by one they take some three times as long."""
    draw = random.Random(5)
    words = [bytes(draw.choices(range(97, 123), k=draw.randint(2, 9))) for _ in range(800)]
    blobs = [b" ".join(draw.choices(words, k=draw.randint(100, 600))) for _ in range(250)]

    def took(run):
        began = time.process_time()
        for name in many.ENCODERS:
            assert run(name) == blobs
        return time.process_time() - began

    together = took(lambda name: codecs.decode_each(name, codecs.encode_each(name, blobs)))
    alone = took(lambda name: [ALONE[name][1](ALONE[name][0](b), 1 << 20) for b in blobs])
    assert together < 0.6 * alone
