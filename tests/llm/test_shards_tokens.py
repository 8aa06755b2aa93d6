import math
import zlib

from bytequarry.llm import hash_tree, token_hist

TOPOLOGY = hash_tree.Topology.uniform(4, 2, 5)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, shard int, slot string")


def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, None), (7, ""), (7, "text 7"), (8, "é" * 50000)]
    out = hash_tree.assign_shards(frame(spark, rows), TOPOLOGY, rows_per_task=5).collect()
    assert len(out) == len(rows)
    by_shard = {}
    for r in out:
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert set(by_shard) == set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    moved = sum(r["grown_shard"] == 40 for r in out)
    assert abs(moved - len(rows) / 41) < 4 * math.sqrt(len(rows) / 41)
    text = dict(rows[:2000])
    plain = [r for r in out if r["doc_id"] is not None and r["doc_id"] > 8]
    assert all(r["size"] == len(text[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in plain)
    null = next(r for r in out if r["doc_id"] is None)
    assert (null["size"], null["text_crc32"]) == (16, 0)
    assert len({(r["shard"], r["grown_shard"]) for r in out if r["doc_id"] == 7}) == 1


def test_very_long_runs_are_counted_whole(spark):
    import random
    import re

    encoder = token_hist._encoder(token_hist.TOKENIZER, token_hist.PATTERN)
    short, rnd = re.compile(f"[{token_hist._BLANKS}]{{3,}}"), random.Random(3)
    kinds = [" ", "  ", "\n", "\t", "a", "b1", "...", "'s", "\u3000", "\x1c", "\x85", "é"]
    for _ in range(800):
        text = "".join(rnd.choice(kinds) * rnd.randint(1, 6) for _ in range(rnd.randint(0, 12)))
        assert token_hist.count_tokens(encoder, text, short) == len(encoder.encode_ordinary(text))
    rows = [(i, c * 2_000_000 + tail) for i, (c, tail) in enumerate((c, t) for c in " \na1" for t in ("", "x"))]
    got = [r["tokens"] for r in token_hist.encoded_lengths(frame(spark, rows)).collect()]
    pieces = [len(encoder._encode_single_piece(c * 2_000_000)) for c in " \n"]
    assert sorted(got)[-1] >= max(pieces) and pieces[0] in got and pieces[1] in got and min(got) > 0


def test_growing_moves_rows_only_into_the_new_subtree(spark):
    rows = frame(spark, [(i, "x") for i in range(1500)])
    topology = hash_tree.Topology(((3, 1), (2,)))
    for _ in range(3):
        out = hash_tree.assign_shards(rows, topology).collect()
        assert all(r["grown_shard"] in (r["shard"], topology.shards) for r in out)
        topology = topology.grow()
    counts = {}
    for r in hash_tree.assign_shards(rows, topology).collect():
        counts[r["shard"]] = counts.get(r["shard"], 0) + 1
    assert len(counts) == topology.shards and all(abs(c - 1500 / 9) < 60 for c in counts.values())


def test_no_rows(spark):
    assert hash_tree.assign_shards(frame(spark, []), TOPOLOGY).count() == 0
    assert token_hist.context_totals(token_hist.length_histogram(token_hist.encoded_lengths(frame(spark, [])))).count() == 0


def test_histogram_answers_every_limit(spark):
    texts = ["a b c d", "", None, "hello world " * 50, "x", "x", "naïve  text\n\n" * 30, "word " * 9000]
    lengths = token_hist.encoded_lengths(frame(spark, list(enumerate(texts))))
    want = sorted(len(token_hist._encoder(token_hist.TOKENIZER, token_hist.PATTERN).encode_ordinary(t or "")) for t in texts)
    hist = token_hist.length_histogram(lengths)
    for r in token_hist.context_totals(hist, block=16).collect():
        limit = r["context_limit"]
        fit = [x for x in want if x <= limit]
        assert r["n_docs"] == want.count(limit) and r["docs_fitting"] == len(fit) and r["docs_cut"] == len(want) - len(fit)
        assert r["total_tokens"] == sum(want) and r["kept_whole_tokens"] == sum(fit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in want) and r["quantile"] == len(fit) / len(want)
    for r in token_hist.totals_at(hist, [1, 10, 100, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in want)
        assert r["docs_cut"] == sum(x > r["context_limit"] for x in want)
    got = {r["share"]: r["tokens"] for r in token_hist.length_quantiles(hist, [0.25, 0.5, 1.0]).collect()}
    assert got == {q: want[math.ceil(q * len(want)) - 1] for q in (0.25, 0.5, 1.0)}
