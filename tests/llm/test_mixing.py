import hashlib

import pytest
from pyspark.sql import functions as F

from bytequarry.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """Shares a budget by weight, resharing what is above twice a source's size."""
    names = sorted(sizes, key=lambda n: (n is None, n))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, done, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left, total = budget - sum(done.values()), sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / total > 2 * sizes[n]]
        if not over:
            return done | {n: left * weight[n] / total for n in free}
        done |= {n: 2.0 * sizes[n] for n in over}
        free -= set(over)
    return done


def rows_of(n, sources):
    return [(i, " ".join(["w"] * (1 + i * 7 % 30)), sources[i % len(sources)]) for i in range(n)]


def test_targets_and_shares(spark):
    rows = rows_of(600, ["b", "b", "b", "a", None, "c", "é"])
    out = mixing.mix(frame(spark, rows), rows_per_task=40).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = targets(sizes)
    taken = {s: sum(r["taken"] for r in out if r["source"] == s) for s in sizes}
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) < sum(taken.values()) + 31


def test_the_mix_is_the_prefix_of_finish_times_and_reruns_agree(spark):
    rows = rows_of(200, ["a", "b", "c"])
    key = lambda r: (r["doc_id"], r["taken"])
    first = sorted(mixing.mix(frame(spark, rows), rows_per_task=7).collect(), key=key)
    again = sorted(mixing.mix(frame(spark, rows[::-1]).repartition(5), rows_per_task=1000).collect(), key=key)
    assert [key(r) for r in first] == [key(r) for r in again]


def test_edges(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(None, "a b c", None), (1, None, "x"), (1, "", "x"), (2, "a b", "x"), (2, "a b", "x"), (3, "w " * 30000, None)]
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == 6
    assert sorted(r["size"] for r in out) == [0, 0, 2, 2, 3, 30000]
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert all(r["taken"] == 0 for r in mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect())


def test_mixed_documents_repeat_rows(spark):
    docs = frame(spark, rows_of(60, ["a", "b"]) + [(5, "same text", "a")] * 2)
    named = docs.withColumn("__row", F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(named, id_col="__row").collect())


def prefix_of_finish_times(rows, out, share=1.5):
    """Words taken by (id, source), from the targets of ``out``: all copies in order while they fit."""
    target = {r["source"]: (r["target"], r["source_size"]) for r in out}
    rank = {s: i for i, s in enumerate(sorted(target, key=lambda n: (n is None, n)))}
    draw = lambda i: int(hashlib.md5(f"mix-1|{i}".encode()).hexdigest()[:13], 16)
    copies, upto = [], dict.fromkeys(target, 0)
    for i, text, source in sorted(rows, key=lambda r: (draw(r[0]), r[0])):
        size = len(text.split())
        upto[source] += size
        want, whole = target[source]
        copies += [((whole * c + upto[source]) / want, rank[source], draw(i), i, source, size, c) for c in range(2) if want > 0]
    taken, total = {}, 0
    for _, _, _, i, source, size, _ in sorted(copies, key=lambda c: c[:4] + c[5:]):
        total += size
        if total > share * sum(len(t.split()) for _, t, _ in rows):
            break
        taken[i, source] = taken.get((i, source), 0) + size
    return taken


@pytest.mark.parametrize("rows_per_task", [5, 100_000])
def test_copies_that_finish_at_once(spark, monkeypatch, rows_per_task):
    """Sources of one document each: whole crowds finish at 0.5 and at 1, so the cut goes through a tie."""
    alike = [(i, "w w w", f"s{i:05d}") for i in range(400)]
    mixed = [(i, " ".join(["w"] * (1 + i % 5)), f"s{i % 150:05d}") for i in range(500)]
    for rows in (alike, mixed):
        out = mixing.mix(frame(spark, rows), rows_per_task=rows_per_task).collect()
        want = prefix_of_finish_times(rows, out)
        assert {(r["doc_id"], r["source"]): r["taken"] for r in out if r["taken"]} == want


def test_sql_and_operator_agree_on_null_and_repeated_ids(spark, tmp_path):
    import duckdb

    rows = rows_of(40, ["a", "b", None]) + [(None, "x y z", "a"), (None, "u v", "b"), (7, "p q r s", "c"), (7, "p q", "a"), (7, "p q", "a"), (8, None, "a")]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(mixing.MIX_SQL).fetchall()
    got = mixing.mix(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, want)) == sorted(map(key, got))
