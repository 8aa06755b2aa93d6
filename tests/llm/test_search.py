import numpy as np
import pytest
from pyspark.sql import functions as F

from bytequarry.llm import pruned_graph, voronoi_topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r") for i, v in rows], SCHEMA)


def clustered(n, dim=16, seed=1):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(8, dim))
    return [(i, [float(x) for x in np.float32(centres[random.integers(8)] + 0.4 * random.normal(size=dim))]) for i in range(n)]


ODD = [(10**6, None), (10**6 + 50, [None, 1.0]), (10**6 + 100, [float("nan")] * 16), (10**6 + 150, []), (None, [1.0] * 16), (10**6 + 200, [1.0, 2.0, 3.0]), (10**6 + 201, [2.0, 2.0, 3.0])]


def brute_topk(rows, every, k):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in fine:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize("parts", [50_000, 37])
def test_topk_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(voronoi_topk, "ROWS_PER_PART", parts)
    monkeypatch.setattr(voronoi_topk, "QUERIES_PER_PIVOT", 2)
    rows = clustered(400) + ODD + [(i, [0.25] * 16) for i in range(2000, 2120)]
    out = voronoi_topk.topk_join(frame(spark, rows).repartition(6), F.col("vec_id") % 10 == 0, k=5)
    assert {tuple(r) for r in out.collect()} == brute_topk(rows, 10, 5)


def test_topk_of_little(spark):
    assert voronoi_topk.topk_join(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert voronoi_topk.topk_join(frame(spark, [(0, None)]), F.col("vec_id") % 50 == 0).count() == 0
    out = voronoi_topk.topk_join(frame(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in out) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]


def test_topk_of_a_repeated_query(spark, monkeypatch):
    monkeypatch.setattr(voronoi_topk, "QUERIES_PER_PIVOT", 2)
    rows = clustered(300)
    rows += [rows[0]] * 8 + [rows[10]] * 3 + [(20, rows[11][1])] * 20 + [(20, rows[7][1])] * 2 + [(31, [2.0] * 16)] * 9 + [(40, [2.0] * 16)] * 7
    got = sorted(tuple(r) for r in voronoi_topk.topk_join(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, k=5).collect())
    want = []
    for q in range(0, 300, 10):
        asked = {tuple(np.floor(256 * np.array(v))) for i, v in rows if i == q}
        pairs = sorted((-int(np.dot(a, np.floor(256 * np.array(v)))), i) for i, v in rows if i != q for a in asked)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(pairs[:5], 1)]
    assert got == want


def brute_nearest(rows, every, k):
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in fine:
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in fine if i != q and len(a) == len(b))[:k]
    return out


def test_graph_recall(spark):
    rows = clustered(3000, 24, 2) + ODD + [(9000, [0.0] * 24)] + [(i, [0.5] * 24) for i in range(5000, 5300)]
    vectors = frame(spark, rows).repartition(4)
    index = pruned_graph.build_index(vectors, shard_rows=900)
    assert index.agg(F.sum("rows")).first()[0] == 3302
    out = pruned_graph.search(index, vectors.where(F.col("vec_id") % 50 == 0))
    want, got = brute_nearest(rows, 50, 10), {}
    for r in out.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert set(got) == set(want)
    hits = 0
    for q, found in want.items():
        listed = [got[q][k] for k in sorted(got[q])]
        assert listed == sorted(listed) and all(i != q for _, i in listed)
        assert len(listed) == len(found)
        hits += len({i for _, i in listed} & {i for _, i in found}) / len(found)
    assert hits / len(want) >= 0.95


def test_graph_of_little(spark):
    assert pruned_graph.nearest(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    out = pruned_graph.nearest(frame(spark, [(0, [1.0]), (2, [3.0]), (1, [3.0]), (4, [1.0])]), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in out) == [(0, 1, 4, 0.0), (0, 2, 1, 2.0), (0, 3, 2, 2.0)]


def test_graph_of_a_repeated_query(spark):
    rows = clustered(400, 24, 3)
    rows += [rows[0]] * 20 + [(100, [x + 0.001 * j for x in rows[100][1]]) for j in range(150)] + [(i, rows[0][1]) for i in range(1001, 1004)]
    vectors = frame(spark, rows).repartition(3)
    out = pruned_graph.search(pruned_graph.build_index(vectors), vectors.where(F.col("vec_id") == 0)).collect()
    want = brute_nearest(rows, 1000, 10)[0]
    assert [r["vec_id"] for r in sorted(out, key=lambda r: r["rank"])] == [i for _, i in want]
    out = pruned_graph.search(pruned_graph.build_index(vectors), frame(spark, [rows[100]])).collect()
    assert len(out) == 10 and all(r["vec_id"] != 100 for r in out)


def test_equal_distances_go_to_the_smallest_ids(spark):
    rows = [(0, [1.0] * 60)] + [(61 - i, [1.0 + (j == i) for j in range(60)]) for i in range(60)] + [(0, [1.0] * 60)] * 13
    out = pruned_graph.nearest(frame(spark, rows), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out) == [(i, i + 1, 1.0) for i in range(1, 11)]


def test_recall_over_many_shards(spark):
    rows = clustered(4400, 32, 5)
    vectors = frame(spark, rows).repartition(4)
    index = pruned_graph.build_index(vectors, shard_rows=200)
    assert index.count() >= 20
    got = {}
    for r in pruned_graph.search(index, vectors.where(F.col("vec_id") % 100 == 0)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(rows, 100, 10)
    assert sum(len(got[q] & {i for _, i in found}) for q, found in want.items()) >= 0.99 * 10 * len(want)


def test_every_node_can_be_reached():
    random = np.random.default_rng(4)
    points = np.concatenate([random.normal(size=(40, 3)) * 1e-3 + 50 * c for c in range(30)]).astype(np.float32)
    lost = np.full((len(points) + 1, 2), -1, np.int32)
    for links, entry in (pruned_graph.build(points, degree=3, beam=4), (pruned_graph._reachable(points, lost, 7), 7)):
        seen, front = {entry}, [entry]
        while front:
            front = [x for i in front for x in links[i].tolist() if x >= 0 and x not in seen]
            seen |= set(front)
        assert len(seen) == len(points)


def test_products_beyond_64_bits_are_an_error():
    huge = np.array([[2.0**40, 1.0]])
    assert voronoi_topk._products(huge[:, :1] / 2**10, huge[:, :1] / 2**10)[0, 0] == 2**60
    with pytest.raises(OverflowError):
        voronoi_topk._products(huge, huge)
