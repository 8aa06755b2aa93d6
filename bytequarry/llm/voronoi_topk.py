"""Exact top-k search by inner product, as a Voronoi join.

Pivots split space into cells. Queries are grouped by their nearest pivot, and so
are the data vectors. A first pass over the data keeps, for each cell, the k + 1
members of different ids nearest to the pivot: these summaries give each query a score that its
answers must reach, each group of queries the least such score and its radius,
and each pair of cells the largest product of a query and a data pivot. With
these bounds a data vector is copied only to the groups where it can still be an
answer. Each group is solved on its own; one that many vectors are copied to is
solved in salted parts whose lists are merged.

A query's own rows are no answers, and there can be many. So a list holds k rows
of an id at most and 2 * k in all: k or fewer of them are the query's own. Of the
summaries each id has one row, so that all but one are another's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.common import draw, id_text
from bytequarry.llm.vectors import by_dimension, fewest_of_equal, places
from bytequarry.session import materialize

K = 5
SCALE = 256
#: Bound of the sample that places the pivots, and of the pivots of one vector length.
SAMPLE_ROWS = 4096
MAX_PIVOTS = 512
#: Queries a pivot stands for, and vectors copied to one part of a group.
QUERIES_PER_PIVOT = 128
ROWS_PER_PART = 50_000
_EXACT = float(2**53)


def quantise(matrix: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * matrix)


def _pivots(matrix: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Centres of a few rounds of Lloyd's algorithm, from evenly spaced distinct rows."""
    distinct = np.unique(matrix, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    for _ in range(rounds):
        cell = _nearest(matrix, centres)
        for i in range(len(centres)):
            if (own := cell == i).any():
                centres[i] = matrix[own].mean(0)
    return centres


def _nearest(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * matrix @ centres.T).argmin(1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; exact in doubles where these can't overflow 53 bits, and an error where they could overflow 64."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    if most >= 2.0**63 or max(np.abs(a).max(), np.abs(b).max()) >= 2.0**63:
        raise OverflowError("inner products of these vectors can leave the range of 64-bit integers")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best scores, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    scores = scores[:, order]
    width = scores.shape[1]
    bits = max(1, int(width - 1).bit_length())
    if np.abs(scores).max(initial=0) < 2 ** (62 - bits):
        key = (scores << bits) + (width - 1 - np.arange(width))
        top = np.argpartition(-key, min(k, width) - 1, axis=1)[:, :k] if width > k else np.tile(np.arange(width), (len(scores), 1))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
    else:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return order[top]


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix, np.float64)], pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column.to_pylist()])


def topk_join(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest integer inner product for each query.

    Components are floor(scale * x), x as double. A query's own row (any row of
    its id) is no answer; ties go to the smaller id; all rows are returned if
    there are fewer than k. Only vectors of one length meet. Null ids, null or
    empty vectors and those with null or non-finite components take no part.
    Repeated rows of an id answer once for each row, and a repeated query is
    answered once. An empty table gives no rows; other columns are ignored.
    Scores are 64-bit integers: vectors whose products could be larger are an error.
    """
    spark = vectors.sparkSession
    keep = k + 1
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))

    queries = rows.where("is_query").select("vec_id", "vector")
    asked = materialize(queries.mapInArrow(_encode(scale), "vec_id long, dim int, vector binary"), "asked")
    rep = F.sha2("vector", 256).alias("rep")  # not the least id, which several vectors can share
    distinct = asked.select("dim", "vector", rep).distinct()
    # SAMPLE_ROWS vectors at most come to the driver
    sample = rows.select("vec_id", "vector", draw("pivot|", id_text("vec_id")).alias("h")).orderBy("h", "vec_id").limit(SAMPLE_ROWS)
    drawn: dict[int, list[np.ndarray]] = {}
    for batch in [sample.toArrow()] if rows.columns else []:
        for _, matrix in by_dimension(batch["vec_id"], batch["vector"]):
            drawn.setdefault(matrix.shape[1], []).append(quantise(matrix, scale))
    each = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}
    dims = sorted(each)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = {d: max(4, min(MAX_PIVOTS, -(-each[d] // QUERIES_PER_PIVOT))) for d in dims}
    pivots = {d: _pivots(np.concatenate(drawn[d]), count[d]) if d in drawn else np.zeros((1, d)) for d in dims}
    shared = spark.sparkContext.broadcast(pivots)

    # Summaries: the members nearest to each pivot, k + 1 a cell, one an id.
    near = rows.select("vec_id", "vector").mapInArrow(_members(shared, scale, keep), "dim int, cell int, vec_id long, vector binary, far double")
    near = near.groupBy("dim", "cell", "vec_id").agg(F.min(F.struct("far", "vector")).alias("first")).select("dim", "cell", "vec_id", "first.*")
    order = Window.partitionBy("dim", "cell").orderBy("far", "vec_id")
    marks = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).select("dim", "vector", "vec_id")
    landmarks = {d: {} for d in dims}
    for r in marks.collect():  # at most MAX_PIVOTS * (k + 1) vectors a length
        landmarks[r["dim"]].setdefault(r["vec_id"], np.frombuffer(r["vector"], np.float64))
    landmarks = spark.sparkContext.broadcast({d: np.stack(list(v.values())) if v else np.zeros((0, d)) for d, v in landmarks.items()})
    placed = materialize(distinct.mapInArrow(_place(shared, landmarks, keep), "dim int, cell int, rep string, vector binary, least double, radius double, reach array<double>"), "placed")
    pair_bounds = placed.select("dim", "cell", "least", "radius", F.posexplode("reach").alias("other", "most")).groupBy("dim", "cell", "other")
    bounds: dict[int, dict[int, list]] = {d: {} for d in dims}
    for r in pair_bounds.agg(F.min("least").alias("least"), F.max("radius").alias("radius"), F.max("most").alias("most")).collect():
        bounds[r["dim"]].setdefault(r["cell"], [r["least"], r["radius"], {}])[2][r["other"]] = r["most"]  # pivots squared at most
    limits = spark.sparkContext.broadcast({d: _limits(b, len(pivots[d])) for d, b in bounds.items()})

    copies = rows.select("vec_id", "vector").mapInArrow(_replicate(shared, limits, scale, k), "dim int, cell int, vec_id long, vector binary")
    copies = materialize(copies, "copies")
    # one row a group that many vectors are copied to
    large = copies.groupBy("dim", "cell").agg(F.ceil(F.count("*") / ROWS_PER_PART).cast("int").alias("parts")).where("parts > 1")
    large = F.broadcast(materialize(large, "parts"))
    parts = F.coalesce("parts", F.lit(1))
    copies = copies.join(large, ["dim", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).drop("parts")
    groups = placed.join(large, ["dim", "cell"], "left").select("dim", "cell", "rep", "vector", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

    key = ["dim", "cell", "part"]
    local = groups.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_solve(k), "rep string, vec_id long, score long")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    # All rows of an id are in one part, which has left k of them at most.
    merged = local.withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * k).drop("n")
    named = asked.select(F.col("vec_id").alias("query_id"), rep).distinct()
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        named.join(merged, "rep")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _encode(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in by_dimension(batch.column(0), batch.column(1)):
                dim = pa.array(np.full(len(ids), matrix.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids), dim, _bytes(quantise(matrix, scale))], ["vec_id", "dim", "vector"])

    return run


def _members(pivots, scale: int, keep: int):
    """The vectors nearest to each pivot in a batch, of different ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in by_dimension(batch.column(0), batch.column(1)):
                centres = pivots.value.get(matrix.shape[1])
                if centres is None:
                    continue
                matrix = quantise(matrix, scale)
                cell = _nearest(matrix, centres)
                far = np.sqrt(((matrix - centres[cell]) ** 2).sum(1))
                order = np.lexsort((far, ids, cell))
                order = order[places(cell[order], ids[order]) == 0]
                order = order[np.lexsort((ids[order], far[order], cell[order]))]
                at = order[places(cell[order]) < keep]
                dim = pa.array(np.full(len(at), matrix.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays(
                    [dim, pa.array(cell[at].astype(np.int32)), pa.array(ids[at]), _bytes(matrix[at]), pa.array(far[at])], ["dim", "cell", "vec_id", "vector", "far"]
                )

    return run


def _place(pivots, landmarks, keep: int):
    """Each distinct query's cell, the score its answers must reach, its distance from the pivot and its products with all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in np.unique(np.asarray(batch.column("dim"))).tolist():
                part = batch.filter(pa.compute.equal(batch.column("dim"), d))
                matrix, centres, marks = _matrix(part.column("vector")), pivots.value[d], landmarks.value[d]
                cell = _nearest(matrix, centres)
                radius = np.sqrt(((matrix - centres[cell]) ** 2).sum(1))
                if len(marks) >= keep:
                    least = np.sort(_products(matrix, marks), axis=1)[:, -keep].astype(np.float64)
                else:
                    least = np.full(len(matrix), -np.inf)
                reach = pa.array(list(matrix @ centres.T), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(cell.astype(np.int32)), part.column("rep"), part.column("vector"), pa.array(least), pa.array(radius), reach],
                    ["dim", "cell", "rep", "vector", "least", "radius", "reach"],
                )

    return run


def _limits(cells: dict[int, list], pivots: int):
    at = np.array(sorted(cells), np.int64)
    least = np.array([cells[i][0] for i in at])
    radius = np.array([cells[i][1] for i in at])
    reach = np.array([[cells[i][2][j] for j in range(pivots)] for i in at])
    return at, least, radius, reach


def _replicate(pivots, limits, scale: int, k: int):
    """A copy of each vector for every query group in which it can reach the least score.

    For a query q of a group with pivot p and radius R, and x = c + b in the cell
    of pivot c: q.x is at most p.x + R |x|, and at most max(q.c) + p.b + R |b|.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in by_dimension(batch.column(0), batch.column(1)):
                d = matrix.shape[1]
                if d not in limits.value or not len(limits.value[d][0]):
                    continue
                matrix = quantise(matrix, scale)
                at = fewest_of_equal(ids, matrix, k)
                ids, matrix = ids[at], matrix[at]
                centres, (cells, least, radius, reach) = pivots.value[d], limits.value[d]
                own = _nearest(matrix, centres)
                offset = matrix - centres[own]
                p = centres[cells]
                most = np.minimum(
                    matrix @ p.T + np.sqrt((matrix**2).sum(1))[:, None] * radius,
                    reach[:, own].T + offset @ p.T + np.sqrt((offset**2).sum(1))[:, None] * radius,
                )
                slack = 1e-9 * (1 + np.abs(most)) + 1e-6  # rounding of the bound
                row, group = np.nonzero(most + slack >= least)
                dim = pa.array(np.full(len(row), d, np.int32))
                encoded = _bytes(matrix).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([dim, pa.array(cells[group].astype(np.int32)), pa.array(ids[row]), encoded], ["dim", "cell", "vec_id", "vector"])

    return run


def _fewest_of_ids(ids: np.ndarray, k: int):
    """(a function of scores[query, row] to those of fewer columns, the ids of these): an id on more than k rows keeps its k best scores."""
    names, at, count = np.unique(ids, return_inverse=True, return_counts=True)
    light = np.flatnonzero(count[at] <= k)
    heavy = [np.flatnonzero(at == i) for i in np.flatnonzero(count > k)]

    def cut(scores: np.ndarray) -> np.ndarray:
        return np.concatenate([scores[:, light], *(np.partition(scores[:, c], len(c) - k, axis=1)[:, len(c) - k :] for c in heavy)], axis=1) if heavy else scores

    return cut, np.concatenate([ids[light], np.repeat(names[count > k], k)]) if heavy else ids


def _solve(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"rep": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        data, ids = _matrix(right.column("vector")), np.asarray(right.column("vec_id"))
        query, reps = _matrix(left.column("vector")), np.array(left.column("rep").to_pylist(), object)
        cut, ids = _fewest_of_ids(ids, k)
        out = []
        for i in range(0, len(query), 256):
            scores = cut(_products(query[i : i + 256], data))
            top = _best(scores, ids, 2 * k)
            out.append((np.repeat(reps[i : i + 256], top.shape[1]), ids[top].ravel(), np.take_along_axis(scores, top, 1).ravel()))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("rep", "vec_id", "score"), zip(*out))})

    return run


#: DuckDB SQL for the rows of ``topk_join`` over embeddings, queries being every 50th id.
TOPK_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
