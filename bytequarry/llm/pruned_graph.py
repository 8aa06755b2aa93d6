"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Rows are dealt to shards of a fixed size by a hash of their id. In each shard a
graph is grown in batches: a greedy search from the entry point proposes
neighbours for every new vector, relaxed distance pruning keeps a diverse few
(a candidate goes if a kept one is closer to it, by the factor ALPHA, than the
vector itself), and the reverse edges are pruned by the same rule. Queries walk
every shard's graph with a beam, and the shards' answers are merged. Every row is
indexed; equal vectors share a node that lists their ids.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.vectors import by_dimension
from bytequarry.session import materialize

K = 10
SHARD_ROWS = 4096
DEGREE = 28
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
#: Nodes that a beam expands at a time, and vectors that are searched side by side.
WIDTH = 4
BATCH = 256
#: Queries that meet a shard in one task.
QUERIES_PER_GROUP = 16_384


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] and b[i, j]."""
    diff = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", diff, diff)


def beam_search(points: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the beam's end for each query, nearest first; -1 and inf where it is not full."""
    n, size = len(queries), len(points)
    nodes = np.full((n, beam), -1, np.int32)
    far = np.full((n, beam), np.inf, points.dtype)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, size + 1), bool)  # the last column stands for "no node"
    seen[:, size] = True
    nodes[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    far[:, 0] = _squares(queries, np.broadcast_to(points[entry], (n, 1, points.shape[1])))[:, 0]
    live = np.arange(n)
    while len(live):
        rank = np.cumsum(open_[live], 1)
        pick = open_[live] & (rank <= WIDTH)
        open_[live] &= ~pick
        heads = np.where(pick, nodes[live], size)
        heads = np.sort(heads, 1)[:, :WIDTH]
        next_ = links[heads].reshape(len(live), -1)
        next_ = np.sort(np.where(next_ < 0, size, next_), 1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = size
        next_[seen[live[:, None], next_]] = size
        used = int((next_ < size).sum(1).max(initial=0))
        if used:
            next_ = np.sort(next_, 1)[:, :used]
            seen[live[:, None], next_] = True
            known = next_ < size
            fresh = np.full(next_.shape, np.inf, points.dtype)
            row, col = np.nonzero(known)
            diff = points[next_[row, col]] - queries[live[row]]
            fresh[row, col] = np.einsum("ij,ij->i", diff, diff)
            every = np.concatenate([far[live], fresh], 1)
            order = np.argsort(every, 1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(every, order, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(known, next_, -1)], 1), order, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], known], 1), order, 1)
        live = live[open_[live].any(1)]
    nodes[~np.isfinite(far)] = -1
    return nodes, far


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each owner up to ``degree`` of its candidates (-1: none), nearest first, diverse by the factor alpha."""
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == owners[:, None]] = -1
    gathered = points[candidates]
    far = _squares(points[owners], gathered)
    far[candidates < 0] = np.inf
    order = np.argsort(far, 1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    gathered = points[candidates]
    alive = np.isfinite(far)
    kept = np.full((len(owners), degree), -1, np.int32)
    rows = np.arange(len(owners))
    for slot in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        kept[some, slot] = candidates[rows, first][some]
        between = _squares(gathered[rows, first], gathered)
        alive &= ~(some[:, None] & (alpha * alpha * between <= far))
        alive[rows[some], first[some]] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(links[node, slot], entry point) of the graph over distinct points."""
    n = len(points)
    links = np.full((n + 1, degree), -1, np.int32)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)]).astype(np.int32)
    done = 1
    while done < n:
        new = order[done : done + min(done, BATCH)]
        found, _ = beam_search(points, links, entry, points[new], beam)
        links[new] = robust_prune(points, new, found, degree, alpha)
        source, target = np.repeat(new, degree), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        place = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
        for turn in range(int(place.max(initial=-1)) // degree + 1):  # so many new edges a node at a time
            now = place // degree == turn
            owners, at = np.unique(target[now], return_inverse=True)
            wide = np.full((len(owners), 2 * degree), -1, np.int32)
            wide[:, :degree] = links[owners]
            wide[at, degree + place[now] % degree] = source[now]
            links[owners] = robust_prune(points, owners.astype(np.int32), wide, degree, alpha)
        done += len(new)
    return _reachable(points, links, entry), entry


def _reachable(points: np.ndarray, links: np.ndarray, entry: int) -> np.ndarray:
    """The links, wider if need be, so that a walk from the entry can reach every node: one that can't be reached is linked from its nearest node that can."""
    n = len(points)
    while True:
        seen = np.zeros(n + 1, bool)
        seen[n] = True
        front = np.array([entry])
        while len(front):
            seen[front] = True
            front = np.unique(links[front])
            front = front[~seen[front]]  # -1 is the last one, which counts as seen
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return links
        node, known = lost[0], np.flatnonzero(seen[:n])
        near = known[((points[known] - points[node]) ** 2).sum(1).argmin()]
        free = np.flatnonzero(links[near] < 0)
        if not len(free):
            links = np.concatenate([links, np.full((n + 1, 1), -1, np.int32)], 1)
            free = [links.shape[1] - 1]
        links[near, free[0]] = node


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """dim, shard, rows, index: one graph a shard over all rows, written to the shared folder.

    Null ids, null, empty and all-zero vectors and those with null or non-finite
    components take no part. Repeated rows are all listed.
    """
    shards = max(1, -(-vectors.count() // shard_rows))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in by_dimension(batch.column(0), batch.column(1), zero=False):
                dim = pa.array(np.full(len(ids), matrix.shape[1], np.int32))
                data = pa.array([row.tobytes() for row in matrix], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), dim, data], ["vec_id", "dim", "vector"])

    def grow(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id"))
        matrix = np.stack([np.frombuffer(x, np.float64) for x in table.column("vector").to_pylist()])
        points, node = np.unique(matrix, axis=0, return_inverse=True)
        mixed = np.random.default_rng(7).permutation(len(points))  # unique() sorts; growth wants any other order
        points, back = points[mixed], np.argsort(mixed)
        node = back[node.ravel()]
        order = np.lexsort((ids, node))
        links, entry = build(points.astype(np.float32))
        packed = _pack(points=points, links=links, entry=np.array(entry), ids=ids[order], starts=np.searchsorted(node[order], np.arange(len(points) + 1)))
        return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "rows": pa.array([len(ids)], pa.int64()), "index": pa.array([packed], pa.binary())})

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).mapInArrow(encode, "vec_id long, dim int, vector binary")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    rows = rows.repartition(shards, "dim", "shard")  # a shard is much work but few bytes, by which Spark would put several in one task
    index = rows.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard int, rows long, index binary")
    return materialize(index, "graph-index")


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, nearest first.

    ``score`` is the Euclidean distance in double precision on the original
    vectors. A query's own id is no answer; ties go to the smaller id; all rows
    of its length are returned if there are fewer than k, as the beam is wider
    than k and every node of a graph can be reached. Queries without a proper vector have no rows; a repeated query id is
    answered once.
    """
    groups = max(1, -(-queries.count() // QUERIES_PER_GROUP))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, matrix in by_dimension(batch.column(0), batch.column(1), zero=False):
                dim = pa.array(np.full(len(ids), matrix.shape[1], np.int32))
                data = pa.array([row.tobytes() for row in matrix], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), dim, data], ["query_id", "dim", "vector"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            names = np.asarray(right.column("query_id"))
            asked = np.stack([np.frombuffer(x, np.float64) for x in right.column("vector").to_pylist()])
            for packed in left.column("index").to_pylist():
                part = np.load(io.BytesIO(packed))
                points, ids, starts = part["points"], part["ids"], part["starts"]
                links, entry, rough = part["links"], int(part["entry"]), part["points"].astype(np.float32)
                # Nodes that list a query's own id may hold no answer, so a beam has room for k besides them.
                listed = np.unique(np.stack([ids, np.repeat(np.arange(len(points)), np.diff(starts))]), axis=1)[0]
                own_nodes = np.searchsorted(listed, names, "right") - np.searchsorted(listed, names)
                for i in range(0, len(asked), BATCH):
                    block = asked[i : i + BATCH]
                    nodes, _ = beam_search(rough, links, entry, block.astype(np.float32), max(beam, k + int(own_nodes[i : i + BATCH].max())))
                    exact = np.sqrt(_squares(block, points[nodes]))
                    exact[nodes < 0] = np.inf
                    order = np.argsort(exact, 1, kind="stable")
                    for row, name in enumerate(names[i : i + BATCH].tolist()):
                        left_over, last = k, np.inf
                        for c in order[row].tolist():
                            node, distance = nodes[row, c], exact[row, c]
                            if node < 0 or left_over <= 0 and distance > last:  # equal distances are left to the ids
                                break
                            there = ids[starts[node] : starts[node + 1]]
                            a, b = np.searchsorted(there, name), np.searchsorted(there, name, "right")
                            others = np.concatenate([there[:a][:k], there[b:][:k]])[:k].tolist()
                            out["query_id"] += [name] * len(others)
                            out["vec_id"] += others
                            out["score"] += [distance] * len(others)
                            left_over, last = left_over - len(others), distance
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector")).mapInArrow(encode, "query_id long, dim int, vector binary")
    asked = asked.dropDuplicates(["query_id"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    # Every query meets every shard, in blocks of QUERIES_PER_GROUP.
    shards = index.groupBy("dim").agg(F.max("shard").alias("__last"))
    asked = asked.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("__last")))).drop("__last")
    graphs = index.select("dim", "shard", "index", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    key = ["dim", "shard", "part"]
    found = graphs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """Indexes all of ``vectors`` and searches it for those that ``is_query`` marks."""
    return search(build_index(vectors), vectors.where(is_query), k)
