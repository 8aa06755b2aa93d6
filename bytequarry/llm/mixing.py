"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in hash order. A copy of a document
finishes at the virtual time ``tokens of its source up to and with it / target
of its source``; second copies queue behind all first ones. The mix is the
global order of finish times, cut where the total budget is spent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.common import DRAW_RANGE, WORD, draw, id_text
from bytequarry.session import materialize

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The budget as a share of all tokens.
SHARE = 1.5
#: No document is taken more often than this.
REPEATS = 2
SEED = "mix-1"
#: Verdicts on up to this many rows (some 40 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _source_key(source: str) -> Column:
    """Never null, and ordered by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """source_key, source_size -> + rank, weight, target.

    A target is the source's part of the budget by weight, but ``repeats`` times
    its size at most; what is above goes to the others by weight, again until
    none is above. Sorted by size over weight, the sources at their limit come
    first, so prefix sums give the level in one pass: levels fall from the first
    source below its limit on, so it is the largest that lies below one. There is one row a source;
    the windows below hold the table of sources, never documents.
    """
    rank = Window.orderBy("source_key")
    cycle = F.array(*map(F.lit, weights))
    limit = F.col("source_size") * float(repeats)
    ranked = sizes.withColumn("rank", F.row_number().over(rank)).withColumn(
        "weight", F.get(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))))
    )
    ranked = ranked.withColumn("__limit", limit).withColumn("__ratio", F.col("__limit") / F.col("weight"))
    order = Window.orderBy("__ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("__ratio"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)  # a growing frame: Spark sums one that shrinks anew for each row
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(Window.partitionBy()) * float(share)
        - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    ranked = ranked.withColumn("__level", level)
    ranked = ranked.withColumn(
        "__level", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(everything)
    )
    target = F.least(F.col("__limit"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__limit")))
    return ranked.select("source_key", "source_size", "rank", "weight", target.alias("target"))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_task: int = 50_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row.

    ``size`` is the number of words (null text: 0). ``copies`` says how often the
    mix takes the document and ``taken`` is ``copies * size``. Whole documents
    are taken, in the order of finish times, while their running total stays
    within the budget; ties go by source, hash and id, so reruns agree. Rows
    without words are never taken. A null source is a source of its own, last in
    order; a null id is an id like another. Repeated rows queue one by one. An
    empty table gives no rows. Other columns of the input are ignored.

    No task holds a whole source: running sums are made in two levels, over
    hash buckets of about ``rows_per_task`` rows and then within a bucket, and
    only one slice of finish times, cut until it is small, is sorted row by row.
    """
    sized = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    sized = sized.withColumn("source_key", _source_key("source")).withColumn(
        "h", draw(seed, "|", id_text("doc_id"))
    )
    sized = materialize(sized, "mix-sizes")
    slices = max(1, -(-sized.count() // rows_per_task))
    sized = sized.withColumn("slice", F.floor(F.col("h") * slices / DRAW_RANGE).cast("int"))

    sums = sized.groupBy("source_key", "slice").agg(F.sum("size").alias("n"))
    targets = source_targets(sums.groupBy("source_key").agg(F.sum("n").alias("source_size")), weights, share, repeats)
    along = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key", "slice", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    starts = starts.join(targets, "source_key")
    within = (
        Window.partitionBy("source_key", "slice")
        .orderBy("h", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    queued = sized.join(starts, ["source_key", "slice"]).withColumn("upto", F.col("start") + F.sum("size").over(within))
    queued = materialize(queued.drop("slice", "start", "source_key"), "mix-queue")

    budget_row = queued.agg(F.sum("size").alias("n")).first()
    budget = float(share) * float(budget_row["n"] or 0)
    cut = _cut(_copies(queued, repeats), budget, max(4096, slices), rows_per_task)
    if cut is None:
        copies = F.lit(0)
    else:
        copies = sum(
            (F.when(F.struct(_finish(c), F.col("rank"), F.col("h"), F.col("__id"), F.col("size"), F.lit(c)) <= cut, 1).otherwise(0))
            for c in range(repeats)
        )
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)
    return queued.withColumn("__id", id_text("doc_id")).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it, with the same columns.

    Rows are told apart by id and text; equal rows stand for one another, and
    together come as often as the mix takes them.
    """
    row = F.concat(id_text(id_col), F.lit("|"), F.xxhash64(F.col(text_col).cast("string")).cast("string"))
    tagged = documents.withColumn("__row", row)
    taken = mix(tagged, id_col="__row", text_col=text_col, source_col=source_col, **options)
    taken = taken.groupBy(F.col("doc_id").alias("__row")).agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows"))
    taken = materialize(taken.where("__copies > 0"), "mix-copies")
    again = taken.where("__rows > 1").select("__row")
    if again.limit(1).count():
        once = tagged.join(again, "__row", "left_semi").dropDuplicates(["__row"])
        tagged = tagged.join(again, "__row", "left_anti").unionByName(once)
    taken = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    copies = tagged.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return copies.select(*documents.columns)


def _finish(copy: int) -> Column:
    return (F.col("source_size") * copy + F.col("upto")) / F.col("target")


def _copies(queued: DataFrame, repeats: int) -> DataFrame:
    live = queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("__id", id_text("doc_id"))
    copies = F.explode(F.array(*[F.struct(_finish(c).alias("vft"), F.lit(c).alias("copy")) for c in range(repeats)]))
    return live.select("rank", "h", "__id", "size", copies.alias("c")).select(
        F.col("c.vft").alias("vft"), "rank", "h", "__id", "size", F.col("c.copy").alias("copy")
    )


def _cut(copies: DataFrame, budget: float, slices: int, rows_per_task: int) -> Column | None:
    """The last copy within the budget as a struct literal, or None if there is none.

    The copies are cut into slices of finish time, whose sums come to the driver:
    at most ``slices`` + 1 rows. The slice in which the budget ends is cut again,
    by finish time or, where many copies finish at once, by rank, until it is
    small enough for one task to sort. Copies of one time and rank are copies of
    a few documents, since within a source every word moves the time.
    """
    order = ["vft", "rank", "h", "__id", "size", "copy"]
    spent, last, part = 0, None, copies
    cell = F.least(F.floor(F.col("vft") * slices / 2), F.lit(slices)).cast("long")
    while True:
        sums = part.groupBy(cell.alias("cell")).agg(
            F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("vft").alias("a"), F.max("vft").alias("b"), F.min("rank").alias("x"), F.max("rank").alias("y")
        )
        at = None
        for row in sorted(sums.collect()):
            if spent + row["n"] > budget:
                at = row
                break
            spent, last = spent + row["n"], part.where(cell == row["cell"])
        if at is None:
            break
        part = part.where(cell == at["cell"])
        if at["rows"] <= rows_per_task or (at["a"], at["x"]) == (at["b"], at["y"]):
            break
        key, low, high = ("vft", at["a"], at["b"]) if at["a"] < at["b"] else ("rank", at["x"], at["y"])
        cell = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(float(high - low)) * slices), F.lit(slices - 1)).cast("long")
    best = None
    if at is not None:
        run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inside = part.withColumn("__run", F.sum("size").over(run))
        best = inside.where(F.col("__run") + spent <= budget).agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    if best is None and last is not None:
        best = last.agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    if best is None:
        return None
    return F.struct(
        F.lit(best["vft"]), F.lit(best["rank"]), F.lit(best["h"]), F.lit(best["__id"]), F.lit(best["size"]).cast("long"), F.lit(best["copy"])
    )


#: DuckDB SQL for the rows of ``mix`` over documents, without ``copies``.
MIX_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce('0' || source, '1') AS k,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 13)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
r AS (SELECT *, row_number() OVER (ORDER BY k) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
      source_size * 2.0::DOUBLE AS lim FROM r),
l AS (SELECT *, lim / weight AS ratio,
      (sum(source_size) OVER () * 1.5::DOUBLE
       - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT *, least(lim, coalesce(max(CASE WHEN lv <= ratio THEN lv END) OVER () * weight, lim)) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, t.rank,
      sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.k = t.k),
c AS (SELECT *, (source_size * copy + upto) / target AS vft FROM q, (VALUES (0), (1)) AS x(copy) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY vft, rank, h, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS total FROM c),
n AS (SELECT rn, CAST(sum(size) AS BIGINT) AS taken FROM g
      WHERE total <= 1.5::DOUBLE * (SELECT sum(size) FROM d) GROUP BY rn)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, coalesce(n.taken, 0) AS taken
FROM q LEFT JOIN n USING (rn)
"""
