"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards. A row descends it one level
at a time: every child of the node reached draws ``ln(u) / weight``, u hashed
from the row's id and the child's path, and the largest draw wins. A child's
weight is the number of shards below it, so shards get equal shares, and a
change of weights moves rows only between the subtrees whose weights changed.
Growth by one shard hangs a new region (one rack, one shard) from the root: the
draws of all others stay as they were, so a row either stays or goes into the
new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.common import DRAW_RANGE, draw, id_text
from bytequarry.session import materialize


@dataclass(frozen=True)
class Topology:
    """``regions[i][j]`` is the number of shards in rack j of region i."""

    regions: tuple[tuple[int, ...], ...]

    @classmethod
    def uniform(cls, regions: int, racks: int, shards: int) -> Topology:
        return cls(((shards,) * racks,) * regions)

    @property
    def shards(self) -> int:
        return sum(map(sum, self.regions))

    def grow(self) -> Topology:
        return Topology((*self.regions, (1,)))

    def first_shards(self) -> list[list[int]]:
        """The number of the first shard of each rack; shards count on in tree order."""
        at, out = 0, []
        for racks in self.regions:
            out.append([])
            for n in racks:
                out[-1].append(at)
                at += n
        return out


def _literal(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*map(F.lit, row)) for row in rows])


def _choose(key: Column, path: Column, weights: list[Column]) -> Column:
    """Index of the child with the largest weighted draw; ties go to the first."""
    draws = []
    for i, weight in enumerate(weights):
        u = (draw(key, "|", path, F.lit(f"/{i}")) + 0.5) / DRAW_RANGE
        draws.append(F.when(weight.isNotNull(), F.struct((F.log(u) / weight).alias("score"), F.lit(-i).alias("child"))))
    return -F.greatest(*draws)["child"]


def _descend(df: DataFrame, key: str, topology: Topology, region: str, rack: str, shard: str) -> DataFrame:
    """Adds the columns ``region``, ``rack`` and ``shard``; absent children weigh null."""
    width = max(len(r) for r in topology.regions)
    depth = max(max(r) for r in topology.regions)
    racks = _literal([[float(n) for n in r] + [None] * (width - len(r)) for r in topology.regions])
    first = _literal([r + [None] * (width - len(r)) for r in topology.first_shards()])
    k = F.col(key)
    df = df.withColumn(region, _choose(k, F.lit("t"), [F.lit(float(sum(r))) for r in topology.regions]))
    at = F.get(racks, F.col(region))
    path = F.concat(F.lit("t/"), F.col(region).cast("string"))
    df = df.withColumn(rack, _choose(k, path, [F.get(at, F.lit(j)) for j in range(width)]))
    path = F.concat(path, F.lit("/"), F.col(rack).cast("string"))
    size = F.get(F.get(racks, F.col(region)), F.col(rack))
    leaf = _choose(k, path, [F.when(size > s, F.lit(1.0)) for s in range(depth)])
    return df.withColumn(shard, (F.get(F.get(first, F.col(region)), F.col(rack)) + leaf).cast("int"))


def assign_shards(
    documents: DataFrame,
    topology: Topology,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_task: int = 50_000,
) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard of every row.

    Law ``key``: only the id and the topology decide. ``slot`` counts from 0
    without gaps within a shard, in the order of hash bucket, then id, then size
    and checksum. Slots come from a two-level prefix sum: rows of a shard are
    dealt into buckets of about ``rows_per_task``, bucket counts are summed along
    the shard, and rows are numbered within their bucket, so no task holds a
    whole shard.

    A null id counts as one id of its own; a null text has no bytes (size 16,
    checksum 0). Repeated rows are kept, each in a slot of its own. An empty
    table gives no rows. Other columns of the input are ignored, whatever their
    names.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    buckets = max(1, -(-documents.count() // (rows_per_task * topology.shards)))
    data = F.coalesce(F.col("__text"), F.lit("")).cast("binary")
    rows = rows.select(
        "doc_id",
        id_text("doc_id").alias("__key"),
        (F.octet_length(data).cast("long") + 16).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    rows = _descend(rows, "__key", topology, "region", "rack", "shard")
    rows = _descend(rows, "__key", topology.grow(), "__region", "__rack", "grown_shard")
    rows = rows.drop("__region", "__rack").withColumn("__bucket", F.floor(draw("slot|", F.col("__key")) * buckets / DRAW_RANGE).cast("int"))
    rows = materialize(rows.drop("__key"), "shards")  # the rows are read twice, the texts once
    along = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "__bucket")
        .agg(F.count("*").alias("__n"))
        .select("shard", "__bucket", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "size", "text_crc32")
    return rows.join(starts, ["shard", "__bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "region",
        "rack",
        "shard",
        (F.col("__start") + F.row_number().over(within) - 1).alias("slot"),
        "grown_shard",
    )


def _draw_sql(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)"


def _choice_sql(path: str, children: int, weight: str) -> str:
    """The child with the largest ln(u) / weight; ``weight`` is SQL over the child's number i."""
    draws = ", ".join(
        f"{{'s': CASE WHEN {weight.format(i=i)} > 0 THEN ln(({_draw_sql(f"k || '|' || {path} || '/{i}'")} + 0.5::DOUBLE) / {DRAW_RANGE:.0f}::DOUBLE) / {weight.format(i=i)} ELSE -1e300 END, 'c': {-i}}}"
        for i in range(children)
    )
    return f"-list_max([{draws}]).c"


def shards_sql(topology: Topology, rows_per_task: int = 50_000) -> str:
    """DuckDB SQL for the rows of ``assign_shards`` over documents with a uniform topology."""
    regions, racks, shards = len(topology.regions), len(topology.regions[0]), topology.regions[0][0]
    table = "[" + ", ".join(
        "list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, %d::BIGINT)" % i for i in range(256)
    ) + "]"
    weight = f"{float(racks * shards)}::DOUBLE"
    return f"""
WITH lut AS MATERIALIZED (SELECT {table} AS t),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '\\N') AS k, encode(coalesce(text, '')) AS data FROM documents),
b AS (SELECT doc_id, k, octet_length(data) + 16 AS size,
      xor(list_reduce([('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(data), '..')],
                  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, lut),
r AS (SELECT *, {_choice_sql("'t'", regions, weight)} AS region, {_choice_sql("'t'", regions + 1, f"(CASE WHEN {{i}} < {regions} THEN {weight} ELSE 1.0::DOUBLE END)")} AS grown FROM b),
a AS (SELECT *, {_choice_sql("'t/' || region", racks, f"{float(shards)}::DOUBLE")} AS rack FROM r),
s AS (SELECT *, {racks * shards} * region + {shards} * rack + {_choice_sql("'t/' || region || '/' || rack", shards, "1.0::DOUBLE")} AS shard,
      floor({_draw_sql("'slot|' || k")}::DOUBLE * (SELECT greatest(1, ceil(count(*) / {float(rows_per_task * topology.shards)})) FROM d) / {DRAW_RANGE:.0f}::DOUBLE) AS bucket FROM a)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot,
       CAST(CASE WHEN grown = {regions} THEN {topology.shards} ELSE shard END AS INT) AS grown_shard FROM s
"""
