"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import hash_tree, minhash_bbit, mixing, nbest_pieces, pii_crf, ppm_langid, pruned_graph, token_hist, voronoi_topk, warc
from bytequarry.session import materialize, table

#: 4 regions of 2 racks of 5 shards.
TOPOLOGY = hash_tree.Topology.uniform(4, 2, 5)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_captures(table(spark, sf_dir, "pages"))
    records = materialize(warc.read_records(spark, folder), "warc-records")
    return warc.assemble(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_hist.encoded_lengths(table(spark, sf_dir, "documents"))
    return token_hist.context_totals(token_hist.length_histogram(lengths))


def op4_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk.topk_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_bbit.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = pii_crf.detect(documents, pii_crf.fit(documents))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = hash_tree.assign_shards(table(spark, sf_dir, "documents"), TOPOLOGY)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = ppm_langid.predict(documents.select("doc_id", "text"), ppm_langid.fit(documents))
    return found.select("doc_id", ppm_langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_pieces.segmentation_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_token_histogram": op3_token_histogram,
    "op4_voronoi_topk": op4_voronoi_topk,
    "op5_minhash_bbit": op5_minhash_bbit,
    "op6_pii_crf": op6_pii_crf,
    "op7_hash_tree": op7_hash_tree,
    "op8_ppm_language": op8_ppm_language,
    "op9_pruned_graph": op9_pruned_graph,
    "op10_nbest_pieces": op10_nbest_pieces,
}

ORACLES = {"op1_mixing": mixing.MIX_SQL, "op2_warc_transactions": warc.ROUND_TRIP_SQL, "op4_voronoi_topk": voronoi_topk.TOPK_SQL, "op5_minhash_bbit": minhash_bbit.NEAR_SQL, "op7_hash_tree": hash_tree.shards_sql(TOPOLOGY)}
