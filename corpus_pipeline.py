"""The corpus pipeline: raw documents to encoded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and reread as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import minhash_bbit, mixing, nbest_pieces, pii_crf, ppm_langid
from bytequarry.session import drop_scratch, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; if no label is there to learn from, those with a letter stay."""
    model = ppm_langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = ppm_langid.predict(docs, model)
    return found.where(F.col("lang_pred") != ppm_langid.UNDETERMINED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return minhash_bbit.without_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    clean = pii_crf.redact(docs, pii_crf.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of the best segmentation, and the scores of the N best."""
    found = nbest_pieces.encode_nbest(docs)
    ids = F.get("segmentations", F.lit(0))["ids"]
    return found.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), F.transform("segmentations", lambda s: s["score"]).alias("scores"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Trained models and piece lattices are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_scratch(before)  # nothing reads the stage before the last any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
