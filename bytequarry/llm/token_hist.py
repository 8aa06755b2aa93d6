"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; everything asked later (totals,
quantiles, totals truncated at a context limit) is a suffix or prefix sum over
that histogram, which has one row for each distinct length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.common import slices, texts_of
from bytequarry.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters that \s stands for in that pattern (Unicode's White_Space).
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are cut here; the tokenizer's matcher holds a state a character of such a run and breaks off at a million.
LONG_RUN = 10_000
_RUN = re.compile(f"[{_BLANKS}]{{{LONG_RUN},}}")
#: Lengths of one block of the two-level sums.
BLOCK = 1024


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoder, text: str, long_run: re.Pattern = _RUN) -> int:
    """The number of ids of a whole text.

    The pattern takes a run of white space as one part, up to its last character
    if another kind follows. Long runs are given to the merges as that part.
    """
    total, at = 0, 0
    for run in long_run.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:] if at else text))


def encoded_lengths(documents: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """tokens: the encoded length of each whole text, in no order; null and empty texts have 0.

    Any ``pattern`` must end as PATTERN does for texts with runs of LONG_RUN blanks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, pattern)
        for batch in slices(batches):
            lengths = [count_tokens(encoder, t) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["tokens"])

    return texts_of(documents.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(count, "tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """tokens, n_docs: the exact histogram, written once so that no answer encodes again."""
    return materialize(lengths.groupBy("tokens").agg(F.count("*").alias("n_docs")), "token-histogram")


def context_totals(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct encoded length, taken as a context limit.

    context_limit, n_docs (of just that length), docs_fitting, docs_cut (longer),
    total_docs, total_tokens, kept_whole_tokens (in documents that fit),
    truncated_tokens (all texts cut at the limit), quantile (share of documents
    that fit). An empty table gives no rows.

    Sums run along blocks of ``block`` lengths and then within a block, so no
    task needs the whole histogram; the block table is the longest length over
    ``block``.
    """
    rows = histogram.withColumn("__block", F.floor(F.col("tokens") / block).cast("long")).withColumn(
        "__t", F.col("tokens") * F.col("n_docs")
    )
    along = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = (
        rows.groupBy("__block")
        .agg(F.sum("n_docs").alias("d"), F.sum("__t").alias("t"))
        .select(
            "__block",
            F.coalesce(F.sum("d").over(along), F.lit(0)).alias("__d0"),
            F.coalesce(F.sum("t").over(along), F.lit(0)).alias("__t0"),
            F.sum("d").over(whole).alias("total_docs"),
            F.sum("t").over(whole).alias("total_tokens"),
        )
    )
    within = Window.partitionBy("__block").orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    fitting = F.col("__d0") + F.sum("n_docs").over(within)
    kept = F.col("__t0") + F.sum("__t").over(within)
    out = rows.join(blocks, "__block").withColumn("docs_fitting", fitting).withColumn("kept_whole_tokens", kept)
    cut = F.col("total_docs") - F.col("docs_fitting")
    return out.select(
        F.col("tokens").alias("context_limit"),
        "n_docs",
        "docs_fitting",
        cut.alias("docs_cut"),
        "total_docs",
        "total_tokens",
        "kept_whole_tokens",
        (F.col("kept_whole_tokens") + F.col("tokens") * cut).alias("truncated_tokens"),
        (F.col("docs_fitting") / F.col("total_docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, docs_fitting, docs_cut, truncated_tokens for stated limits, from the histogram alone."""
    limit = F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("context_limit")
    fits = F.col("tokens") <= F.col("context_limit")
    return (
        histogram.select("tokens", "n_docs", limit)
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(fits, F.col("n_docs")).otherwise(0)).alias("docs_fitting"),
            F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("docs_cut"),
            F.sum(F.least("tokens", "context_limit") * F.col("n_docs")).alias("truncated_tokens"),
        )
    )


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, tokens: the smallest length with at least that share of all documents at or below it."""
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    totals = context_totals(histogram).select("context_limit", "quantile", share)
    return totals.where(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("tokens"))
