"""Queries of codecs, checksums, trials and archives over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import codecs
from bytequarry.operators import trial
from bytequarry.plans.catalogue import register
from bytequarry.plans.stat_queries import blobs
from bytequarry.session import table
from bytequarry.sources import archives


@register("codec_round_trip", "SELECT doc_id AS blob_id, c AS codec, TRUE AS same FROM documents, (VALUES ('Deflate'), ('Gzip'), ('Bzip2'), ('Xz'), ('Zstd'), ('Lz4'), ('Snappy'), ('Brotli'), ('RLE'), ('Delta'), ('Huffman'), ('rANS'), ('LZ77'), ('LZSS'), ('BWT')) AS v(c)")
def codec_round_trip(spark, sf_dir):
    names = ("Deflate", "Gzip", "Bzip2", "Xz", "Zstd", "Lz4", "Snappy", "Brotli", "RLE", "Delta", "Huffman", "rANS", "LZ77", "LZSS", "BWT")
    return blobs(spark, sf_dir).select("blob_id", F.explode(codecs.round_trips(names)("data")).alias("c")).select("blob_id", "c.codec", "c.same")


@register("checksums")
def checksums(spark, sf_dir):
    return blobs(spark, sf_dir).select("blob_id", *[codecs.checksum(n)("data").alias(n) for n in ("crc16", "crc16_ccitt", "crc32", "crc32c", "crc64", "adler32", "xxh32", "xxh64")], codecs.blake2b(32)("data").alias("blake2b"))


@register("trial_decode")
def trial_decode(spark, sf_dir):
    """Documents packed with one of four codecs, by number."""
    return trial.trial_decode(_packed(spark, sf_dir))


@register("chain_layers")
def chain_layers(spark, sf_dir):
    return trial.chain_layers(_packed(spark, sf_dir))


def _packed(spark, sf_dir):
    rows = blobs(spark, sf_dir)
    which = F.pmod("blob_id", F.lit(4))
    data = F.when(which == 0, codecs.encode("Gzip")("data")).when(which == 1, codecs.encode("Bzip2")(codecs.encode("Zlib")("data"))).when(which == 2, codecs.encode("Xz")("data")).otherwise(F.col("data"))
    return rows.select("blob_id", data.alias("data"))


@register("bench_matrix")
def bench_matrix(spark, sf_dir):
    return trial.bench_matrix(spark)


@register("bench_summary")
def bench_summary(spark, sf_dir):
    return trial.bench_summary(trial.bench_matrix(spark))


@register("archive_round_trip", "SELECT source, CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, 'Deflate' AS method FROM documents")
def archive_round_trip(spark, sf_dir):
    """One zip a source is written, and its entries are read back."""
    rows = table(spark, sf_dir, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("data"))
    found = archives.archive_entries(archives.create_archives(rows, "source"), "source", "archive")
    return found.select("source", "name", "size", F.sha2("content", 256).alias("sha256"), "method")


@register("recursive_extract", "SELECT source AS blob_id, 2 AS depth, CAST(doc_id AS VARCHAR) || '.gz/data' AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents")
def recursive_extract(spark, sf_dir):
    """Zips of compressed documents; the innermost level is returned."""
    rows = blobs(spark, sf_dir).select("blob_id", codecs.encode("Gzip")("data").alias("data"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("blob_id"), "source")
    rows = rows.join(sources, "blob_id").select("source", F.concat(F.col("blob_id").cast("string"), F.lit(".gz")).alias("name"), "data")
    packed = archives.create_archives(rows, "source").select(F.col("source").alias("blob_id"), F.col("archive").alias("data"))
    return archives.recursive_extract(packed).where("depth = 2")


@register("integrity_test", "SELECT doc_id AS blob_id, doc_id % 3 <> 0 AS intact FROM documents")
def integrity_test(spark, sf_dir):
    """Every third document's gzip stream is cut by its last twelve bytes."""
    rows = blobs(spark, sf_dir).select("blob_id", codecs.encode("Gzip")("data").alias("z"))
    z = F.when(F.col("blob_id") % 3 == 0, F.expr("substring(z, 1, octet_length(z) - 12)")).otherwise(F.col("z"))
    return rows.select("blob_id", codecs.decode("Gzip", 1 << 30)(z).isNotNull().alias("intact"))
