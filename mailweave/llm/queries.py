"""The registered queries: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.sources.tables import table

from . import alignment, decontaminate, fingerprints, graphs, hosts, langid, licenses, mixing, parity, pii, resample, spans, warc


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat a span of an earlier place."""
    return spans.deduplicated(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the likeness to it and to the next document."""
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learned from the documents that are not held out."""
    return langid.report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item's best aligned window."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 3-word shingles and component under links of Jaccard 0.9 or more."""
    rows, _ = parity.joined(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence family and passages, by a classifier trained on the spot."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scanned(docs, licenses.train(docs))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to 150 % of all words, weights 3, 1, 2, at most two epochs."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return pii.replaced(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, fitting rule and verdict."""
    out = hosts.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed WARC archives and read back."""
    rows, _ = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark's texts, and the tenth drawn by it."""
    return resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, aligned, and how often its links occur in all documents."""
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every vector whose id is divisible by 20."""
    return graphs.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_fingerprints, op3_language_id, op4_decontaminate, op5_jaccard_join, op6_licenses,
                                   op7_mix_sources, op8_pii, op9_url_filters, op10_warc, op11_importance_resampling, op12_token_alignment,
                                   op13_nearest_neighbours)}
ORACLES = {"op7_mix_sources": mixing.SQL, "op9_url_filters": hosts.SQL,
           "op10_warc": warc.SQL, "op11_importance_resampling": resample.SQL}
