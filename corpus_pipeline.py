"""A corpus pipeline: each stage is one operator of classgauge.llm over all that its predecessor kept.

Documents that fail the quality rules go, later copies of repeated line runs are cut out, one
document of each group of near copies stays, documents that leak benchmark items go, and
what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classgauge.llm.bpe import bpe_encode
from classgauge.llm.jaccard import shingle_components
from classgauge.llm.linedup import dedup_lines
from classgauge.llm.perplexity import quality_verdicts
from classgauge.llm.sizing import fresh
from classgauge.llm.templates import without_leaks
from classgauge.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose verdict is to keep, joined by id, language and text: rows equal in these have one verdict.

    A null or empty text has no words and goes. Null ids and languages are values like others. No column is
    changed or lost, whatever its name.
    """
    name = fresh("key_", docs.columns)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("lang"), F.col("text"))
    keyed = docs.withColumn(name, key)
    bad = quality_verdicts(keyed, keep=(name,)).where("NOT kept").select("doc_id", F.col(f"kept_{name}").alias(name)).distinct()
    kept = keyed.join(bad, [keyed["doc_id"].eqNullSafe(bad["doc_id"]), keyed[name] == bad[name]], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs leave the texts; ``n_chars`` follows. A text left without a word goes.

    The first copy by id (null first) and text stays; rows equal in both are cut alike. A null text stays as it is.
    """
    cut = dedup_lines(docs)
    n = F.col(cut.columns[-1])
    left = cut.where((n == 0) | ~F.col("text").rlike("^[\\x20\\x09-\\x0D]*$"))
    chars = F.when(n > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one whose id names the group, the smallest.

    Rows without an id stay, and so do texts without words; rows that repeat an id share its fate.
    """
    gone = shingle_components(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of ``benchmark`` go, all rows of their id with them. Null texts and null ids leak nothing."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, exact), one for each document: its text as ids, and whether they decode to it again.

    A null or empty text has no ids, and that is exact.
    """
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe_encode(docs, vocabulary, keep=(F.sha2("text", 256).alias("sha256"),), decode=True)
    exact = F.coalesce(F.sha2("decoded", 256) == F.col("sha256"), F.col("decoded") == "")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminated),
    ("bpe_coding", encoded),
]

ORACLE_SQL = None  # perplexity and the merges can't be put in SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
