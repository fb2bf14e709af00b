"""Linear text classifiers kept as tables, and scoring with them.

A model is a table (term_idx, term, df, idf, w) with one weight per class in
``w``, plus one intercept per class. Logistic regression, naive Bayes and the
centroid classifier all come out in this form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classgauge.functions.text import terms
from classgauge.functions.vectors import argmax, softmax
from classgauge.operators.features import (
    DRIVER_BYTES,
    Vocabulary,
    explode_terms,
    fits_broadcast,
    join_terms,
    portions,
    sublinear_tf,
    term_counts,
    tfidf_long,
    with_count_arrays,
)
from classgauge.operators.termblocks import joined_blocks, joined_rows, unit_weights
from classgauge.session import work_path
from classgauge.sources.tables import LABEL_IDS, label_name


BLOCK_ROWS = 512


@dataclass(frozen=True)
class TextModel:
    path: str
    profile: str
    weighting: str  # "tfidf" or "counts"
    intercepts: tuple[float, ...]
    n_docs: int
    n_terms: int
    n_bytes: int

    @property
    def n_classes(self) -> int:
        return len(self.intercepts)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/terms")


def save_model(
    terms: DataFrame, intercepts: list[float], profile: str, weighting: str, vocabulary: Vocabulary, path: str | None = None
) -> TextModel:
    """Write a model's term table and facts, and return it."""
    spark = terms.sparkSession
    path = path or work_path(spark, "model")
    terms.select("term_idx", "term", "df", "idf", "w").write.mode("overwrite").parquet(f"{path}/terms")
    n_bytes = vocabulary.n_bytes + vocabulary.n_terms * 8 * (len(intercepts) + 3)
    facts = (profile, weighting, [float(b) for b in intercepts], vocabulary.n_docs, vocabulary.n_terms, n_bytes)
    schema = "profile string, weighting string, intercepts array<double>, n_docs long, n_terms long, n_bytes long"
    spark.createDataFrame([facts], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return load_model(spark, path)


def load_model(spark: SparkSession, path: str) -> TextModel:
    facts = spark.read.parquet(f"{path}/facts").first().asDict()
    facts["intercepts"] = tuple(facts["intercepts"])
    return TextModel(path=path, **facts)


def class_sizes(df: DataFrame, label: str) -> list[int]:
    """Rows per class 0..C-1; C numbers."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    return [sizes.get(c, 0) for c in range(max(max(sizes) + 1, 2))]


def _by_class(value, label: str, n_classes: int) -> list:
    return [F.sum(F.when(F.col(label) == c, value).otherwise(0.0)).alias(f"s{c}") for c in range(n_classes)]


def _term_sums(rows: DataFrame, value, label: str, n_classes: int) -> DataFrame:
    facts = [F.max(c).alias(c) for c in ("term_idx", "df", "idf")]
    return rows.groupBy("term").agg(*facts, *_by_class(value, label, n_classes))


def _block_sums(counts: DataFrame, key: str, label: str, vocabulary: Vocabulary, n_classes: int) -> DataFrame:
    """``_term_sums`` of the TF-IDF weights under a vocabulary past the broadcast bound: added up in each block of texts, then by term."""

    def rows_of(keys: pa.Table, text: np.ndarray, tf: np.ndarray, numbers: np.ndarray, _: pa.Array | None) -> pa.Table:
        weight = unit_weights(keys, key, text, tf, numbers[:, 1])
        idx, place = np.unique(numbers[:, 0].astype(np.int64), return_inverse=True)
        own = keys[label].to_numpy()[text]
        sums = [np.bincount(place, np.where(own == c, weight, 0.0), len(idx)) for c in range(n_classes)]
        return pa.table([pa.array(idx), *map(pa.array, sums)], ["term_idx", *[f"s{c}" for c in range(n_classes)]])

    table = vocabulary.table(counts.sparkSession)
    ddl = "term_idx long, " + ", ".join(f"s{c} double" for c in range(n_classes))
    parts = joined_blocks(counts, table, ["term_idx", "idf"], 2, vocabulary.n_bytes, rows_of, ddl)
    return parts.groupBy("term_idx").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(n_classes)]).join(table, "term_idx")


def fit_centroid(df: DataFrame, key: str, text: str, label: str, vocabulary: Vocabulary, profile: str, scale: float = 10.0) -> TextModel:
    """Nearest class mean of the TF-IDF vectors."""
    sizes = class_sizes(df, label)
    counts = term_counts(df, key, text, profile, carry=(label,))
    if fits_broadcast(vocabulary.n_bytes):
        sums = _term_sums(tfidf_long(counts, key, vocabulary), F.col("weight"), label, len(sizes))
    else:
        sums = _block_sums(counts, key, label, vocabulary, len(sizes))
    means = F.array(*[F.col(f"s{c}") / max(n, 1) * scale for c, n in enumerate(sizes)])
    spark = df.sparkSession
    path = work_path(spark, "model")
    sums.select("term_idx", "term", "df", "idf", means.alias("w")).write.parquet(f"{path}/sums")
    terms = spark.read.parquet(f"{path}/sums")
    squares = terms.agg(*[F.sum(F.get("w", F.lit(c)) ** 2).alias(f"q{c}") for c in range(len(sizes))]).first()
    intercepts = [-0.5 * q / scale for q in squares]
    return save_model(terms, intercepts, profile, "tfidf", vocabulary, path)


def fit_naive_bayes(df: DataFrame, key: str, text: str, label: str, vocabulary: Vocabulary, profile: str, smoothing: float = 1.0) -> TextModel:
    """Multinomial naive Bayes on term counts, with additive smoothing."""
    spark = df.sparkSession
    sizes = class_sizes(df, label)
    classes = range(len(sizes))
    found = portions(df.select(key, label, text), key).select(label, explode_terms(terms(F.col(text), profile))).filter(F.col("term").isNotNull())
    counts = found.groupBy("term").agg(*_by_class(F.lit(1.0), label, len(sizes)))  # added up within tasks of bounded size
    path = work_path(spark, "model")
    counts.join(vocabulary.table(spark), "term").write.parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums")
    totals = sums.agg(*[F.sum(f"s{c}") for c in classes]).first()
    weights = [
        F.log(F.col(f"s{c}") + smoothing) - float(np.log(totals[c] + smoothing * vocabulary.n_terms)) for c in classes
    ]
    prior = [float(np.log(n + smoothing) - np.log(sum(sizes) + smoothing * len(sizes))) for n in sizes]
    return save_model(sums.withColumn("w", F.array(*weights)), prior, profile, "counts", vocabulary, path)


def term_logits(df: DataFrame, key: str, text: str, model: TextModel) -> DataFrame:
    """(key, logits) through a join with the weight table; for any size of model.

    Texts without a known term stay and get the intercepts. The sums per text
    need no vector: the length of the TF-IDF vector is divided out at the end.
    """
    table = model.table(df.sparkSession).select("term", "df", "idf", "w")
    counts = term_counts(df, key, text, model.profile, keep_empty=True)
    if not fits_broadcast(model.n_bytes):
        return _block_logits(counts, key, model, table)
    rows = join_terms(counts, key, table, model.n_bytes, model.n_docs, "left")
    known = F.col("w").isNotNull()
    x = sublinear_tf(F.col("tf")) * F.col("idf") if model.weighting == "tfidf" else F.col("tf").cast("double")
    rows = rows.withColumn("x", F.when(known, x))
    sums = rows.groupBy(key).agg(
        F.sum(F.col("x") * F.col("x")).alias("_q"),
        *[F.sum(F.col("x") * F.get("w", F.lit(c))).alias(f"_s{c}") for c in range(model.n_classes)],
    )
    length = F.sqrt("_q") if model.weighting == "tfidf" else F.lit(1.0)
    logits = [F.coalesce(F.col(f"_s{c}") / length, F.lit(0.0)) + b for c, b in enumerate(model.intercepts)]
    return sums.select(key, F.array(*logits).alias("logits"))


def _logit_lists(model: TextModel):
    """A function from a block's entries (text, count, idf and weights) and its number of texts to the texts' logits."""
    bias, weighting = np.array(model.intercepts), model.weighting

    def lists(text: np.ndarray, tf: np.ndarray, numbers: np.ndarray, n: int, has_text: np.ndarray | None = None) -> pa.Array:
        x = (1.0 + np.log(tf)) * numbers[:, 0] if weighting == "tfidf" else tf
        z = np.stack([np.bincount(text, x * numbers[:, 1 + c], n) for c in range(len(bias))], axis=1).astype(np.float64)  # counts of nothing are whole numbers
        if weighting == "tfidf":
            length = np.sqrt(np.bincount(text, x * x, n))
            z /= np.where(length > 0, length, 1.0)[:, None]
        z += bias
        ends = pa.array(np.arange(0, z.size + 1, len(bias), dtype=np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(z.ravel()), mask=None if has_text is None else pa.array(~has_text))

    return lists


def _block_logits(counts: DataFrame, key: str, model: TextModel, table: DataFrame) -> DataFrame:
    lists, bias = _logit_lists(model), model.intercepts

    def rows_of(keys: pa.Table, text: np.ndarray, tf: np.ndarray, numbers: np.ndarray, _: pa.Array | None) -> pa.Table:
        return keys.append_column("logits", lists(text, tf, numbers, len(keys)))

    kind = dict(counts.dtypes)[key]
    return joined_blocks(counts, table, ["idf", "w"], 1 + len(bias), model.n_bytes, rows_of, f"`{key}` {kind}, logits array<double>")


def _row_logits(spark: SparkSession, model: TextModel):
    """Terms in index order and an Arrow function (indices, counts) -> logits."""
    rows = model.table(spark).orderBy("term_idx").select("term", "idf", "w").toArrow()
    weights = np.array(rows["w"].combine_chunks().flatten()).reshape(len(rows), model.n_classes)
    shared = spark.sparkContext.broadcast((np.array(rows["idf"]), weights, np.array(model.intercepts), model.weighting))

    def block_logits(indices: pd.Series, counts: pd.Series) -> np.ndarray:
        idf, weights, bias, weighting = shared.value
        z = np.zeros((len(indices), len(bias)))
        sizes = indices.map(len).to_numpy()
        # Sums over each row's stretch; rows without a term have none.
        full = np.flatnonzero(sizes)
        if len(full):
            idx, x = np.concatenate(indices.to_numpy()), np.concatenate(counts.to_numpy())
            if weighting == "tfidf":
                x = (1.0 + np.log(x)) * idf[idx]
            starts = np.concatenate(([0], np.cumsum(sizes)))[full]
            z[full] = np.add.reduceat(x[:, None] * weights[idx], starts, axis=0)
            if weighting == "tfidf":
                z[full] /= np.sqrt(np.add.reduceat(x * x, starts))[:, None]
        return z + bias

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def logits(indices: pd.Series, counts: pd.Series) -> pd.Series:
        blocks = range(0, len(indices), BLOCK_ROWS)
        return pd.Series([z for i in blocks for z in block_logits(indices[i : i + BLOCK_ROWS], counts[i : i + BLOCK_ROWS])])

    return rows["term"].to_pylist(), logits


def score_texts(df: DataFrame, text: str, model: TextModel, driver_bytes: int = DRIVER_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Add ``logits``, ``probs`` and ``pred``; all null where the text is null.

    Every input row is kept, and every column or those of ``keep``. A model of up to ``driver_bytes`` is broadcast and the rows
    stay where they are. A larger one is joined by term, in blocks of rows that keep all their columns.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != "logits"]
    if model.n_bytes <= driver_bytes:
        known, logits = _row_logits(df.sparkSession, model)
        rows = with_count_arrays(df, text, model.profile, known)
        rows = rows.withColumn("logits", F.when(F.col(text).isNotNull(), logits("_idx", "_tf"))).select(*keep, "logits")
    else:
        lists = _logit_lists(model)

        def rows_of(rows: pa.Table, text: np.ndarray, tf: np.ndarray, numbers: np.ndarray, has_text: np.ndarray) -> pa.Table:
            return rows.append_column("logits", lists(text, tf, numbers, len(rows), has_text))

        found = F.when(F.col(text).isNotNull(), terms(F.col(text), model.profile))
        table = model.table(df.sparkSession).select("term", "idf", "w")
        schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])
        rows = joined_rows(df, found, table, ["idf", "w"], 1 + model.n_classes, model.n_bytes, rows_of, schema, keep=keep)
    return rows.withColumn("probs", softmax(F.col("logits"))).withColumn("pred", argmax(F.col("probs")))


def with_prediction_columns(scored: DataFrame) -> DataFrame:
    """Name the prediction: the input columns, Pred_Label and one Prob_ column per class."""
    kept = [c for c in scored.columns if c not in ("logits", "probs", "pred")]
    return scored.select(
        *kept,
        label_name(F.col("pred")).alias("Pred_Label"),
        *[F.get("probs", F.lit(i)).alias(f"Prob_{name}") for name, i in LABEL_IDS.items()],
    )


def audit_table(scored: DataFrame, text: str = "text", with_probs: bool = True) -> DataFrame:
    """(text, true_label_id, true_label, pred_label_id, pred_label, prob_..)."""
    probs = [F.get("probs", F.lit(i)).alias(f"prob_{name}") for name, i in LABEL_IDS.items()] if with_probs else []
    return scored.select(
        F.col(text).alias("text"),
        F.col("y").alias("true_label_id"),
        label_name(F.col("y")).alias("true_label"),
        F.col("pred").alias("pred_label_id"),
        label_name(F.col("pred")).alias("pred_label"),
        *probs,
    )
