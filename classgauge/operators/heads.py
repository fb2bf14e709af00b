"""Linear heads over dense vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.functions.vectors import argmax, linear, softmax


def centroid_head(df: DataFrame, vector: str, label: str, scale: float = 1.0) -> DataFrame:
    """Nearest-centroid weights, one row per class: (class_id, w, b).

    ``w`` is the class mean and ``b`` minus half its squared length, both times
    ``scale``: the larger the score, the nearer the centroid.
    """
    cells = df.select(F.col(label).alias("class_id"), F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy("class_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("class_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"] * scale).alias("w"),
        (F.sum(F.col("m") * F.col("m")) * (-0.5 * scale)).alias("b"),
    )
    return packed.select("class_id", "w", "b")


def head_row(head: DataFrame) -> DataFrame:
    """The whole head as one struct value: classes x features numbers."""
    rows = F.array_sort(F.collect_list(F.struct("class_id", "w", "b")))
    return head.agg(rows.alias("rows")).select(
        F.struct(
            F.transform("rows", lambda r: r["w"]).alias("w"),
            F.transform("rows", lambda r: r["b"]).alias("b"),
        ).alias("head")
    )


def score_vectors(df: DataFrame, vector: str, head: DataFrame) -> DataFrame:
    """Add logits, probabilities and the predicted class.

    The head is a scalar subquery: every task gets its few numbers and the rows
    stay where they are.
    """
    df = df.withColumn("_head", head_row(head).scalar())
    df = df.withColumn("logits", linear(F.col(vector), F.col("_head.w"), F.col("_head.b"))).drop("_head")
    return df.withColumn("probs", softmax(F.col("logits"))).withColumn("pred", argmax(F.col("probs")))
