"""Metric tables as the user reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.functions.vectors import argmax
from classgauge.operators.bootstrap import bootstrap_macro_f1
from classgauge.operators.compare import baseline_counts, mcnemar, paired_counts
from classgauge.operators.metrics import (
    calibration_error,
    class_sums,
    metric_row,
    per_class,
)
from classgauge.operators.roc import macro_auc_ovr, running_counts
from classgauge.sources.tables import label_name

# The rows of the overall table, in order.
OVERALL = (
    "accuracy",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "log_loss",
    "brier_score",
    "ece_15bins",
)
INTERVAL = ("f1_macro_ci_lo", "f1_macro_ci_hi")


def _stacked(row: DataFrame, names: tuple[str, ...]) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("row"), F.lit(n).alias("metric"), F.col(n).alias("value")) for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*pairs)).alias("m")).select("m.row", "m.metric", "m.value")


def overall_metrics(cells: DataFrame) -> DataFrame:
    """(row, metric, value) without the bootstrap rows; lazy."""
    ece = calibration_error(cells)
    return _stacked(metric_row(cells).withColumn("ece_15bins", ece.scalar()), OVERALL)


def detailed_metrics(cells: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(row, metric, value): the twelve overall numbers. Pass written cells: they are read twice."""
    interval = bootstrap_macro_f1(cells, replicates, seed)
    shifted = _stacked(interval, INTERVAL).withColumn("row", F.col("row") + len(OVERALL))
    return overall_metrics(cells).unionByName(shifted).orderBy("row")


def per_class_report(cells: DataFrame, labels: list[int], names: bool = True) -> DataFrame:
    """(class_id, class_label, precision, recall, f1, support)."""
    rows = per_class(cells, labels)
    label = label_name(F.col("class_id")) if names else F.col("class_id").cast("string")
    return rows.select("class_id", label.alias("class_label"), "precision", "recall", "f1", "support")


def evaluation_record(cells: DataFrame, name: str) -> DataFrame:
    """One row: name, accuracy, macro_f1, weighted rates, log_loss."""
    return metric_row(cells).select(
        F.lit(name).alias("name"),
        "accuracy",
        F.col("f1_macro").alias("macro_f1"),
        "precision_weighted",
        "recall_weighted",
        "f1_weighted",
        "log_loss",
    )


def record_view(record: DataFrame) -> DataFrame:
    """A record without its bulky fields."""
    return record.drop("y_pred", "report")


def quick_metrics(rows: DataFrame, logits: str = "logits", label: str = "y") -> DataFrame:
    """Accuracy and macro-F1 straight from logits."""
    guessed = rows.select(F.col(label).alias("y"), argmax(F.col(logits)).alias("pred"))
    cells = guessed.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    return metric_row(cells).select("accuracy", "f1_macro")


def classification_report(cells: DataFrame) -> DataFrame:
    """(row, class, precision, recall, f1, support): the classes, then accuracy,
    macro avg and weighted avg. Accuracy has only one value, under f1."""
    classes = per_class(cells).select(
        F.lit(0).alias("row"), F.col("class_id").cast("string").alias("class"), "precision", "recall", "f1", "support"
    )
    total = class_sums(cells).agg(F.sum("support")).scalar()
    row = metric_row(cells).withColumn("support", total)
    none = F.lit(None).cast("double")
    line = lambda i, name, p, r, f: F.struct(
        F.lit(i).alias("row"), F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
        F.col("support").alias("support"),
    )
    means = F.array(
        line(1, "accuracy", none, none, F.col("accuracy")),
        line(2, "macro avg", *[F.col(f"{m}_macro") for m in ("precision", "recall", "f1")]),
        line(3, "weighted avg", *[F.col(f"{m}_weighted") for m in ("precision", "recall", "f1")]),
    )
    return classes.unionByName(row.select(F.explode(means).alias("m")).select("m.*"))


def report_text(report: DataFrame, digits: int = 2) -> str:
    """The report as aligned text: one line per class and three for the means."""
    rows = report.withColumn("_id", F.col("class").try_cast("int")).orderBy("row", "_id").collect()
    width = max(len(r["class"]) for r in rows)
    lines = [" " * width + "".join(f"{h:>10}" for h in ("precision", "recall", "f1-score", "support")), ""]
    for r in rows:
        if r["class"] == "accuracy":
            lines.append("")
        values = [" " * 10 if r[m] is None else f"{r[m]:>10.{digits}f}" for m in ("precision", "recall", "f1")]
        lines.append(f"{r['class']:>{width}}" + "".join(values) + f"{r['support']:>10}")
    return "\n".join(lines)


def baseline_report(scored: dict[str, DataFrame], with_p: bool = True) -> DataFrame:
    """(model, majority, b, c, chi2, p_value) of each model against its majority baseline."""
    out = None
    for name, table in scored.items():
        counts = baseline_counts(table).withColumn("model", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return mcnemar(out.select("model", "majority", "b", "c"), with_p)


def pair_report(a: DataFrame, b: DataFrame, with_p: bool = True) -> DataFrame:
    """(auc_a, auc_b, b, c, chi2, p_value) of two models on the ids they share."""
    tested = mcnemar(paired_counts(a, b), with_p)
    for name, table in (("auc_a", a), ("auc_b", b)):
        tested = tested.withColumn(name, macro_auc_ovr(running_counts(table), table).scalar())
    return tested.select("auc_a", "auc_b", *[c for c in tested.columns if not c.startswith("auc_")])
