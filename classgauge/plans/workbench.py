"""The jobs end to end: train and test, compare two models, evaluate any scored table, score new texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classgauge.operators.features import DRIVER_BYTES, fit_vocabulary
from classgauge.operators.logreg import search_and_fit
from classgauge.operators.metrics import confusion_matrix, metric_cells, reliability
from classgauge.operators.roc import auc_per_class, macro_auc_interpolated, roc_points, running_counts
from classgauge.operators.split import fit_rows, stored_split
from classgauge.operators.textmodel import TextModel, audit_table, fit_naive_bayes, score_texts, with_prediction_columns
from classgauge.plans.reports import (
    baseline_report,
    classification_report,
    detailed_metrics,
    evaluation_record,
    pair_report,
    per_class_report,
)
from classgauge.session import written
from classgauge.sources.sinks import write_report, write_rows
from classgauge.sources.tables import LABEL_IDS, lines_to_rows, read_new_texts, require_column

CLASSES = sorted(LABEL_IDS.values())


@dataclass(frozen=True)
class TrainedRun:
    model: TextModel
    best_c: float
    grid: DataFrame
    scored_test: DataFrame  # id, text, y, pred, probs


def train_and_test(labelled: DataFrame, profile: str = "arabic", seed: int = 42) -> TrainedRun:
    """Split (id, text, label), search, refit and score the test slice once."""
    rows = stored_split(labelled, "id", "label", seed)
    model, grid, best = search_and_fit(rows, profile=profile)
    test = rows.filter(F.col("split") == "test")
    scored = score_texts(test, "text", model).withColumnRenamed("label", "y")
    return TrainedRun(model, best, grid, written(scored, "scored"))


def evaluate(scored: DataFrame, name: str = "model") -> dict[str, DataFrame]:
    """All tables about a scored table (id, y, pred, probs)."""
    cells = written(metric_cells(scored), "cells")
    runs = running_counts(scored)
    return {
        "metrics": detailed_metrics(cells),
        "record": evaluation_record(cells, name),
        "per_class": per_class_report(cells, CLASSES),
        "report": classification_report(cells),
        "confusion": confusion_matrix(cells, CLASSES),
        "reliability": reliability(cells),
        "roc": roc_points(runs),
        "auc": auc_per_class(runs),
        "macro_auc": macro_auc_interpolated(runs),
        "baseline": baseline_report({name: cells}),
    }


@dataclass(frozen=True)
class Comparison:
    scored: dict[str, DataFrame]  # by model: id, text, y, pred, probs of the same test rows
    tables: dict[str, dict[str, DataFrame]]  # by model: what ``evaluate`` gives
    pair: DataFrame  # areas of both and McNemar's test


def compare(labelled: DataFrame, profile: str = "arabic", seed: int = 42) -> Comparison:
    """Logistic regression and naive Bayes on one shared split of (id, text, label), side by side.

    Both are fitted on all rows outside the test slice, each with the vocabulary of those rows.
    """
    rows = stored_split(labelled, "id", "label", seed)
    logreg, _, _ = search_and_fit(rows, profile=profile)
    fit = fit_rows(rows)
    bayes = fit_naive_bayes(fit, "id", "text", "label", fit_vocabulary(fit, "text", profile), profile)
    test = rows.filter(F.col("split") == "test")
    scored = {
        name: written(score_texts(test, "text", model).withColumnRenamed("label", "y"), "scored")
        for name, model in (("logreg", logreg), ("bayes", bayes))
    }
    return Comparison(scored, {name: evaluate(table, name) for name, table in scored.items()}, pair_report(scored["logreg"], scored["bayes"]))


def write_evaluation(scored: DataFrame, out: str, text: str = "text", with_probs: bool = True) -> None:
    """Write the overall, per-class and prediction files."""
    cells = written(metric_cells(scored), "cells")
    write_report(detailed_metrics(cells), f"{out}/detailed_metrics")
    write_report(per_class_report(cells, CLASSES).orderBy("class_id"), f"{out}/per_class_report")
    write_rows(audit_table(scored, text, with_probs), f"{out}/test_predictions")


def score_lines(df: DataFrame, key: str, text: str, model: TextModel, with_line: bool = True, driver_bytes: int = DRIVER_BYTES) -> DataFrame:
    """Score every non-blank line of a text: (key, line_no, line, Pred_Label, Prob_..), or without the line."""
    lines = lines_to_rows(df, key, text)
    return with_prediction_columns(score_texts(lines, "line", model, driver_bytes, keep=[key, "line_no", *["line"] * with_line]))


def score_csv(
    spark: SparkSession, path: str, out: str, model: TextModel, text_column: str = "text", key: str | None = None
) -> DataFrame:
    """Read a CSV, add the prediction columns, write it; returns the rows that did not parse."""
    good, bad = read_new_texts(spark, path, text_column=text_column)
    require_column(good, text_column)
    write_rows(with_prediction_columns(score_texts(good, text_column, model)), out)
    return bad
