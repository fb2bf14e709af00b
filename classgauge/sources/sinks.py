"""Writing reports and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str) -> None:
    """A metric table: a dozen rows or one per class, so one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_rows(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Predictions, one row per text: as many files as there are tasks."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
