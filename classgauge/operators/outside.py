"""Scoring with a model from outside: any function from texts to class probabilities.

The function runs inside the tasks on batches of texts; rows stay where they are. What it
returns is checked before it becomes a column, so everything that takes a scored table takes these too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.functions.vectors import argmax

# Fixed value: texts in a batch when a model only scores.
BATCH_ROWS = 64
PAYLOAD_BYTES = 1 << 30
SUM_GAP = 1e-6

Scorer = Callable[[list[str]], np.ndarray]


def checked_probabilities(values: np.ndarray, n_rows: int, n_classes: int) -> np.ndarray:
    """The function's answer for one batch; refused unless it has a row of probabilities for each text."""
    values = np.asarray(values, dtype=float)
    if values.shape != (n_rows, n_classes):
        raise ValueError(f"the scorer returned shape {values.shape} for {n_rows} texts and {n_classes} classes")
    if not np.isfinite(values).all() or (values < 0).any():
        raise ValueError("the scorer returned a number that is no probability")
    gap = float(np.abs(values.sum(1) - 1).max(initial=0.0))
    if gap > SUM_GAP:
        raise ValueError(f"the scorer's probabilities sum to 1 up to {gap} only")
    return values


def softmax_rows(logits: np.ndarray) -> np.ndarray:
    """For scorers that end in logits."""
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def score_outside(
    df: DataFrame, text: str, make: Callable[[bytes], Scorer], n_classes: int, payload: bytes = b"", batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Add ``probs`` and ``pred`` by a function from outside; both null where the text is null.

    ``make`` gets ``payload`` (a model file's bytes, say) once in each task and returns the function, which gets at most ``batch_rows``
    texts at a time, never a null, and returns a row of ``n_classes`` probabilities for each, in order. Every input row and column
    is kept. The payload is broadcast and refused past PAYLOAD_BYTES. A wrong answer fails the task with its reason.
    """
    if len(payload) > PAYLOAD_BYTES:
        raise ValueError(f"a payload of {len(payload)} bytes is too large to broadcast; let `make` load it")
    if batch_rows < 1 or n_classes < 2:
        raise ValueError("batch_rows must be at least 1 and n_classes at least 2")
    shared = df.sparkSession.sparkContext.broadcast(payload)
    kept = [c for c in df.columns if c not in ("logits", "probs", "pred")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_outside_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for low in range(0, len(at), batch_rows):
                scorer = scorer or make(shared.value)
                own = at[low : low + batch_rows]
                for i, p in zip(own, checked_probabilities(scorer([texts[i] for i in own]), len(own), n_classes).tolist(), strict=True):
                    out[i] = p
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "probs"])

    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[:-1]) + "probs array<double>"
    return rows.mapInArrow(run, schema).withColumn("pred", argmax(F.col("probs")))
