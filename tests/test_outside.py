"""Scorers from outside: their answers are checked, rows and columns are kept."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from classgauge.operators import outside, textmodel
from classgauge.plans import workbench

ROWS = [(1, "good"), (2, None), (3, ""), (3, "bad bad"), (None, "good")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(*r, "x", 0.5) for r in ROWS], "id long, text string, pred string, weight double").repartition(2)


def by_length(payload):
    base = float(payload.decode() or 1)

    def score(batch):
        assert 0 < len(batch) <= 2 and None not in batch
        z = np.array([[len(t), base, 0.0] for t in batch], float)
        return outside.softmax_rows(z)

    return score


def test_rows_and_columns_are_kept(texts):
    got = outside.score_outside(texts, "text", by_length, 3, b"2", batch_rows=2)
    assert got.columns == ["id", "text", "weight", "probs", "pred"]  # an old prediction is replaced
    rows = got.collect()
    assert sorted(((r["id"] or 0, r["text"] or "") for r in rows)) == sorted(((i or 0, t or "") for i, t in ROWS))
    for r in rows:
        if r["text"] is None:
            assert r["probs"] is None and r["pred"] is None
        else:
            assert sum(r["probs"]) == pytest.approx(1) and r["pred"] == (0 if len(r["text"]) > 2 else 1)
    named = textmodel.with_prediction_columns(got)
    assert named.columns == ["id", "text", "weight", "Pred_Label", "Prob_NEG", "Prob_POS", "Prob_NEU"]
    assert "Exchange" not in outside.score_outside(texts.sparkSession.range(3).selectExpr("id", "string(id) text"), "text", by_length, 3)._jdf.queryExecution().executedPlan().toString()
    assert outside.score_outside(texts.where("false"), "text", by_length, 3).count() == 0


@pytest.mark.parametrize(
    ("answer", "reason"),
    [
        (lambda t: np.full((len(t), 2), 0.5), "shape"),
        (lambda t: np.full((len(t) + 1, 3), 1 / 3), "shape"),
        (lambda t: np.full((len(t), 3), 0.5), "sum to 1"),
        (lambda t: np.tile([1.5, -0.5, 0.0], (len(t), 1)), "no probability"),
        (lambda t: np.full((len(t), 3), np.nan), "no probability"),
    ],
)
def test_wrong_answers_are_refused(texts, answer, reason):
    with pytest.raises(PythonException, match=reason):
        outside.score_outside(texts, "text", lambda _: answer, 3).collect()


def test_arguments_are_checked(texts, monkeypatch):
    monkeypatch.setattr(outside, "PAYLOAD_BYTES", 3)
    with pytest.raises(ValueError, match="too large"):
        outside.score_outside(texts, "text", by_length, 3, b"four")
    for bad in ({"batch_rows": 0, "n_classes": 3}, {"n_classes": 1}):
        with pytest.raises(ValueError, match="at least"):
            outside.score_outside(texts, "text", by_length, **bad)


def test_scored_table_is_evaluated(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 5), int(i % 5 < 2)) for i in range(100)], "id long, text string, y int")
    tables = workbench.evaluate(outside.score_outside(rows, "text", lambda _: lambda t: outside.softmax_rows(np.array([[len(x), 1.5, -9.0] for x in t], float)), 3))
    assert {r["metric"]: r["value"] for r in tables["metrics"].collect()}["accuracy"] == 1.0
