import math

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from classgauge.functions.vectors import argmax, softmax
from classgauge.operators import bootstrap, compare, metrics, roc
from classgauge.plans import reports

SCHEMA = "id long, y int, pred int, probs array<double>"


def scored(spark, ys, preds, probs=None):
    probs = probs or [[0.5, 0.3, 0.2]] * len(ys)
    return spark.createDataFrame([(i, y, p, q) for i, (y, p, q) in enumerate(zip(ys, preds, probs))], SCHEMA)


def random_scored(spark, n=600, c=4, seed=1, digits=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, c, n)
    z = rng.normal(size=(n, c)) * 1.5
    z[np.arange(n), y] += 1.0
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    p = np.round(p, digits)  # many equal scores
    p[:, -1] = 1 - p[:, :-1].sum(1)
    pred = p.argmax(1)
    rows = [(i, int(a), int(b), list(map(float, q))) for i, (a, b, q) in enumerate(zip(y, pred, p))]
    return spark.createDataFrame(rows, SCHEMA), y, pred, p


def test_precision_recall_case(spark):
    table = scored(spark, [0, 0, 1, 2], [0, 1, 1, 1])
    cells = metrics.metric_cells(table)
    rows = {r["class_id"]: r for r in metrics.per_class(cells, [0, 1, 2, 3]).collect()}
    assert [rows[c]["precision"] for c in range(4)] == pytest.approx([1, 1 / 3, 0, 0])
    assert [rows[c]["recall"] for c in range(4)] == pytest.approx([0.5, 1, 0, 0])
    assert [rows[c]["f1"] for c in range(4)] == pytest.approx([2 / 3, 0.5, 0, 0])
    assert [rows[c]["support"] for c in range(4)] == [2, 1, 1, 0]
    row = metrics.metric_row(cells).first()
    assert row["f1_macro"] == pytest.approx(7 / 18)
    assert row["accuracy"] == 0.5
    assert row["f1_weighted"] == pytest.approx(11 / 24)
    assert row["recall_weighted"] == pytest.approx(row["accuracy"])
    assert metrics.macro_scores(cells).first()["f1_macro"] == pytest.approx(7 / 18)
    assert metrics.weighted_scores(cells).first()["f1_weighted"] == pytest.approx(11 / 24)


def test_confusion(spark):
    table = scored(spark, [0, 0, 1, 2], [0, 1, 1, 1])
    full = metrics.confusion_matrix(table, [0, 1, 2])
    assert full.count() == 9 and full.agg(F.sum("n")).first()[0] == 4
    assert metrics.confusion_matrix(table).count() == 4
    wide = {r["y"]: tuple(r)[1:] for r in metrics.confusion_wide(table, [0, 1, 2]).collect()}
    assert wide == {0: (1, 1, 0), 1: (0, 1, 0), 2: (0, 1, 0)}


def test_brier_and_log_loss(spark):
    cells = metrics.metric_cells(scored(spark, [0], [0], [[0.5, 0.25, 0.25]]))
    assert metrics.brier_score(cells).first()[0] == pytest.approx(0.375)
    assert metrics.log_loss(cells).first()[0] == pytest.approx(math.log(2))
    cells = metrics.metric_cells(scored(spark, [1], [0], [[1.0, 0.0, 0.0]]))
    assert metrics.log_loss(cells).first()[0] == pytest.approx(-math.log(metrics.EPS))


def test_calibration_edges(spark):
    cells = metrics.metric_cells(scored(spark, [0, 1], [0, 0], [[0.9, 0.1], [0.9, 0.1]]))
    assert metrics.calibration_error(cells).first()[0] == pytest.approx(0.4)
    edges = [0.0] + [k / 15 for k in range(1, 16)]
    got = spark.createDataFrame([(e,) for e in edges], "c double").select(metrics.confidence_bin(F.col("c"))).collect()
    assert [r[0] for r in got] == [0, *range(15)]


def test_metrics_match_numpy(spark):
    table, y, pred, p = random_scored(spark)
    cells = metrics.metric_cells(table.repartition(5))
    row = metrics.metric_row(cells).first()
    onehot = np.eye(4)[y]
    assert row["brier_score"] == pytest.approx(((p - onehot) ** 2).sum(1).mean())
    clipped = np.clip(p[np.arange(len(y)), y], metrics.EPS, 1 - metrics.EPS)
    assert row["log_loss"] == pytest.approx(-np.log(clipped).mean())
    conf, edges, total = np.round(p.max(1), 9), np.linspace(0, 1, 16), 0.0
    for i in range(15):
        m = (conf > edges[i]) & (conf <= edges[i + 1]) if i else conf <= edges[1]
        if m.any():
            total += m.mean() * abs((pred[m] == y[m]).mean() - conf[m].mean())
    assert metrics.calibration_error(cells).first()[0] == pytest.approx(total)
    assert metrics.reliability(cells).agg(F.sum("n")).first()[0] == len(y)
    by = metrics.metric_row(
        metrics.metric_cells(table.withColumn("m", F.lit("a")).unionByName(table.withColumn("m", F.lit("b"))), by=("m",)), by=("m",)
    ).collect()
    assert len(by) == 2 and all(r["f1_macro"] == pytest.approx(row["f1_macro"]) for r in by)


def numpy_roc(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    last = np.r_[np.flatnonzero(np.diff(s)), len(s) - 1]
    tp = np.cumsum(y)[last]
    fp = 1 + last - tp
    return np.r_[0, fp] / fp[-1], np.r_[0, tp] / tp[-1]


def area(x, y):
    return float(np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2))


@pytest.mark.parametrize("digits", [9, None])
def test_roc_matches_numpy(spark, digits):
    table, y, _, p = random_scored(spark, digits=2)
    p = np.round(p, 9) if digits else p
    runs = roc.running_counts(table, digits)
    curves = [numpy_roc((y == c).astype(int), p[:, c]) for c in range(4)]
    got = {r["class_id"]: r["auc"] for r in roc.auc_per_class(runs).collect()}
    for c, (fpr, tpr) in enumerate(curves):
        assert got[c] == pytest.approx(area(fpr, tpr), abs=1e-12)
        points = roc.roc_points(runs).filter(F.col("class_id") == c).orderBy("fpr", "tpr").collect()
        assert [r["fpr"] for r in points] == pytest.approx(list(fpr)) and [r["tpr"] for r in points] == pytest.approx(list(tpr))
    grid = np.unique(np.concatenate([c[0] for c in curves]))
    mean = np.mean([np.interp(grid, f, t) for f, t in curves], axis=0)
    assert roc.macro_auc_interpolated(runs).first()[0] == pytest.approx(area(grid, mean), abs=1e-12)
    assert roc.macro_auc_ovr(runs, table).first()[0] == pytest.approx(np.mean([area(*c) for c in curves]))


def binary(spark, pairs):
    return scored(spark, [y for _, y in pairs], [1] * len(pairs), [[1 - s, s] for s, _ in pairs])


def test_auc_cases(spark):
    runs = roc.running_counts(binary(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)]))
    assert {r["class_id"]: r["auc"] for r in roc.auc_per_class(runs).collect()} == pytest.approx({0: 0.875, 1: 0.875})
    runs = roc.running_counts(binary(spark, [(0.5, 1), (0.5, 0), (0.5, 0)]))
    assert {r["class_id"]: r["auc"] for r in roc.auc_per_class(runs).collect()} == pytest.approx({0: 0.5, 1: 0.5})


def test_auc_needs_all_classes_and_probabilities(spark):
    table = scored(spark, [0, 1], [0, 1], [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1]])
    runs = roc.running_counts(table)
    assert {r["class_id"]: r["auc"] for r in roc.auc_per_class(runs).collect()}[2] is None
    assert roc.macro_auc_interpolated(runs).first()[0] is None
    with pytest.raises(Exception, match="every class"):
        roc.macro_auc_ovr(runs, table).collect()
    off = scored(spark, [0, 1], [0, 1], [[0.8, 0.1], [0.1, 0.8]])
    with pytest.raises(Exception, match="add up"):
        roc.macro_auc_ovr(roc.running_counts(off), off).collect()


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1000.0] * 3,), ([0.2, 0.4, 0.4],)], "z array<double>")
    rows = df.select(softmax(F.col("z")), argmax(F.col("z"))).collect()
    assert rows[0][0] == pytest.approx([1 / 3] * 3) and rows[0][1] == 0 and rows[1][1] == 1
    assert sum(rows[1][0]) == pytest.approx(1)


def test_mcnemar_cases(spark):
    df = spark.createDataFrame([(10, 5), (3, 3), (0, 0)], "b long, c long")
    rows = compare.mcnemar(df).collect()
    assert [r["chi2"] for r in rows] == pytest.approx([16 / 15, 1 / 6, 0.0])
    assert rows[2]["p_value"] == 1.0
    from classgauge.functions.vectors import chi2_tail_1df

    p = spark.createDataFrame([(3.841459,)], "x double").select(chi2_tail_1df("x")).first()[0]
    assert p == pytest.approx(0.05, abs=1e-6)


def test_erfc_is_exact_everywhere(spark):
    from classgauge.functions.vectors import erfc

    points = [k / 50 for k in range(400)] + [2.0 - 1e-12, 10.0, 26.0, 40.0]
    rows = spark.createDataFrame([(t,) for t in points], "t double").select("t", erfc(F.col("t")).alias("v")).collect()
    assert all(r["v"] == pytest.approx(math.erfc(r["t"]), rel=1e-11, abs=1e-15) for r in rows)
    plan = spark.createDataFrame([(1, 2)], "b long, c long")
    assert "Python" not in compare.mcnemar(plan)._jdf.queryExecution().executedPlan().toString()


def test_binomial_draws(spark):
    """By inversion the least count whose share reaches the uniform number; for large means the law's moments; the ends are sure."""
    from math import comb

    draw = lambda rows: [r[0] for r in spark.createDataFrame(rows, "n long, p double, u double, v double").select(bootstrap.binomial(F.col("n"), F.col("p"), F.col("u"), F.col("v"))).collect()]
    rng = np.random.default_rng(1)
    rows = [(int(n), float(p), float(u), 0.5) for n, p, u in zip(rng.integers(0, 60, 300), rng.random(300), rng.random(300))]
    for (n, p, u, _), k in zip(rows, draw(rows)):
        q = min(p, 1 - p)
        upto = np.cumsum([comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(n + 1)])
        rare = int(np.searchsorted(upto, u))
        assert k == (n - rare if p > 0.5 else rare)
    assert draw([(9, 0.0, 0.7, 0.1), (9, 1.0, 0.7, 0.1), (0, 0.4, 0.99, 0.1), (10**12, 1.0, 0.2, 0.3)]) == [0, 9, 0, 10**12]
    for n, p in ((3000, 0.3), (10**12, 0.7), (500, 0.45)):
        k = np.array(draw([(n, p, float(u), float(v)) for u, v in rng.random((4000, 2))]), float)
        spread = math.sqrt(n * p * (1 - p))
        assert abs(k.mean() - n * p) < 4 * spread / math.sqrt(4000) and 0.95 < k.std() / spread < 1.05 and k.min() >= 0 and k.max() <= n


def test_metrics_do_not_change_by_a_bit(spark):
    """However the rows are dealt and ordered, and however many cells and classes a task holds."""
    table, *_ = random_scored(spark)
    table = table.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).withColumn("probs", F.transform("probs", lambda p: p * 0.999 + 0.001 * F.pow(F.lit(0.7), F.col("copy")) / 4))
    seen = set()
    for dealt in (table.repartition(1), table.repartition(7, "copy"), table.orderBy(F.desc("copy")).repartition(13)):
        cells = metrics.metric_cells(dealt)
        rows = [*metrics.metric_row(cells).collect(), *metrics.calibration_error(cells).collect(), *metrics.log_loss(cells).collect(), *metrics.reliability(cells).orderBy("bin").collect()]
        seen.add(tuple(tuple(x.hex() if isinstance(x, float) else x for x in r) for r in rows))
    assert len(seen) == 1


def test_resamples_have_all_draws(spark):
    table, y, _, _ = random_scored(spark)
    cells = metrics.confusion_cells(table)
    drawn = bootstrap.resampled_cells(cells, 300, 5)
    sums = drawn.groupBy("replicate").agg(F.sum("n").alias("n")).collect()
    assert len(sums) == 300 and {r["n"] for r in sums} == {len(y)}
    means = {(r["y"], r["pred"]): r["m"] for r in drawn.groupBy("y", "pred").agg((F.sum("n") / 300).alias("m")).collect()}
    for r in cells.collect():
        assert means[r["y"], r["pred"]] == pytest.approx(r["n"], abs=5 * math.sqrt(r["n"] / 300) + 0.05)
    assert "Python" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_baseline_and_pairs(spark):
    table = scored(spark, [1, 1, 0, 0, 2], [1, 0, 0, 0, 2])
    assert compare.majority_class(table).first()["majority"] == 0
    counts = compare.baseline_counts(table).first()
    assert (counts["majority"], counts["b"], counts["c"]) == (0, 2, 0)
    other = scored(spark, [1, 1, 0, 0, 2], [0, 1, 0, 1, 1])
    pair = compare.paired_counts(table, other).first()
    assert (pair["b"], pair["c"]) == (3, 1)
    report = reports.baseline_report({"a": table, "b": other}).collect()
    assert {r["model"] for r in report} == {"a", "b"} and all(0 <= r["p_value"] <= 1 for r in report)


def test_bootstrap(spark):
    perfect = metrics.confusion_cells(scored(spark, [0, 1, 2] * 20, [0, 1, 2] * 20))
    assert tuple(bootstrap.bootstrap_macro_f1(perfect, 200).first()) == (1.0, 1.0)
    table, y, pred, _ = random_scored(spark)
    cells = metrics.confusion_cells(table)
    lo, hi = bootstrap.bootstrap_macro_f1(cells, 500).first()
    assert (lo, hi) == tuple(bootstrap.bootstrap_macro_f1(cells.repartition(3), 500).first())
    point = metrics.macro_scores(metrics.metric_cells(table)).first()["f1_macro"]
    assert lo < point < hi
    rng, f1 = np.random.default_rng(7), []
    for _ in range(500):
        i = rng.integers(0, len(y), len(y))
        a, b = y[i], pred[i]
        f1.append(np.mean([2 * ((a == c) & (b == c)).sum() / ((a == c).sum() + (b == c).sum()) for c in range(4)]))
    assert (lo, hi) == pytest.approx(np.percentile(f1, [2.5, 97.5]), abs=0.012)


def test_reports(spark):
    table, y, pred, _ = random_scored(spark)
    cells = metrics.metric_cells(table)
    names = [r["metric"] for r in reports.detailed_metrics(cells, 50).collect()]
    assert names == [*reports.OVERALL, *reports.INTERVAL]
    report = reports.classification_report(cells)
    assert report.count() == 7 and report.filter("class = 'accuracy'").first()["precision"] is None
    text = reports.report_text(report)
    assert "macro avg" in text and f"{(y == pred).mean():.2f}" in text
    record = reports.evaluation_record(cells, "m").drop("name").first().asDict()
    full = spark.createDataFrame([("m", 1.0, [1], "r")], "name string, accuracy double, y_pred array<int>, report string")
    assert reports.record_view(full).columns == ["name", "accuracy"]
    quick = reports.quick_metrics(table.withColumn("logits", F.col("probs"))).first()
    assert quick["f1_macro"] == pytest.approx(record["macro_f1"]) and quick["accuracy"] == pytest.approx(record["accuracy"])
