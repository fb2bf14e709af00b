import pytest
from pyspark.sql import functions as F

from classgauge.plans.workbench import score_csv, write_evaluation
from classgauge.sources import sinks, tables


def test_required_column(spark):
    df = spark.createDataFrame([("x",)], "text string")
    assert tables.require_column(df) == "text"
    with pytest.raises(ValueError, match="body"):
        tables.require_column(df, "body")


def test_csv_reports_bad_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,text\n1,"a, ""b""\nc"\n2,x,y,z\n3,\n', encoding="utf8")
    good, bad = tables.read_new_texts(spark, str(tmp_path))
    assert [tuple(r) for r in good.orderBy("id").collect()] == [("1", 'a, "b"\nc'), ("3", None)]
    assert [r["id"] for r in bad.collect()] == ["2"]
    assert good.select("id").count() == 2
    with pytest.raises(ValueError, match="body"):
        tables.read_new_texts(spark, str(tmp_path), text_column="body")


def test_prepare_labelled(spark):
    rows = [
        (1, "t", "NEG", "['a', 'b']"),
        (2, None, "POS", "['a']"),
        (3, "t", None, "['a']"),
        (4, "", "NEU", "[]"),
        (5, "t", "BAD", "['a']"),
        (6, "t", "POS", None),
    ]
    good, bad = tables.prepare_labelled(spark.createDataFrame(rows, tables.LABELLED_SCHEMA))
    assert sorted(map(tuple, good.collect())) == [(1, "a b", 0), (4, "", 2)]
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [(5, "annotation"), (6, "tokens")]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_labelled_formats(spark, tmp_path, fmt):
    rows = [(1, 'a "q"\nb', "NEG", "['a']"), (2, "c", "POS", "['b']")]
    path = str(tmp_path / fmt)
    sinks.write_rows(spark.createDataFrame(rows, tables.LABELLED_SCHEMA), path, fmt)
    assert sorted(map(tuple, tables.read_labelled(spark, path, fmt).collect())) == rows


def test_lines(spark):
    df = spark.createDataFrame([(1, " a \n\n\tb \n"), (2, "\n")], "id long, text string")
    got = tables.lines_to_rows(df, "id", "text").orderBy("id", "line_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a"), (1, 2, "b")]


def test_names(spark):
    df = spark.createDataFrame([("NEG",), ("POS",), ("NEU",), ("x",)], "a string")
    got = df.select(tables.label_id(F.col("a")).alias("i")).select("i", tables.label_name(F.col("i")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(0, "NEG"), (1, "POS"), (2, "NEU"), (None, None)]


def scored_table(spark):
    rows = [
        (1, 'said "no",\nleft', 0, 0, [0.7, 0.2, 0.1]),
        (2, "good", 1, 1, [0.1, 0.8, 0.1]),
        (3, "so so", 2, 1, [0.2, 0.5, 0.3]),
        (4, "bad", 0, 0, [0.6, 0.3, 0.1]),
        (5, "fine", 1, 1, [0.3, 0.4, 0.3]),
        (6, "eh", 2, 2, [0.3, 0.3, 0.4]),
    ]
    return spark.createDataFrame(rows, "id long, text string, y int, pred int, probs array<double>")


def test_evaluation_files(spark, tmp_path):
    write_evaluation(scored_table(spark), str(tmp_path))
    read = lambda name: spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / name))
    metrics = {r["metric"]: float(r["value"]) for r in read("detailed_metrics").collect()}
    assert len(metrics) == 12 and abs(metrics["accuracy"] - 5 / 6) < 1e-12
    assert metrics["f1_macro_ci_lo"] <= metrics["f1_macro"] <= metrics["f1_macro_ci_hi"]
    assert len(list((tmp_path / "detailed_metrics").glob("part-*"))) == 1
    assert [r["class_label"] for r in read("per_class_report").collect()] == ["NEG", "POS", "NEU"]
    audit = {r["text"]: r for r in read("test_predictions").collect()}
    assert audit['said "no",\nleft']["pred_label"] == "NEG" and audit["so so"]["prob_POS"] == "0.5"
    write_evaluation(scored_table(spark), str(tmp_path / "plain"), with_probs=False)
    assert read("plain/test_predictions").columns == ["text", "true_label_id", "true_label", "pred_label_id", "pred_label"]


def test_score_csv(spark, tmp_path):
    from classgauge.operators.features import fit_vocabulary
    from classgauge.operators.textmodel import fit_naive_bayes, load_model

    train = spark.createDataFrame(
        [(1, "bad bad", 0), (2, "bad day", 0), (3, "good one", 1), (4, "good", 1), (5, "day one", 2)], "id long, text string, label int"
    )
    vocab = fit_vocabulary(train, "text", "generic")
    model = fit_naive_bayes(train, "id", "text", "label", vocab, "generic")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,text\n7,bad\n8,good good\n9,\n", encoding="utf8")
    bad = score_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), load_model(spark, model.path))
    assert bad.count() == 0
    got = {r["k"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert got["7"]["Pred_Label"] == "NEG" and got["8"]["Pred_Label"] == "POS" and got["9"]["Pred_Label"] is None
    assert abs(sum(float(got["7"][f"Prob_{n}"]) for n in ("NEG", "POS", "NEU")) - 1) < 1e-9
