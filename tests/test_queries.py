"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from classgauge.plans.oracles import ORACLES
from classgauge.plans.queries import QUERIES
from tools.check import TABLES, same

# These fit models by many solver steps; the smallest tables only.
ROWS_ONLY = {
    "logreg_grid": 7,
    "logreg_test_predictions": None,
    "logreg_scored_new_texts": None,
    "logreg_record": 1,
    "lr_vs_bayes_report": 1,
}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES) | set(ROWS_ONLY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ROWS_ONLY:
        assert len(got) == (ROWS_ONLY[name] or len(got)) > 0
    else:
        assert same(got, con.execute(ORACLES[name]).df()) == "same"


def test_labels_meet_texts_without_moving_them(spark, tmp_path, monkeypatch):
    """Null and repeated ids join the same way with labels broadcast and dealt; broadcast, no text is exchanged."""
    from classgauge.plans import queries

    docs = [(1, "a"), (1, "b"), (2, None), (None, "c"), (3, "d"), (4, "e")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (3, 0, None), (9, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = queries.labelled(spark, str(tmp_path))
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(queries, "LABEL_BYTES", 0)
        dealt = queries.labelled(spark, str(tmp_path))
        assert "Exchange hashpartitioning" in dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, rows.collect())) == sorted(map(str, dealt.collect())) and rows.count() == 6
