import pytest
from pyspark.sql import functions as F

from classgauge.operators import split


def make(spark, sizes):
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "id long, label int")


def counts(df):
    return {(r["label"], r["split"]): r["count"] for r in df.groupBy("label", "split").count().collect()}


def test_quotas_and_partitioning(spark):
    df = make(spark, {0: 51, 1: 299, 2: 49})
    parts = split.stratified_split(df, "id", "label")
    want = {(0, "train"): 36, (0, "val"): 5, (0, "test"): 10, (1, "train"): 209, (1, "val"): 30, (1, "test"): 60}
    want |= {(2, "train"): 34, (2, "val"): 5, (2, "test"): 10}
    assert counts(parts) == want
    assert parts.count() == 399 and parts.select("id").distinct().count() == 399
    again = split.stratified_split(df.repartition(7), "id", "label")
    assert parts.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    other = split.stratified_split(df, "id", "label", seed=43)
    assert counts(other) == want and parts.exceptAll(other).count() > 0


def test_split_is_a_rank_cut(spark):
    """Same as ranking each whole class by its hash."""
    from pyspark.sql import Window as W

    df = make(spark, {0: 40, 1: 700})
    quotas = split.split_quotas(df.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(W.partitionBy("label").orderBy(split.row_hash(F.col("id"), 42), "id"))
    direct = df.withColumn("rk", rank).join(quotas, "label")
    direct = direct.withColumn("want", F.when(F.col("rk") <= F.col("n_test"), "test").when(F.col("rk") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train"))
    got = split.stratified_split(df, "id", "label")
    assert got.join(direct, "id").filter(F.col("split") != F.col("want")).count() == 0


def test_unlabelled_rows_stay_out_and_wide_rows_are_not_shuffled(spark):
    df = make(spark, {0: 30, 1: 30}).withColumn("label", F.when(F.col("id") != 3, F.col("label")))
    parts = split.stratified_split(df, "id", "label")
    assert parts.count() == 59
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("sizes", [{0: 30, 1: 1}, {c: 2 for c in range(5)}])
def test_guards(spark, sizes):
    with pytest.raises(Exception, match="fewer"):
        split.stratified_split(make(spark, sizes), "id", "label").collect()


def test_fit_rows(spark):
    parts = split.stratified_split(make(spark, {0: 40, 1: 40}), "id", "label")
    assert split.fit_rows(parts).count() == 64


class _Unset:
    """A session whose shared folder is not set."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default):
        return default


def test_shared_folder(spark):
    from classgauge.session import work_path

    assert spark.conf.get("spark.no.such.setting", None) is None
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or work_path(spark, "x").startswith(base)
    local = work_path(_Unset("local[2]"), "x")
    assert "/classgauge-" in local and work_path(_Unset("local[2]"), "x") != local
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_path(_Unset("spark://host:7077"), "x")
