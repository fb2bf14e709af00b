"""Stratified train / validation / test split by hashed rank.

Rows of a class are ordered by md5(seed:id) and cut at exact quotas. Ranking a
whole class would put it in one task. Instead the leading hash digits cut every
class into equal small buckets; bucket sizes tell which bucket holds each cut, and
only that bucket's rows are ranked. What comes out is two (hash, id) limits per
class, written once, and the split of a row is a comparison with them: the wide
rows are never shuffled, and a table may be split anew for every reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from classgauge.session import work_path, written
from classgauge.sources.tables import spread

HASH_DIGITS = 4


def row_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _apportion(df: DataFrame, size: str, total: str, draws: str, out: str) -> DataFrame:
    """Share ``draws`` among classes by largest remainder, lowest label on ties.

    The products are exact decimals, so a tie is a tie on every engine.
    """
    product = F.col(size).cast("decimal(19,0)") * F.col(draws).cast("decimal(19,0)")
    df = df.withColumn("_rem", product % F.col(total))
    df = df.withColumn("_floor", ((product - F.col("_rem")) / F.col(total)).cast("long"))
    classes = W.partitionBy(F.lit(0))
    df = df.withColumn("_left", F.col(draws) - F.sum("_floor").over(classes))
    df = df.withColumn("_rank", F.row_number().over(classes.orderBy(F.desc("_rem"), "label")))
    df = df.withColumn(out, F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long"))
    return df.drop("_rem", "_floor", "_left", "_rank")


def split_quotas(sizes: DataFrame, test_fraction: float = 0.2, val_fraction: float = 0.125) -> DataFrame:
    """Rows per class and slice, from (label, n): one row per class.

    Evaluating it fails where a class has fewer than two rows or a slice fewer
    rows than there are classes.
    """
    classes = W.partitionBy(F.lit(0))
    q = sizes.select("label", F.col("n").alias("n_rows"))
    q = q.withColumn("_n", F.sum("n_rows").over(classes)).withColumn("_c", F.count(F.lit(1)).over(classes))
    q = q.withColumn("_test", F.ceil(F.lit(test_fraction) * F.col("_n"))).withColumn("_rest", F.col("_n") - F.col("_test"))
    q = _apportion(q, "n_rows", "_n", "_rest", "_kept")
    q = q.withColumn("_val", F.ceil(F.lit(val_fraction) * F.col("_rest"))).withColumn("_train", F.col("_rest") - F.col("_val"))
    q = _apportion(q, "_kept", "_rest", "_train", "n_train")
    q = q.withColumn("n_val", F.col("_kept") - F.col("n_train")).withColumn("n_test", F.col("n_rows") - F.col("_kept"))
    too_small = F.least("n_rows", "_kept") < 2
    too_few = F.least("_test", "_val", "_train") < F.col("_c")
    guard = F.when(too_small, F.raise_error(F.lit("a class has fewer than 2 rows to split"))).when(
        too_few, F.raise_error(F.lit("a slice has fewer rows than there are classes"))
    )
    return q.withColumn("n_test", F.coalesce(guard.cast("long"), F.col("n_test"))).select(
        "label", "n_rows", "n_train", "n_val", "n_test"
    )


def split_limits(df: DataFrame, key: str, label: str, seed: int = 42, **fractions: float) -> DataFrame:
    """Per class the last (hash, key) of the test and of the validation slice."""
    rows = df.select(F.col(label).alias("label"), F.col(key).alias("key"))
    rows = rows.withColumn("hash", row_hash(F.col("key"), seed))
    rows = rows.withColumn("bucket", F.substring("hash", 1, HASH_DIGITS))
    buckets = written(rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    quotas = split_quotas(buckets.groupBy("label").agg(F.sum("n").alias("n")), **fractions)

    # At most 16**HASH_DIGITS rows per class.
    upto = W.partitionBy("label").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = buckets.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    cuts = F.explode(
        F.array(
            F.struct(F.lit("test").alias("slice"), F.col("n_test").alias("last")),
            F.struct(F.lit("val").alias("slice"), (F.col("n_test") + F.col("n_val")).alias("last")),
        )
    )
    cuts = quotas.select("label", cuts.alias("cut")).select("label", "cut.*")
    # Two buckets per class: small enough to broadcast whatever the input is.
    edges = (
        ranked.join(F.broadcast(cuts), "label")
        .filter((F.col("before") < F.col("last")) & (F.col("last") <= F.col("before") + F.col("n")))
        .select("label", "bucket", "slice", (F.col("last") - F.col("before")).alias("nth"))
    )
    in_bucket = W.partitionBy("label", "slice").orderBy("hash", "key")
    limits = (
        rows.join(F.broadcast(edges), ["label", "bucket"])
        .withColumn("rank", F.row_number().over(in_bucket))
        .filter(F.col("rank") == F.col("nth"))
        .groupBy("label")
        .pivot("slice", ["test", "val"])
        .agg(F.max(F.struct("hash", "key")))
        .select("label", F.col("test").alias("_test_end"), F.col("val").alias("_val_end"))
    )
    return written(limits, "limits")


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42, **fractions: float) -> DataFrame:
    """Add ``split`` (train, val, test: 70/10/20 by default). Rows without a label are left out."""
    df = df.filter(F.col(label).isNotNull())
    limits = split_limits(df, key, label, seed, **fractions).withColumnRenamed("label", "_label")
    place = F.struct(row_hash(F.col(key), seed).alias("hash"), F.col(key).alias("key"))
    return (
        df.join(F.broadcast(limits), F.col(label) == F.col("_label"), "left")
        .withColumn(
            "split",
            F.when(place <= F.col("_test_end"), "test").when(place <= F.col("_val_end"), "val").otherwise("train"),
        )
        .drop("_label", "_test_end", "_val_end")
    )


def stored_split(df: DataFrame, key: str, label: str, seed: int = 42, **fractions: float) -> DataFrame:
    """``stratified_split`` written once, a folder for each slice.

    What reads a slice reads its files alone and hashes, joins and compares nothing again. The files of a small
    input are spread by key, so that its readers use all cores.
    """
    rows = stratified_split(df, key, label, seed, **fractions)
    path = work_path(df.sparkSession, "split")
    spread(rows, key).write.partitionBy("split").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def fit_rows(df: DataFrame) -> DataFrame:
    """Train and validation rows together, for the final fit."""
    return df.filter(F.col("split") != "test")
