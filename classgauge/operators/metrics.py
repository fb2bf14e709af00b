"""Classification metrics from one small table of cells.

A scored table is (id, y, pred, probs). ``metric_cells`` reads it once and keeps
one row per (true class, predicted class, confidence bin). Every metric but the
ROC family is a sum over these cells, whose number does not grow with the data.

Sums of measured numbers are exact: each number is taken to EXACT, and decimals add up to the same whatever
their order, so metrics don't change by a bit with the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The machine epsilon that bounds a probability away from 0 and 1.
EPS = 2.220446049250313e-16
N_BINS = 15
EXACT = "decimal(22,18)"  # of numbers up to 36, a log loss's bound; sums have ten digits more


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast(EXACT))


def _in_order(value: Column, key: str) -> Column:
    """The sum of a few doubles, one for each class, in the classes' order."""
    terms = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["v"])


def bin_edges(n_bins: int = N_BINS) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def confidence_bin(conf: Column, n_bins: int = N_BINS) -> Column:
    """Bin index; a bin holds its upper edge, the first one also 0."""
    above = [(conf > F.lit(edge)).cast("int") for edge in bin_edges(n_bins)[1:-1]]
    return sum(above[1:], above[0]) if above else F.lit(0)


def log_loss_of(probs: Column, y: Column) -> Column:
    return -F.log(F.greatest(F.least(F.get(probs, y), F.lit(1.0 - EPS)), F.lit(EPS)))


def brier_of(probs: Column, y: Column) -> Column:
    """Squared distance to the one-hot truth: sum p^2 - 2 p_y + 1."""
    squares = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p * p)
    return squares - 2 * F.get(probs, y) + 1


def metric_cells(
    scored: DataFrame, n_bins: int = N_BINS, digits: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """(by.., y, pred, bin, n, conf, loss, brier): the only pass over the scored rows.

    ``digits`` rounds the confidence before it is put in a bin (None: as it is).
    """
    conf = F.array_max("probs")
    rows = scored.select(
        *by,
        "y",
        "pred",
        (conf if digits is None else F.round(conf, digits)).alias("conf"),
        log_loss_of(F.col("probs"), F.col("y")).alias("loss"),
        brier_of(F.col("probs"), F.col("y")).alias("brier"),
    )
    return rows.groupBy(*by, "y", "pred", confidence_bin(F.col("conf"), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        exact_sum(F.col("conf")).alias("conf"),
        exact_sum(F.col("loss")).alias("loss"),
        exact_sum(F.col("brier")).alias("brier"),
    )


def confusion_cells(scored: DataFrame) -> DataFrame:
    """(y, pred, n) for the pairs that occur. Also takes ``metric_cells``."""
    n = F.sum("n") if "n" in scored.columns else F.count(F.lit(1))
    return scored.groupBy("y", "pred").agg(n.alias("n"))


def _label_rows(like: DataFrame, labels: list[int], columns: str) -> DataFrame:
    return like.sparkSession.createDataFrame([(int(c),) for c in labels], columns)


def confusion_matrix(cells: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """Long matrix (y, pred, n). With ``labels``, exactly these, zero cells kept."""
    cells = confusion_cells(cells)
    if labels is None:
        return cells
    grid = cells.sparkSession.createDataFrame([(int(a), int(b)) for a in labels for b in labels], "y int, pred int")
    return grid.join(cells, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_wide(cells: DataFrame, labels: list[int]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    wide = confusion_matrix(cells, labels).groupBy("y").pivot("pred", labels).agg(F.sum("n"))
    return wide.select("y", *[F.col(str(c)).alias(f"pred_{c}") for c in labels])


def class_sums(cells: DataFrame, labels: list[int] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., class_id, support, predicted, tp, loss, brier) from ``metric_cells``.

    Every cell counts once for its true and once for its predicted class; losses
    go with the true one. With ``labels``, exactly these classes, also empty ones.
    """
    has_loss = "loss" in cells.columns
    zero, none = F.lit(0).cast("long"), F.lit(0).cast(EXACT)
    loss = [F.col(c).alias(c) if has_loss else none.alias(c) for c in ("loss", "brier")]
    tp = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(zero)
    truth = F.struct(F.col("y").alias("class_id"), F.col("n").alias("support"), zero.alias("predicted"), tp.alias("tp"), *loss)
    guess = F.struct(
        F.col("pred").alias("class_id"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"),
        none.alias("loss"), none.alias("brier"),
    )
    sides = cells.select(*by, F.explode(F.array(truth, guess)).alias("s")).select(*by, "s.*")
    if labels is not None:
        wanted = [int(c) for c in labels]
        empty = _label_rows(cells, wanted, "class_id int").select(
            "class_id", zero.alias("support"), zero.alias("predicted"), zero.alias("tp"), none.alias("loss"), none.alias("brier")
        )
        sides = sides.filter(F.col("class_id").isin(wanted)).unionByName(empty)
    sums = ("support", "predicted", "tp", "loss", "brier")
    return sides.groupBy(*by, "class_id").agg(*[F.sum(c).alias(c) for c in sums])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _with_rates(sums: DataFrame) -> DataFrame:
    return (
        sums.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def per_class(cells: DataFrame, labels: list[int] | None = None) -> DataFrame:
    """(class_id, precision, recall, f1, support); 0 where a ratio has no base.

    Without ``labels``: the classes that occur as truth or prediction.
    """
    return _with_rates(class_sums(cells, labels)).select("class_id", "precision", "recall", "f1", "support")


def _macro(name: str) -> Column:
    return (_in_order(F.col(name), "class_id") / F.count(name)).alias(f"{name}_macro")


def _weighted(name: str) -> Column:
    return (_in_order(F.col(name) * F.col("support"), "class_id") / F.sum("support")).alias(f"{name}_weighted")


RATES = ("precision", "recall", "f1")


def macro_scores(cells: DataFrame) -> DataFrame:
    """Plain means over the classes that occur as truth or prediction."""
    return _with_rates(class_sums(cells)).agg(*map(_macro, RATES))


def weighted_scores(cells: DataFrame) -> DataFrame:
    """Means over classes weighted by support."""
    return _with_rates(class_sums(cells)).agg(*map(_weighted, RATES))


def accuracy(cells: DataFrame) -> DataFrame:
    hits = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    return cells.agg((hits / F.sum("n")).alias("accuracy"))


def log_loss(cells: DataFrame) -> DataFrame:
    return cells.agg((F.sum("loss").cast("double") / F.sum("n")).alias("log_loss"))


def brier_score(cells: DataFrame) -> DataFrame:
    return cells.agg((F.sum("brier").cast("double") / F.sum("n")).alias("brier_score"))


def reliability(cells: DataFrame, n_bins: int = N_BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """Non-empty bins: (by.., bin, center, confidence, accuracy, n)."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    hits = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    bins = cells.groupBy(*by, "bin").agg(
        (F.sum("conf").cast("double") / F.sum("n")).alias("confidence"),
        (hits / F.sum("n")).alias("accuracy"),
        F.sum("n").alias("n"),
    )
    center = (F.get(edges, F.col("bin")) + F.get(edges, F.col("bin") + 1)) / 2
    return bins.select(*by, "bin", center.alias("center"), "confidence", "accuracy", "n")


def calibration_error(cells: DataFrame, n_bins: int = N_BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error: gap per bin, weighted by the bin's share."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return reliability(cells, n_bins, by).groupBy(*by).agg((_in_order(gap, "bin") / F.sum("n")).alias(f"ece_{n_bins}bins"))


def metric_row(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, weighted and macro rates, log loss and Brier score: one row (per ``by``)."""
    total = F.sum("support")
    return _with_rates(class_sums(cells, by=by)).groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"),
        *map(_weighted, RATES),
        *map(_macro, RATES),
        (F.sum("loss").cast("double") / total).alias("log_loss"),
        (F.sum("brier").cast("double") / total).alias("brier_score"),
    )
