"""Bootstrap interval of macro-F1."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classgauge.functions.vectors import let
from classgauge.operators.metrics import confusion_cells, metric_row

INVERSION_MEAN = 200.0  # up to this mean a count is found by adding up the law; e^-277 is the least first term


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1 that the parts alone decide: the first 52 bits of the MD5 of their text."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10)
    return bits.cast("double") / float(1 << 52)


def _by_inversion(n: Column, p: Column, u: Column) -> Column:
    """The least k whose binomial distribution function is at least u, for p <= 1/2 and a mean of at most INVERSION_MEAN."""
    first = F.exp(n * F.log(1.0 - p))
    start = F.struct(first.alias("mass"), first.alias("upto"), F.lit(0).cast("long").alias("k"))

    def step(s: Column, k: Column) -> Column:
        more = s["mass"] * ((n - k) / (k + 1.0)) * (p / (1.0 - p))
        further = let(more, lambda m: F.struct(m.alias("mass"), (s["upto"] + m).alias("upto"), (s["k"] + 1).alias("k")))
        return F.when((s["upto"] < u) & (k < n), further).otherwise(s)

    last = F.ceil(n * p + 12.0 * F.sqrt(n * p) + 40.0).cast("long")  # what lies beyond is less than the uniform's last bit
    return F.aggregate(F.sequence(F.lit(0).cast("long"), last), start, step, lambda s: s["k"])


def _by_normal(n: Column, p: Column, u: Column, v: Column) -> Column:
    """A normal draw (Box and Muller) bent to the binomial's skewness and kurtosis (Cornish and Fisher), for large means."""
    z = F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)
    spread = F.sqrt(n * p * (1.0 - p))

    def count(z: Column) -> Column:
        skew, tails = (1.0 - 2.0 * p) / spread, (1.0 - 6.0 * p * (1.0 - p)) / (spread * spread)
        bent = z + (z * z - 1.0) * skew / 6.0 + (z * z * z - 3.0 * z) * tails / 24.0 - (2.0 * z * z * z - 5.0 * z) * skew * skew / 36.0
        return F.least(F.greatest(F.floor(n * p + spread * bent + 0.5), F.lit(0)), n)

    return let(z, count).cast("long")


def binomial(n: Column, p: Column, u: Column, v: Column) -> Column:
    """How many of n trials with chance p succeed, as two uniform numbers decide; the rarer outcome is the one that is counted."""

    def drawn(q: Column) -> Column:
        return F.when(q <= 0.0, F.lit(0).cast("long")).when(n * q <= INVERSION_MEAN, _by_inversion(n, q, u)).otherwise(_by_normal(n, q, u, v))

    rare = let(F.when(p > 0.5, 1.0 - p).otherwise(p), drawn)
    return F.when(p > 0.5, n - rare).otherwise(rare)


def resampled_cells(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, y, pred, n): the confusion cells of resamples, cells that a resample misses left out.

    N draws with replacement fill the cells by the multinomial law: cell by cell, in order of (y, pred), a
    binomial share of the draws that are left. A resample costs its C^2 cells, not N rows. The draws come from MD5 of seed, resample and
    cell, so they depend neither on partitions nor on the engine.
    """
    table = confusion_cells(cells).agg(F.array_sort(F.collect_list(F.struct("y", "pred", "n"))).alias("cells"))  # one row of at most C^2 cells
    rows = cells.sparkSession.range(replicates).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(table))
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    empty = F.array().cast("array<struct<y:int,pred:int,n:bigint>>")
    start = F.struct(total.alias("left"), total.alias("mass"), empty.alias("out"))

    def step(s: Column, c: Column) -> Column:
        at = (F.lit(seed), F.col("replicate"), c["y"], c["pred"])
        drawn = binomial(s["left"], c["n"] / s["mass"], uniform(*at), uniform(*at, F.lit("v")))

        def after(k: Column) -> Column:
            cell = F.struct(c["y"].cast("int").alias("y"), c["pred"].cast("int").alias("pred"), k.alias("n"))
            return F.struct((s["left"] - k).alias("left"), (s["mass"] - c["n"]).alias("mass"), F.concat(s["out"], F.array(cell)).alias("out"))

        return let(drawn, after)

    out = rows.select("replicate", F.explode(F.aggregate("cells", start, step, lambda s: s["out"])).alias("c"))
    return out.select("replicate", "c.*").filter("n > 0")


def bootstrap_macro_f1(cells: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(f1_macro_ci_lo, f1_macro_ci_hi): the 2.5th and 97.5th percentile of the resamples' macro-F1, each over the classes it has."""
    bounds = F.percentile("f1_macro", F.array(F.lit(0.025), F.lit(0.975)))
    f1 = metric_row(resampled_cells(cells, replicates, seed), by=("replicate",))
    return f1.agg(bounds.alias("q")).select(
        F.get("q", F.lit(0)).alias("f1_macro_ci_lo"), F.get("q", F.lit(1)).alias("f1_macro_ci_hi")
    )
