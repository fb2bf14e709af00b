"""How many parts a table is dealt into."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.session import input_bytes

UNKNOWN = 1 << 56  # what Spark says of rows that it can't size, such as those made in the driver


def block_names() -> Iterator[str]:
    """Names for the blocks a task makes: its partition and a count.

    A task that runs again after a lost executor reads the same split and gives its
    blocks the same names, so they fit what other tasks have already taken. Tables that come out of a shuffle
    should be written first, as a second read may have another order.
    """
    part = TaskContext.get().partitionId()
    n = 0
    while True:
        yield f"{part}-{n}"
        n += 1


def parts_for(df: DataFrame, part_bytes: int, least: int) -> int:
    """One part for each ``part_bytes`` of the files that ``df`` reads; with sizes unknown, the session's number of shuffle partitions."""
    size = input_bytes(df)
    if size >= UNKNOWN:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / part_bytes))


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores added while it is one of ``taken``; case does not tell names apart."""
    held = {x.lower() for x in taken}
    while name.lower() in held:
        name += "_"
    return name


HOT_SHARE = 1000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int, spread: list[str]) -> DataFrame:
    """The rows with the other columns of ``counted``, null where it has none; no task gets the rows of a hot key.

    ``counted`` has each key once, with how many of the ``total`` rows have it in ``n_``. Keys of more than one row in
    HOT_SHARE, of which there are fewer than HOT_SHARE, are broadcast, and their rows are dealt on by ``spread`` instead of
    the key. ``on`` are at least two columns, the first a long.
    """
    values = [c for c in counted.columns if c not in on and c != "n_"]
    is_hot = F.col("n_") > total / HOT_SHARE
    hot = counted.where(is_hot).select(*on, F.struct(*values).alias("hot_"))
    cold = counted.where(~is_hot).select(*[F.col(c).alias(f"{c}_on") for c in on], F.struct(*values).alias("cold_"))
    marked = rows.join(F.broadcast(hot), on, "left")
    away = F.col("hot_").isNotNull()
    for c in on:  # a null key has no partner, and all of them would meet in one task
        away = away | F.col(c).isNull()
    keys = [F.when(away, F.xxhash64(*spread)).otherwise(F.col(on[0])), F.when(away, None).otherwise(F.col(on[1])), *map(F.col, on[2:])]
    marked = marked.withColumns({f"{c}_at": k for c, k in zip(on, keys, strict=True)})
    met = marked.join(cold, [F.col(f"{c}_at") == F.col(f"{c}_on") for c in on], "left")
    return met.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col("hot_")[v], F.col("cold_")[v]).alias(v) for v in values])
