"""Operator 11: documents drawn from their sources until each source has its share of the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classgauge.llm.sizing import fresh
from classgauge.session import input_bytes, written

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20
HOT_SHARE = 200  # a source with more than one row in so many is hot, so there are fewer than so many of them


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, text: Column, seed: int) -> Column:
    """A number from 0 to below 1 out of the row's id and text alone: the first 32 bits of their MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _ordered(sources: DataFrame) -> DataFrame:
    """The table with ``place_``: 0, 1, .. by source, null last. Ranges of sources are numbered apart, from the ranges' sizes."""
    spots = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("spot_", F.monotonically_increasing_id()), "sources")
    part, inside = F.shiftright("spot_", 33).alias("part_"), F.col("spot_").bitwiseAND((1 << 33) - 1)
    sizes = spots.groupBy(part).agg(F.count("*").alias("n_"))
    starts = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_"))  # one row a range
    numbered = spots.withColumns({"part_": part, "inside_": inside}).join(starts, "part_")
    return numbered.withColumn("place_", F.col("start_") + F.col("inside_")).drop("part_", "inside_", "spot_", "start_")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Rows (source, n_docs, source_size, weight, target, rate), from rows (source, size).

    Sources in code point order, null last, have the weights in turn and share ``share`` times all
    sizes by them. A target stops at ``most`` times its source's size; what is over is shared again by
    weight among the rest, until none is above. Each round of that adds up three numbers. ``rate`` is
    the target over the size, 0 for a source without words.
    """
    if not weights or min(weights) <= 0 or not 0 <= share <= most:
        raise ValueError("weights must be above 0, and share from 0 to most")
    table = _ordered(sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")))
    choices = F.array(*[F.lit(float(w)) for w in weights])
    table = written(table.withColumn("weight", F.get(choices, F.pmod("place_", F.lit(len(weights))).cast("int"))).drop("place_"), "weights")
    cap = F.lit(float(most)) * F.col("source_size")
    wanted = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        row = table.agg(
            F.sum(over.cast("long")).alias("n"), F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("left")
        ).first()
        if row["n"] is None or row["n"] == n_capped or not row["left"]:
            break
        n_capped, level = row["n"], (wanted - (row["capped"] or 0.0)) / row["left"]
    target = F.least(cap, F.lit(level) * F.col("weight"))
    return table.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _with_targets(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (source_, ..) beside their source's row of ``table``.

    The table is broadcast while its files are small. Past that, only its hot sources are (fewer than
    HOT_SHARE), and the others meet their rows by shuffle, where none has many.
    """
    if input_bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), rows["source_"].eqNullSafe(table["source"])).drop(table["source"])
    bound = (table.agg(F.sum("n_docs")).first()[0] or 0) / HOT_SHARE
    hot = table.where(F.col("n_docs") > bound)
    marked = F.broadcast(hot.select(F.col("source").alias("hot_"), F.lit(True).alias("is_hot_")))
    parted = rows.join(marked, F.col("source_").eqNullSafe(F.col("hot_")), "left").drop("hot_")
    often, seldom = parted.where("is_hot_").drop("is_hot_"), parted.where("is_hot_ IS NULL").drop("is_hot_")
    rest = table.where(F.col("n_docs") <= bound)
    first = often.join(F.broadcast(hot), often["source_"].eqNullSafe(hot["source"])).drop(hot["source"])
    return first.unionByName(seldom.join(rest, seldom["source_"].eqNullSafe(rest["source"])).drop(rest["source"]))


def mixing_plan(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Rows (doc_id, size, source, source_size, target, rate, copies, taken, row), one for each input row.

    ``size`` is the text's words, 0 for null; ``row`` is a struct of all the input's columns, so none can
    clash with another. ``copies`` is the whole part of the source's rate, and one more where the row's
    draw, a hash of ``seed``, id and text, is under the rest; ``taken`` is copies times size. As rates end at
    ``most``, so do copies where it is whole. Rows equal in id and text have one draw, null ids and texts count
    as empty ones; a source without words takes none. A second run gives the same, in whatever order rows come.
    """
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    source, text = columns[source_col].cast("string"), columns[text_col].cast("string")
    sizes = docs.select(source.alias("source"), word_count(text).alias("size"))
    table = source_targets(sizes, weights, share, most).drop("weight")
    rows = docs.select(
        columns[id_col].cast("long").alias("doc_id"), word_count(text).alias("size"), source.alias("source_"),
        draw(columns[id_col], text, seed).alias("draw_"), F.struct(*columns.values()).alias("row"),
    )
    whole = F.floor("rate")
    copies = (whole + (F.col("draw_") < F.col("rate") - whole).cast("long")).alias("copies")
    mixed = _with_targets(rows, table).select("doc_id", "size", F.col("source_").alias("source"), "source_size", "target", "rate", copies, "row")
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, copy_col: str = "copy", **plan) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mixing_plan`` says, with the copy's number from 1.

    The number's column is ``copy_col``, with underscores added while ``docs`` has that name.
    """
    name = fresh(copy_col, docs.columns)
    taken = mixing_plan(docs, **plan).where("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name), "row").select("row.*", name)
