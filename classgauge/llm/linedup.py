"""Operator 10: repeated line runs by prefix doubling over line ids; later copies are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classgauge.llm.sizing import fresh, join_counted
from classgauge.session import forget, written

BLANK = "^[\\x20\\x09-\\x0D]*$"
GAP = "[\\x20\\x09-\\x0D]+"


def _name_of(id_: Column, text: Column) -> Column:
    """Names a document by id and text: rows equal in both are one document."""
    return F.xxhash64(F.coalesce(id_.cast("string"), F.lit("null")), text.cast("string"))


def _name(first: Column) -> Column:
    """A place in 64 bits. A window is told by the names of its two intervals, its length and its first line's hash."""
    return F.xxhash64(first)


def line_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, key, place, line_a, line_b, words): the lines of each document that aren't blank."""
    lines = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), _name_of(F.col(id_col), F.col(text_col)).alias("key"),
        F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("place", "line"),
    ).where(~F.col("line").rlike(BLANK))
    inner = F.regexp_replace("line", f"^{GAP}|{GAP}$", "")
    return lines.select(
        "doc_id", "key", "place", F.xxhash64("line").alias("line_a"), F.xxhash64(F.lit(1), "line").alias("line_b"),
        F.size(F.split(inner, GAP)).alias("words"),
    )


def repeated_lines(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, key, place): lines inside a later copy of a repeated run of ``min_words`` words or more.

    Suffixes of the line sequences are ranked by prefix doubling. A suffix's rank at depth 2^k is the
    first place in the corpus (by doc_id, null first, then text, then line) where its first 2^k lines stand; it
    comes from the pair of ranks at half the depth, so equal ranks are an interval of suffixes with
    a common prefix of 2^k lines. Only suffixes that share a rank go on. A run of n lines is the overlap
    of two intervals of depth 2^k <= n, and is a later copy where its first place is
    another. The shortest windows with enough words from each line on, and up to each line, cover every
    repeated run and have at most ``min_words`` lines, which bounds the depth.
    """
    lines = line_sequences(docs, id_col, text_col).distinct()
    own = Window.partitionBy("doc_id", "key").orderBy("place")
    lines = lines.withColumns({"i": F.row_number().over(own), "upto": F.sum("words").over(own)})
    at = F.struct("doc_id", "key", "i")
    seen = lines.groupBy("line_a", "line_b").agg(_name(F.min(at)).alias("rank_0"), F.count("*").alias("n_"))
    seen = written(seen, "lines")
    total = seen.agg(F.coalesce(F.sum("n_"), F.lit(0))).head()[0]
    spot = ["doc_id", "key", "i"]
    active = join_counted(lines, seen.where("n_ > 1"), ["line_a", "line_b"], total, spot).where("rank_0 IS NOT NULL")
    active = written(active.select("doc_id", "key", "i", "place", "words", "upto", "line_a", "rank_0"), "ranks")
    total = active.count()

    steps = min_words.bit_length() - 1  # 2 ** steps <= min_words
    own = Window.partitionBy("doc_id", "key").orderBy("i")
    for k in range(steps):
        half = own.rangeBetween(1 << k, 1 << k)
        pairs = active.withColumn("next_", F.first(f"rank_{k}").over(half))
        both = pairs.where(f"rank_{k} IS NOT NULL AND next_ IS NOT NULL").groupBy(f"rank_{k}", "next_")
        both = both.agg(_name(F.min(at)).alias(f"rank_{k + 1}"), F.count("*").alias("n_")).where("n_ > 1")
        before, active = active, written(join_counted(pairs, both, [f"rank_{k}", "next_"], total, spot).drop("next_"), "ranks")
        forget(before)

    here = F.struct("i", "upto", (F.col("upto") - F.col("words")).alias("before"))
    ahead = F.collect_list(here).over(own.rangeBetween(0, min_words - 1))
    behind = F.collect_list(here).over(own.rangeBetween(1 - min_words, 0))
    reached = active.select(
        "doc_id", "key", "i", (F.col("upto") - F.col("words")).alias("before"), "upto", ahead.alias("ahead"), behind.alias("behind")
    )
    ends = F.try_element_at(F.filter("ahead", lambda x: x["upto"] - F.col("before") >= min_words), F.lit(1))["i"]
    starts = F.try_element_at(F.filter("behind", lambda x: F.col("upto") - x["before"] >= min_words), F.lit(-1))["i"]
    windows = reached.select("doc_id", "key", F.explode(F.array(F.struct(F.col("i").alias("a"), ends.alias("b")), F.struct(starts.alias("a"), F.col("i").alias("b")))).alias("w"))
    windows = windows.select("doc_id", "key", "w.a", "w.b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    depth = F.floor(F.log2(F.col("b") - F.col("a") + 1)).cast("int")
    windows = windows.withColumn("k", depth).withColumn("c", (F.col("b") - F.expr("shiftleft(1, k)") + 1).cast("int"))
    ranks = active.select("doc_id", "key", "i", "line_a", F.array(*[f"rank_{k}" for k in range(steps + 1)]).alias("ranks"))

    def ranked(windows: DataFrame, spot: str, name: str, *more: str) -> DataFrame:
        side = ranks.select(F.col("doc_id").alias("d_"), F.col("key").alias("k_"), F.col("i").alias(spot), "ranks", *more)
        met = windows.join(side, [windows["doc_id"].eqNullSafe(side["d_"]), windows["key"] == side["k_"], windows[spot] == side[spot]])
        return met.select(*[windows[c] for c in windows.columns], F.col("ranks")[F.col("k")].alias(name), *more).where(F.col(name).isNotNull())

    runs = ranked(ranked(windows, "a", "head", "line_a"), "c", "tail").withColumn("n", F.col("b") - F.col("a"))
    start = F.struct("doc_id", "key", F.col("a").alias("i"))
    same = ["head", "tail", "line_a", "n"]
    runs = written(runs.select("doc_id", "key", "a", "b", *same), "windows")
    first = runs.groupBy(*same).agg(F.min(start).alias("first"), F.count("*").alias("n_")).where("n_ > 1")
    later = join_counted(runs, first, same, runs.count(), ["doc_id", "key", "a"]).where(F.col("first").isNotNull() & (start != F.col("first")))
    gone = later.select("doc_id", "key", F.explode(F.sequence("a", "b")).alias("i")).distinct()
    return gone.alias("g").join(
        active.alias("x"), [F.col("g.doc_id").eqNullSafe(F.col("x.doc_id")), F.col("g.key") == F.col("x.key"), F.col("g.i") == F.col("x.i")]
    ).select("g.doc_id", "g.key", "x.place")


def dedup_lines(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later copies of repeated line runs taken out of the text, and how many lines went.

    All columns and rows stay; ``n_deleted_lines`` (long) is added as the last, with underscores while the input has that name. Other
    names never clash, as the input's columns travel in one struct. Runs need ``min_words`` words and
    may repeat within a text or between texts; the first copy by (id, null first, text) stays, and
    blank lines are skipped in comparing and left where they are. Rows with equal id and text
    count as one document and are treated alike. A null text stays null; an empty table gives no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    gone = repeated_lines(own, min_words)
    order = Window.partitionBy("doc_id", "key").orderBy("place")
    gone = gone.withColumn("island", F.col("place") - F.row_number().over(order))
    gone = gone.groupBy("doc_id", "key", "island").agg(F.min("place").alias("s"), F.max("place").alias("e"))
    cuts = gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField(text_col)
    rows = rows.withColumns({"at": F.col("row").getField(id_col).cast("long"), "name": _name_of(F.col("row").getField(id_col), text)})
    met = rows.join(cuts, [F.col("at").eqNullSafe(F.col("doc_id")), F.col("name") == F.col("key")], "left")
    met = met.withColumn("lines", F.when(F.col("cuts").isNotNull(), F.split(text.cast("string"), "\n")))
    opens = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["e"] + 1))
    closes = F.concat(F.transform("cuts", lambda c: c["s"]), F.array(F.size("lines")))
    rest = F.array_join(F.flatten(F.zip_with(opens, closes, lambda a, b: F.slice("lines", a + 1, b - a))), "\n")
    deleted = F.coalesce(F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + c["e"] - c["s"] + 1), F.lit(0).cast("long"))
    left = F.when(F.col("cuts").isNull(), text).otherwise(rest)
    columns = [(left if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return met.select(*columns, deleted.alias(fresh("n_deleted_lines", docs.columns)))
