"""Operator 2: balanced label propagation: linked documents drift to their neighbours' shards under equal quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from classgauge.session import written

BUCKETS, PARTS = 256, 32


def _spread(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with ``rank`` 0, 1, .. in each group, bucket by bucket of a hash of ``order``.

    A bucket is dealt on by a hash of the row, so copies of one text share no task. Parts are
    numbered apart, and their sizes (BUCKETS * PARTS rows a group) give where each starts.
    """
    part = ["bucket_", "part_"]
    rows = rows.withColumns({"bucket_": _spread(*order), "part_": F.pmod(F.xxhash64("row_"), F.lit(PARTS)).cast("int")})
    sizes = rows.groupBy(*group, *part).agg(F.count("*").alias("n_"))
    start = F.sum("n_").over(Window.partitionBy(*group).orderBy(*part)) - F.col("n_")
    starts = sizes.select(*group, *part, start.alias("start_"))
    inside = F.row_number().over(Window.partitionBy(*group, *part).orderBy(*order, "row_")) - 1
    ranked = rows.withColumn("inside_", inside).join(starts, [*group, *part])
    return ranked.withColumn("rank", (F.col("start_") + F.col("inside_")).cast("long")).drop(*part, "inside_", "start_")


def propagated(groups: DataFrame, links: DataFrame, shards: int, rounds: int) -> DataFrame:
    """Rows (node, size, shard): nodes moved towards the shards where most of what they share is.

    ``groups`` has (node, size); ``links`` has (node, via): nodes with one ``via`` are neighbours. Each round
    counts every ``via``'s nodes by shard (one row a ``via``), lets each node choose the shard with the most
    neighbours, and of those who would go from a to b and from b to a lets equally many
    rows go, the largest gains first: exchange quotas, so shard sizes keep as they are up to one group.
    Counts are added up within tasks first, so a ``via`` that a third of all nodes share is
    a few rows; no pairs of nodes are made. Every round is written to the shared folder.
    """
    held = written(groups.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "shards")
    for turn in range(rounds):
        counts = [F.sum((F.col("shard") == s).cast("double")).alias(f"n{s}") for s in range(shards)]
        around = links.join(held, "node").groupBy("via").agg(F.count("*").alias("n"), *counts)
        pulls = links.join(around, "via").groupBy("node").agg(*[F.sum(F.col(f"n{s}") / F.col("n")).alias(f"p{s}") for s in range(shards)])
        pulls = pulls.select("node", F.array(*[f"p{s}" for s in range(shards)]).alias("pulls"))
        most = F.array_max("pulls")
        wish = held.join(pulls, "node").select("node", "size", "shard", (F.array_position("pulls", most) - 1).cast("int").alias("to"), (most - F.col("pulls")[F.col("shard")]).alias("gain"))
        # half of the nodes may move in a round, so that two linked nodes don't just change places
        wish = wish.where((F.col("to") != F.col("shard")) & (F.col("gain") > 1e-9) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0))
        wish = wish.withColumn("step", F.greatest(F.lit(-64), F.least(F.lit(64), F.floor(-4 * F.log2("gain")))).cast("int"))
        wish = written(wish.withColumn("bucket", _spread("node")), "wishes")
        sizes = wish.groupBy("shard", "to", "step", "bucket").agg(F.sum("size").alias("n"))
        order = Window.partitionBy("shard", "to").orderBy("step", "bucket")
        sizes = sizes.withColumn("upto", F.sum("n").over(order))
        flows = wish.groupBy("shard", "to").agg(F.sum("size").alias("flow"))
        back = flows.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("flow").alias("back"))
        quota = flows.join(back, ["shard", "to"]).select("shard", "to", F.least("flow", "back").alias("quota"))
        passed = sizes.join(quota, ["shard", "to"]).where("upto <= quota").select("shard", "to", "step", "bucket")
        moves = wish.join(passed, ["shard", "to", "step", "bucket"], "left_semi").select("node", F.col("to").alias("moved"))
        held = written(held.join(moves, "node", "left").select("node", "size", F.coalesce("moved", "shard").alias("shard")), "shards")
    return held


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int = 4, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard): all documents in shards of equal counts.

    One row per input row. ``law`` is ``rows``: shard sizes in rows are at most one apart. Documents with equal texts are one group;
    groups that share a line of ``least_chars`` characters or more are linked. Groups are placed by balanced label propagation,
    then shards that are too full hand their surplus to those that lack rows; which rows go is by
    hash of the text, so only the groups of one of 256 hash buckets are divided (a group larger than a shard has to be).
    ``slot`` numbers a shard's rows from 0. ``size`` is the text's bytes and 1 (null: 1), ``text_crc32`` is of the
    UTF-8 bytes (null as empty), ``grown_shard`` is null under this law. Ids may be null or repeat; with fewer rows
    than shards some shards are empty; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text)).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("node"),
    )
    rows = written(rows, "rows")
    groups = rows.groupBy("node").agg(F.count("*").alias("size"))
    lines = docs.select(F.xxhash64(text, F.octet_length(text)).alias("node"), F.explode(F.split(text, "\n")).alias("line")).where(F.length("line") >= least_chars)
    lines = lines.select("node", F.xxhash64("line").alias("via")).distinct()
    shared = lines.groupBy("via").agg(F.count("*").alias("n")).where("n > 1").select("via")
    links = written(lines.join(shared, "via", "left_semi"), "links")
    placed = propagated(groups, links, shards, rounds)

    found = rows.join(placed.select("node", "shard"), "node").withColumn("row_", F.struct("doc_id", "bytes"))
    ranked = written(_ranked(found, ["shard"], ["node"]), "ranked")
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    sizes = every.join(ranked.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))
    plan = _repairs({r["shard"]: r["n"] for r in sizes.collect()})  # one number per shard
    keep, moves = plan
    quota = F.create_map(*[F.lit(x) for s, n in keep.items() for x in (s, n)])
    ranked = ranked.withColumn("over", F.col("rank") - quota[F.col("shard")])
    to, slot = F.col("shard"), F.col("rank")
    for source, first, count, target, at in moves:
        hit = (F.col("shard") == source) & (F.col("over") >= first) & (F.col("over") < first + count)
        slot = F.when(hit, F.col("over") - first + at).otherwise(slot)
        to = F.when(hit, F.lit(target)).otherwise(to)
    return ranked.select(
        "doc_id", (F.col("bytes") + 1).cast("long").alias("size"), "text_crc32", F.lit("rows").alias("law"),
        to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _repairs(sizes: dict[int, int]) -> tuple[dict[int, int], list[tuple[int, int, int, int, int]]]:
    """How many rows each shard keeps, and moves (from, first surplus row, rows, to, first slot there) that even the shards."""
    total, n = sum(sizes.values()), len(sizes)
    fullest = sorted(sizes, key=lambda s: (-sizes[s], s))
    target = {s: total // n + (i < total % n) for i, s in enumerate(fullest)}
    keep = {s: min(sizes[s], target[s]) for s in sizes}
    moves, lacking = [], [[s, sizes[s], target[s] - sizes[s]] for s in sorted(sizes) if sizes[s] < target[s]]
    for s in sorted(sizes):
        first, left = 0, sizes[s] - keep[s]
        while left:
            to = lacking[0]
            n_rows = min(left, to[2])
            moves.append((s, first, n_rows, to[0], to[1]))
            first, left, to[1], to[2] = first + n_rows, left - n_rows, to[1] + n_rows, to[2] - n_rows
            if not to[2]:
                lacking.pop(0)
    return keep, moves
