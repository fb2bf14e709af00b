"""Operator 8: exact word-shingle Jaccard join of a corpus with itself, by grouped prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.llm.components import connected_components
from classgauge.llm.sizing import block_names, parts_for
from classgauge.llm.words import LOWER, owners, per_text, runs, span_hashes, text_chunks, window_hashes
from classgauge.session import written

KEY_BITS = 48  # of a shingle's hash; equal ones count as the same shingle
BLOCK_BYTES = 8 << 20
BLOCK_TEXTS = 1 << 16
PART_BYTES = 4 << 20
SIDE_BYTES = 32 << 20  # of the sets on a side of a block

_PACKED = "bucket int, block string, docs binary, keys binary, meta binary, sizes binary"
_NODES = "doc_id long, n_shingles long, sig_a long, sig_b long, fresh long, prefix array<long>, shared binary"


def shingle_sets(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of each text, ascending within the text, and the text of each."""
    data = LOWER[texts.data]
    starts, ends, firsts = texts.edges()
    words = span_hashes(data, starts, ends)
    owner = owners(firsts)
    windows = window_hashes(words, width)
    whole = owner[: len(windows)] == owner[width - 1 :] if len(windows) else np.zeros(0, bool)
    keys, docs = windows[whole], owner[: len(windows)][whole]
    counts = np.diff(firsts)
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        part = words[firsts[d] : firsts[d + 1]]
        keys = np.append(keys, window_hashes(part, len(part)))
        docs = np.append(docs, d)
    keys >>= np.uint64(64 - KEY_BITS)
    both = np.unique(docs.astype(np.uint64) << np.uint64(KEY_BITS) | keys)
    return both & np.uint64((1 << KEY_BITS) - 1), (both >> np.uint64(KEY_BITS)).astype(np.int64)


def _pack(width: int, buckets: int):
    """Tables of (doc_id, text) to postings, dealt by hash range, and a row of sizes per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = block_names()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for texts in text_chunks(batch.column(1), BLOCK_BYTES, BLOCK_TEXTS):
                yield _packed(texts, ids[texts.first : texts.first + len(texts)], width, buckets, next(blocks))

    return run


def _packed(texts, ids, width: int, buckets: int, block: str) -> pa.RecordBatch:
    keys, docs = shingle_sets(texts, width)
    sizes = np.bincount(docs, minlength=len(texts))
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    mixed = (keys * np.uint64(0xD6E8FEB86659FD93)) ^ (keys >> np.uint64(21))
    meta = np.stack([ids, per_text(mixed.view(np.int64), firsts), per_text((mixed * mixed).view(np.int64), firsts)])
    order = np.sort(keys << np.uint64(16) | docs.astype(np.uint64))  # KEY_BITS + 16 = 64
    keys, docs = order >> np.uint64(16), (order & np.uint64(0xFFFF)).astype(np.uint16)
    cuts = np.searchsorted(keys, (np.arange(buckets + 1, dtype=np.float64) * (2.0**KEY_BITS / buckets)).astype(np.uint64))
    cuts[-1] = len(keys)
    rows = {"bucket": [], "block": [], "docs": [], "keys": [], "meta": [], "sizes": []}
    for b in range(buckets):
        lo, hi = cuts[b], cuts[b + 1]
        if hi > lo:
            for k, v in zip(rows, (b, block, docs[lo:hi].tobytes(), _narrow(keys[lo:hi]), None, None), strict=True):
                rows[k].append(v)
    for k, v in zip(rows, (zlib.crc32(block.encode()) % buckets, block, None, None, meta.tobytes(), sizes.astype(np.int64).tobytes()), strict=True):
        rows[k].append(v)
    kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))


def _narrow(keys: np.ndarray) -> bytes:
    """Ascending keys as 32-bit steps where those are enough."""
    steps = np.diff(keys)
    if len(steps) and steps.max() >= 1 << 32:
        return b"8" + keys.tobytes()
    return b"4" + keys[:1].tobytes() + steps.astype(np.uint32).tobytes()


def _widen(blob: bytes) -> np.ndarray:
    if blob[:1] == b"8":
        return np.frombuffer(blob, np.uint64, offset=1)
    return np.cumsum(np.concatenate((np.frombuffer(blob, np.uint64, 1, 1), np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64))), dtype=np.uint64)


def _shared(table: pa.Table) -> pa.Table:
    """Of the postings of a hash range, those of keys in two texts or more, with the key's texts counted."""
    rows = table.to_pydict()
    found = {"block": [], "docs": [], "keys": [], "counts": [], "meta": [], "sizes": []}

    def put(*values):
        for k, v in zip(found, values, strict=True):
            found[k].append(v)

    parts = []
    for block, docs, keys, meta, sizes in zip(rows["block"], rows["docs"], rows["keys"], rows["meta"], rows["sizes"], strict=True):
        if meta is not None:
            put(block, None, None, None, meta, sizes)
        else:
            parts.append((block, np.frombuffer(docs, np.uint16), _widen(keys)))
    if parts:
        distinct, counts = runs(np.sort(np.concatenate([k for _, _, k in parts])))
        distinct, counts = distinct[counts > 1], counts[counts > 1]
        for block, docs, keys in parts if len(distinct) else ():
            at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
            hit = distinct[at] == keys
            if hit.any():
                put(block, docs[hit].tobytes(), keys[hit].tobytes(), counts[at[hit]].astype(np.uint32).tobytes(), None, None)
    kinds = (pa.string(), *[pa.binary()] * 5)
    return pa.table([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], list(found))


def _nodes(percent: int):
    """Of a block's shared postings: per text its prefix under (texts with the key, key), unshared keys first."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        docs, keys, counts = (
            np.concatenate([np.frombuffer(x, t) for x in rows[c] if x is not None] or [np.zeros(0, t)])
            for c, t in (("docs", np.uint16), ("keys", np.uint64), ("counts", np.uint32))
        )
        (meta,), (sizes,) = ([x for x in rows[c] if x is not None] for c in ("meta", "sizes"))
        sizes = np.frombuffer(sizes, np.int64)
        ids, sig_a, sig_b = np.frombuffer(meta, np.int64).reshape(3, -1)
        order = np.lexsort((keys, counts, docs))
        docs, keys = docs[order], keys[order]
        firsts = np.searchsorted(docs, np.arange(len(sizes) + 1))
        fresh = sizes - np.diff(firsts)
        length = sizes - -(-percent * sizes // 100) + 1
        out = {k: [] for k in ("doc_id", "n_shingles", "sig_a", "sig_b", "fresh", "prefix", "shared")}
        for d in range(len(sizes)):
            own = keys[firsts[d] : firsts[d + 1]]
            open_slots = int(length[d] - fresh[d]) if sizes[d] else 0
            prefix = own[: max(0, open_slots)].astype(np.int64) if open_slots > 0 else None
            for k, v in zip(out, (int(ids[d]), int(sizes[d]), int(sig_a[d]), int(sig_b[d]), int(fresh[d]), prefix, None if prefix is None else np.sort(own).tobytes()), strict=True):
                out[k].append(v)
        kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        common = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(a, b, strict=True)], np.int64)
        return pd.Series(100 * common >= percent * (n.to_numpy() + m.to_numpy() - common))

    return run


def _verify_blocks(percent: int):
    """Links between the two sides of a block; only as many as join its components."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, np.uint64) for x in right["shared"]]
            keys, place = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(place, kind="stable")
            owner = owner[order]
            at = np.searchsorted(place[order], np.arange(len(keys) + 1))
            size, comp, node = (right[c].to_numpy() for c in ("n_shingles", "component", "node"))
            for x in left.itertuples():
                own = np.frombuffer(x.shared, np.uint64)
                spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                spot = spot[keys[spot] == own]
                common = np.bincount(np.concatenate([owner[at[s] : at[s + 1]] for s in spot] or [np.zeros(0, np.int64)]), minlength=len(sets))
                hit = np.flatnonzero((100 * common >= percent * (x.n_shingles + size - common)) & (comp != x.component))
                for c, h in {int(comp[h]): h for h in hit}.items():  # one link to each component
                    links.append((x.node, int(node[h])))
        return pa.table([pa.array([v[i] for v in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of ``percent``/100 or more.

    Returns one row (doc_id, n_shingles, component_id) per input row. A set holds the distinct
    windows of ``width`` lower-cased words; a shorter text is one window; a text without words,
    or a null one, has an empty set, links with nothing and is its own component. Rows with
    a null id are left out (a component is named by its smallest id); rows that share an id
    count as copies with one id, and share a component. An empty table gives no rows; other
    columns are ignored.

    Keys are counted over the whole corpus in packed postings dealt by hash range. A key that
    only one text has comes first in the order of a prefix, so a text with more such keys than
    its prefix is long has no candidates. Texts with equal sets become one node. In each
    prefix bucket every node is verified with the bucket's centre (the node with the
    smallest share of unshared keys). Buckets that then still hold several components are joined
    to regions, and a region's components are verified against each other in blocks of
    bounded size: no link between them is missed, and no list of pairs is made.
    """
    from pyspark.sql.types import StructType

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    buckets = parts_for(source, PART_BYTES, 32)
    packed = source.mapInArrow(_pack(width, buckets), _PACKED)
    shared = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared, "block string, docs binary, keys binary, counts binary, meta binary, sizes binary")
    nodes = written(shared.groupBy("block").applyInArrow(_nodes(percent), StructType.fromDDL(_NODES)), "nodes")

    sets = nodes.where("prefix IS NOT NULL")
    same = ("n_shingles", "sig_a", "sig_b")
    firsts = sets.groupBy(*same).agg(F.min("doc_id").alias("node"))
    member = written(sets.select("doc_id", *same).join(firsts, list(same)).select("doc_id", "node"), "members")
    node = written(
        sets.withColumnRenamed("doc_id", "node").join(firsts, ["node", *same], "left_semi").dropDuplicates(["node", *same]), "sets"
    )
    slots = node.select("node", "n_shingles", (F.col("fresh") / F.col("n_shingles")).alias("share"), F.explode("prefix").alias("key"))
    centres = slots.groupBy("key").agg(F.min(F.struct("share", "node", "n_shingles")).alias("centre"), F.count("*").alias("n")).where("n > 1")
    slots = written(slots.join(centres, "key").select("key", "node", "n_shingles", "centre"), "slots")
    near = f"100 * least(n_shingles, centre.n_shingles) >= {percent} * greatest(n_shingles, centre.n_shingles)"
    pairs = slots.where(near).where("node <> centre.node").select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_verified(pairs, node, percent), "links")
    roots = connected_components(links)

    mixed = slots.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = mixed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    met = slots.join(mixed.select("key"), "key").select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()
    regions = connected_components(met).withColumnRenamed("component", "region")
    held = written(
        regions.join(node.select("node", "n_shingles", "shared"), "node").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node")),
        "regions",
    )
    own = held.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum(F.length("shared")).alias("bytes"))
    own = own.groupBy("region").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"),
        F.ceil(F.sum("bytes") / SIDE_BYTES).cast("int").alias("parts"),
    )
    held = held.join(own, "region").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = ("region", "node", "component", "n_shingles", "shared")
    left = held.where("component <> main").select(*side, F.lit(0).alias("side"), F.col("part").alias("row"), every.alias("col"))
    right = held.select(*side, F.lit(1).alias("side"), every.alias("row"), F.col("part").alias("col"))
    more = left.unionByName(right).groupBy("region", "row", "col").applyInArrow(_verify_blocks(percent), "a long, b long")
    links = written(links.unionByName(more), "links")

    roots = connected_components(links)
    place = member.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    return nodes.select("doc_id", "n_shingles").join(place, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _verified(pairs: DataFrame, node: DataFrame, percent: int) -> DataFrame:
    side = lambda x: node.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("shared").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_linked(percent)("set_a", "set_b", "n_a", "n_b")).select("a", "b")
