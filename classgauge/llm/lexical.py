"""Operator 12: ranked lexical search for many items at once, with shared parts of items summed once.

Items are sets of terms. Term sets that several items share become nodes of a graph, each the sum of two
others, so a block of documents computes a shared part's partial scores once and every item that holds
it adds them up from there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classgauge.llm.words import LOWER, owners, runs, span_hashes, text_chunks
from classgauge.session import written

ITEM_BYTES = 4 << 20  # of item texts whose terms are searched in one pass over the postings
CELLS = 1 << 20  # partial scores held at once, eight bytes each
SALTS = 64

PARTS_TERMS = np.ones(256, bool)  # bytes that part terms: ASCII other than letters and digits
PARTS_TERMS[0x80:] = False
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    PARTS_TERMS[_low:_high] = False

_BLOCK_DDL = "n_docs long, n_terms long, ids array<long>, lengths array<long>, docs binary, terms binary, counts binary"
_BLOCK = pa.schema([
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("docs", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()),
])
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Plan:
    """How the items of a block are summed.

    Symbol ``i`` below ``len(term)`` is one occurrence of ``term[i]``; each row of ``pairs`` adds the symbol that
    is the sum of its two, which come before it. ``items[j]`` are the symbols that item j sums.
    """

    term: np.ndarray
    pairs: np.ndarray
    items: list[np.ndarray]

    @property
    def additions(self) -> int:
        return len(self.pairs) + sum(max(len(x) - 1, 0) for x in self.items)

    def levels(self) -> Iterator[np.ndarray]:
        """The rows of ``pairs`` in groups whose parts are all made before them."""
        depth = np.zeros(len(self.term) + len(self.pairs), np.int64)
        for k, (a, b) in enumerate(self.pairs.tolist()):
            depth[len(self.term) + k] = 1 + max(depth[a], depth[b])
        own = depth[len(self.term) :]
        for level in range(1, int(own.max(initial=0)) + 1):
            yield np.flatnonzero(own == level)


def share_terms(items: list[np.ndarray]) -> Plan:
    """Mine the term sets that items share. ``items`` are arrays of term numbers, with repeats.

    An item's symbols stand by how many items hold them, the most first; each round makes nodes of the
    neighbouring pairs that two items or more have, those of most items first, and puts them in place of their parts.
    Rounds end when no pair is shared. The work of a round is linear in the items' length: only neighbours
    are counted, never all pairs of an item.
    """
    symbols: dict[tuple[int, int], int] = {}
    rows = []
    for own in items:
        seen: dict[int, int] = {}
        row = []
        for t in own.tolist():  # the n-th occurrence of a term is a symbol of its own, so items stay sets
            seen[t] = seen.get(t, 0) + 1
            row.append(symbols.setdefault((t, seen[t]), len(symbols)))
        rows.append(row)
    term = np.array([t for t, _ in symbols], np.int64)
    pairs: list[tuple[int, int]] = []
    while True:
        held: dict[int, int] = {}
        for row in rows:
            for s in row:
                held[s] = held.get(s, 0) + 1
        shared: dict[tuple[int, int], int] = {}
        for row in rows:
            row.sort(key=lambda s: (-held[s], s))
            for pair in zip(row, row[1:], strict=False):
                shared[pair] = shared.get(pair, 0) + 1
        made: dict[tuple[int, int], int] = {}
        for i, row in enumerate(rows):
            used = [False] * len(row)
            at = sorted((j for j in range(len(row) - 1) if shared[row[j], row[j + 1]] > 1), key=lambda j: (-shared[row[j], row[j + 1]], j))
            nodes = []
            for j in at:
                if not used[j] and not used[j + 1]:
                    used[j] = used[j + 1] = True
                    nodes.append((row[j], row[j + 1]))
            rows[i] = [s for s, u in zip(row, used, strict=True) if not u]
            for pair in nodes:
                if pair not in made:
                    made[pair] = len(term) + len(pairs)
                    pairs.append(pair)
                rows[i].append(made[pair])
        if not made:
            return Plan(term, np.array(pairs, np.int64).reshape(-1, 2), [np.array(r, np.int64) for r in rows])


def term_lists(texts: list[str | None]) -> list[list[bytes]]:
    """The terms of each text, A-Z lower-cased, with repeats; none for null."""
    out: list[list[bytes]] = []
    for part in text_chunks(pa.array(texts, pa.string())):
        raw = LOWER[part.data].tobytes()
        starts, ends, firsts = part.edges(PARTS_TERMS)
        terms = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        out += [terms[a:b] for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
    return out


def _hashes(terms: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(terms), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends)


def _postings(vocabulary):
    """Of each chunk of texts: ids, lengths in terms, and (text, term, count) of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(vocabulary.value, np.uint64)
        order = np.argsort(known)
        ranked = known[order]
        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                starts, ends, firsts = texts.edges(PARTS_TERMS)
                hashes = span_hashes(LOWER[texts.data], starts, ends)
                lengths = np.diff(firsts)
                at = np.minimum(np.searchsorted(ranked, hashes), max(len(ranked) - 1, 0))
                hit = ranked[at] == hashes if len(ranked) else np.zeros(len(hashes), bool)
                cells, counts = runs(np.sort(owners(firsts)[hit] << 32 | order[at[hit]]))
                row = (
                    int((lengths > 0).sum()), len(starts), batch.column(0).slice(texts.first, len(texts)).to_pylist(), lengths.tolist(),
                    (cells >> 32).astype(np.int32).tobytes(), (cells & 0xFFFFFFFF).astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(),
                )
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)

    return run


def _holders(n_terms: int):
    """In how many texts of a task's blocks each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held += np.bincount(np.frombuffer(blob, np.int32), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["term", "df"])

    return run


def _top(items: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each item: highest score, then lowest id; a null id is the smallest number, so first."""
    order = np.lexsort((ids, -scores, items))
    items, ids, scores = items[order], ids[order], scores[order]
    _, sizes = runs(items)
    rank = np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return items[rank < k], ids[rank < k], scores[rank < k]


NULL_ID = np.iinfo(np.int64).min


def _searched(plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int, b: int):
    """Each task's k best texts of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Plan = plan.value
        n_symbols = len(graph.term) + len(graph.pairs)
        levels = list(graph.levels())
        sizes = np.array([len(x) for x in graph.items])
        flat = np.concatenate(graph.items) if len(sizes) else np.zeros(0, np.int64)
        step = max(1, CELLS // (n_symbols + len(flat) + 1))
        best = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = np.array([NULL_ID if i is None else i for i in row["ids"]], np.int64)
                norm = 100 - b + (b * np.array(row["lengths"], np.int64) * n_docs) // n_terms
                docs, terms, counts = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("docs", "terms", "counts"))
                part = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[docs]))
                for low in range(0, len(ids), step):
                    high = min(low + step, len(ids))
                    own = slice(*np.searchsorted(docs, (low, high)))
                    cells = np.zeros((len(weights), high - low), np.int64)
                    cells[terms[own], docs[own] - low] = part[own]
                    sums = np.empty((n_symbols, high - low), np.int64)
                    sums[: len(graph.term)] = cells[graph.term]
                    for level in levels:
                        sums[len(graph.term) + level] = sums[graph.pairs[level, 0]] + sums[graph.pairs[level, 1]]
                    scores = np.add.reduceat(sums[flat], np.cumsum(sizes) - sizes, axis=0)
                    least = np.partition(scores, -k, axis=1)[:, -k] if high - low > k else np.zeros(len(scores), np.int64)
                    item, doc = np.nonzero((scores >= np.maximum(least, 1)[:, None]))
                    fresh = (item, ids[low + doc], scores[item, doc])
                    best = _top(*(np.concatenate(x) for x in zip(best, fresh, strict=True)), k)
        items, found, scores = best
        ids = pa.array(found, mask=found == NULL_ID) if len(found) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), ids, pa.array(scores, pa.int64())], schema=_FOUND)

    return run


def _best(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(items: list[tuple], source: DataFrame, k: int, b: int) -> DataFrame | None:
    spark = source.sparkSession
    lists = term_lists([t for _, t in items])
    vocabulary = sorted({t for own in lists for t in own})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    held = [(i, np.array([numbers[t] for t in own], np.int64)) for (i, _), own in zip(items, lists, strict=True) if own]
    if not held:
        return None
    asked = spark.sparkContext.broadcast(_hashes(vocabulary).tobytes())
    blocks = written(source.mapInArrow(_postings(asked), _BLOCK_DDL), "postings")
    n_docs, n_terms = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for row in blocks.select("terms").mapInArrow(_holders(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    plan = spark.sparkContext.broadcast(share_terms([own for _, own in held]))
    found = blocks.select("ids", "lengths", "docs", "terms", "counts").mapInArrow(_searched(plan, weights, n_docs, n_terms, k, b), "item long, doc_id long, score long")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)).cast("int"))
    best = _best(_best(salted, ["item", "salt"], k).select("item", "doc_id", "score"), ["item"], k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(held)], "item long, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, b: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, ranks from 1.

    Terms are runs of ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased. Whole numbers
    throughout but for the logarithm in a term's weight: 64 bits, division rounding down; ``b`` is the
    share of the length in the norm, in hundredths. A null text has no terms; an item without terms, or whose
    terms no document has, gives no rows. Equal scores go by ascending id, null first. Each document row counts,
    repeated ones too; item rows that agree in id and text are one item, and an id with several texts has a list for
    each. Other columns are ignored. Terms are told apart by 64-bit hashes.

    The items are the stated query set: they are taken in blocks of about ``ITEM_BYTES`` of text, dealt by hash, and each block
    passes once over all documents. What is broadcast and held on the driver is one block's terms. A task keeps the k best
    of its own documents; the best of those are found salt by salt, then by item.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text <> ''").distinct()
    asked = written(asked, "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / ITEM_BYTES))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        part = _search_block([tuple(r) for r in own], source, k, b)
        if part is not None:
            out = out.unionByName(part)
    return out
