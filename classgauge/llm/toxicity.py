"""Operator 5: toxicity by the nearest labelled examples under TF-IDF cosine, with a block-max inverted index."""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classgauge.llm.packing import packed, packed_keys, packed_levels, packed_planes, unpacked, unpacked_keys, unpacked_levels, unpacked_planes
from classgauge.llm.sizing import block_names, parts_for
from classgauge.llm.words import LOWER, distinct_spans, owners, runs, span_hashes, text_chunks
from classgauge.session import input_bytes, written

EXAMPLES = 8_000  # distinct labelled texts in the index, at most: the first by hash of the text
NEIGHBOURS = 16
BLOCK = 512  # examples of a block of the index; smaller ones rule out hardly more and cost more bounds
COMMON = 0.05  # a term in more than this share of the examples is a column of the dense part
TELLING = 30.0  # likelihood ratio at which a term has a quarter of the weight that the labels can give it
FLOOR = 0.02  # weight of a term that tells nothing, beside 1 for one that tells all
BLOCK_BYTES = 8 << 20
LABEL_BYTES = 32 << 20  # of label files that are broadcast
PART_BYTES = 16 << 20
QUERIES, ENTRIES = 128, 1 << 15  # texts, and their terms, of one search
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_POSTED = pa.schema([
    ("bucket", pa.int32()), ("block", pa.string()), ("terms", pa.binary()), ("held", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("firsts", pa.binary()), ("places", pa.binary()), ("counts", pa.binary()),
])
_POSTED_DDL = "bucket int, block string, terms binary, held binary, ids array<long>, firsts binary, places binary, counts binary"
_WEIGHED = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("known", pa.binary()), ("spots", pa.binary()), ("weights", pa.binary())])
_WEIGHED_DDL = "bucket int, block string, known binary, spots binary, weights binary"
_OUT = pa.schema([
    ("row", pa.int64()), ("score", pa.float64()), ("vote", pa.float64()), ("neighbours", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64())),
])
_OUT_DDL = "row long, score double, vote double, neighbours array<long>, cosines array<double>"


def text_terms(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct terms (lower-cased words without signs at the ends), each pair of a text and a term's place, in order, and its count."""
    data = LOWER[texts.data]
    starts, ends, firsts = texts.edges()
    words, number, _ = distinct_spans(data, starts, ends)
    bare: dict[bytes, int] = {}
    place = np.array([bare.setdefault(w.strip(EDGES), len(bare)) for w in words], np.int64)
    upto = np.cumsum([len(w) for w in bare]).astype(np.int64)
    hashes = span_hashes(np.frombuffer(b"".join(bare), np.uint8), np.concatenate(([0], upto[:-1])).astype(np.int64), upto) if bare else np.zeros(0, np.uint64)
    keys, counts = runs(np.sort(owners(firsts) << np.int64(32) | place[number])) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return hashes, keys >> 32, keys & 0xFFFFFFFF, counts


def _posted(buckets: int):
    """Of each block of texts: its distinct terms by bucket, with how many texts of either label and in all hold them; and the postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = block_names()
        for batch in batches:
            labels = pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False)
            for texts in text_chunks(batch.column(2), BLOCK_BYTES):
                ids = batch.column(0).slice(texts.first, len(texts)).to_pylist()
                yield block(next(names), ids, labels[texts.first : texts.first + len(texts)], *text_terms(texts))

    def block(name: str, ids: list, labels: np.ndarray, hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        dealt = hashes % np.uint64(buckets)
        order = np.lexsort((hashes, dealt))
        rank = np.empty(len(hashes), np.int64)
        rank[order] = np.arange(len(hashes))
        hashes, dealt = hashes[order], dealt[order]
        turn = np.lexsort((rank[place], doc))  # a text's terms in order, which packs well
        doc, place, counts = doc[turn], rank[place][turn], counts[turn]
        held = np.stack([np.bincount(place[own], minlength=len(hashes)) for own in (labels[doc] == 0, labels[doc] == 1, slice(None))], axis=1).astype(np.int32)
        rows = []
        cuts = np.searchsorted(dealt, np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[b], cuts[b + 1])
            rows.append((b, name, packed_keys(hashes[own].view(np.int64)), packed_planes(held[own].T.ravel()), None, None, None, None))
        firsts = np.searchsorted(doc, np.arange(len(ids) + 1))
        rows.append((None, name, None, None, ids, packed(firsts), packed_planes(np.diff(place, prepend=0)), packed_planes(counts)))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _POSTED.types, strict=True)], schema=_POSTED)

    return run


def term_weights(held: np.ndarray, n: int, n_clean: int, n_toxic: int) -> np.ndarray:
    """Each term's factor from in how many clean, toxic and all texts it is: the smoothed inverse frequency over all texts, times how far the labels tell it apart.

    That is FLOOR for a term whose share is the same under both labels and nears 1 with the likelihood ratio g
    of the difference, as (g / (g + TELLING))^2: no term is left out, and none is cut off at a limit.
    """
    clean, toxic, df = held[:, 0].astype(float), held[:, 1].astype(float), held[:, 2].astype(float)
    share = (clean + toxic) / max(1, n_clean + n_toxic)

    def part(x: np.ndarray, m: float, p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (p * m)), 0.0)

    g = 2 * (part(toxic, n_toxic, share) + part(clean, n_clean, share) + part(n_toxic - toxic, n_toxic, 1 - share) + part(n_clean - clean, n_clean, 1 - share))
    g = np.maximum(np.nan_to_num(g), 0.0)
    return (np.log((1 + n) / (1 + df)) + 1) * (FLOOR + (g / (g + TELLING)) ** 2)


def _weighed(asked, n: int, n_clean: int, n_toxic: int):
    """A bucket's terms counted over all blocks. Each block gets the factors of its terms, which of them are asked for, and the places of
    those among the asked; the factors of the asked also go out under no block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, held, bucket = [], [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                names.append(row["block"])
                terms.append(unpacked_keys(row["terms"]).view(np.uint64))
                held.append(unpacked_planes(row["held"]).reshape(3, -1).T)
        if bucket is None:
            return
        known, place = np.unique(np.concatenate(terms), return_inverse=True)
        total = np.zeros((len(known), 3), np.int64)
        np.add.at(total, place, np.concatenate(held))
        weights = term_weights(total, n, n_clean, n_toxic)
        index = np.frombuffer(asked.value, np.uint64)
        spots = np.searchsorted(index, known)
        own = np.zeros(len(known), bool)
        if len(index):
            own = index[np.minimum(spots, len(index) - 1)] == known
        ends = np.cumsum([len(t) for t in terms])
        for name, low, high in zip(names, np.concatenate(([0], ends[:-1])), ends, strict=True):
            part = place[low:high]
            yield out(bucket, name, own[part], spots[part], weights[part])
        yield out(bucket, None, own[own], spots[own], weights[own])

    def out(bucket: int, name: str | None, own: np.ndarray, spots: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
        row = bucket, name, zlib.compress(np.packbits(own).tobytes(), 1), packed_planes(np.diff(spots[own], prepend=0)), packed_levels(weights)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _WEIGHED.types, strict=True)], schema=_WEIGHED)

    return run


def _factors(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of the terms of a row of ``_weighed`` the factors, and the places among the asked, -1 for none."""
    weights = unpacked_levels(row["weights"])
    places = np.full(len(weights), -1)
    own = np.unpackbits(np.frombuffer(zlib.decompress(row["known"]), np.uint8), count=len(weights)).astype(bool)
    places[own] = np.cumsum(unpacked_planes(row["spots"]))
    return weights, places


@dataclass
class Vectors:
    """Unit vectors of some texts, one after the other: places of terms in the index, weights, and where each text starts."""

    term: np.ndarray
    weight: np.ndarray
    firsts: np.ndarray

    def __len__(self) -> int:
        return len(self.firsts) - 1

    def parts(self) -> Iterator[tuple[int, int]]:
        """Ranges of texts for one search each."""
        at = 0
        while at < len(self):
            to = max(at + 1, int(np.searchsorted(self.firsts, self.firsts[at] + ENTRIES, "right")) - 1)
            to = min(to, at + QUERIES, len(self))
            yield at, to
            at = to


class BlockMaxIndex:
    """Unit vectors of examples, inverted.

    Terms of very many examples are columns of a dense matrix, whose product with a batch of texts gives their exact part of all
    cosines. The other terms have postings, with the largest weight of each block of examples.
    """

    def __init__(self, terms: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: Vectors):
        self.terms, self.ids, self.labels = terms, ids, labels.astype(float)
        n = len(ids)
        self.blocks = -(-n // BLOCK)
        example = owners(vectors.firsts)
        self.common = np.bincount(vectors.term, minlength=len(terms)) > COMMON * n
        self.column = np.where(self.common, np.cumsum(self.common) - 1, -1)
        own = self.common[vectors.term] if len(vectors.term) else np.zeros(0, bool)
        self.dense = np.zeros((int(self.common.sum()), self.blocks * BLOCK))
        self.dense[self.column[vectors.term[own]], example[own]] = vectors.weight[own]
        term, example, weight = vectors.term[~own], example[~own], vectors.weight[~own]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        cells, size = runs(term * max(1, self.blocks) + self.example // BLOCK)
        self.spots = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, self.spots[:-1]) if len(size) else np.zeros(0)
        self.block_of = cells % max(1, self.blocks)
        self.term_cells = np.searchsorted(cells, np.arange(len(terms) + 1) * max(1, self.blocks))

    def search(self, texts: Vectors, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the k examples with the highest cosine above 0, ties by place: rows (text, example, cosine), in order. Exact.

        A block's bound is its best cosine by the dense part and the sum of its maxima over the postings' terms. A block whose bound
        is under the k-th best dense part can't have one of the k, so its postings are not read. ``skip`` has an
        example for each text that it may not find.
        """
        found = [self._search(texts, low, high, k, None if skip is None else skip[low:high]) for low, high in texts.parts()] if len(self.ids) else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _search(self, texts: Vectors, low: int, high: int, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = high - low, self.blocks * BLOCK
        own = slice(texts.firsts[low], texts.firsts[high])
        doc, term, weight = owners(texts.firsts[low : high + 1] - texts.firsts[low]), texts.term[own], texts.weight[own]
        often = self.common[term]
        queries = np.zeros((n, len(self.dense)))
        queries[doc[often], self.column[term[often]]] = weight[often]
        sims = queries @ self.dense
        sims[:, len(self.ids) :] = -1.0
        if skip is not None:
            sims[np.arange(n), skip] = -1.0
        doc, term, weight = doc[~often], term[~often], weight[~often]
        size = self.term_cells[term + 1] - self.term_cells[term]
        cell = np.repeat(self.term_cells[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        doc, weight = np.repeat(doc, size), np.repeat(weight, size)
        place = doc * self.blocks + self.block_of[cell]
        bound = sims.reshape(n, self.blocks, BLOCK).max(2) + np.bincount(place, weight * self.most[cell], n * self.blocks).reshape(n, self.blocks)
        least = np.maximum(np.partition(sims, -k, axis=1)[:, -k], 0.0) if width >= k else np.zeros(n)
        live = bound.ravel()[place] >= least[doc] - 1e-12
        cell, doc, weight = cell[live], doc[live], weight[live]
        size = self.spots[cell + 1] - self.spots[cell]
        flat = np.repeat(self.spots[cell] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sims += np.bincount(np.repeat(doc, size) * width + self.example[flat], self.weight[flat] * np.repeat(weight, size), n * width).reshape(n, width)
        if skip is not None:
            sims[np.arange(n), skip] = -1.0
        least = np.maximum(np.partition(sims, -k, axis=1)[:, -k], 0.0) if width >= k else np.zeros(n)
        row, example = np.nonzero((sims >= least[:, None] - 1e-11) & (sims > 1e-11))
        sims = np.minimum(np.round(sims[row, example], 11), 1.0)  # one text has one result, wherever in a product it stood
        order = np.lexsort((example, -sims, row))
        row, example, sims = row[order], example[order], sims[order]
        _, size = runs(row)
        best = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < k
        return row[best] + low, example[best], sims[best]


def calibration(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic blocks (pool adjacent violators) from votes of the examples, each without itself, to shares of label 1: the ends of each block and its share."""
    order = np.argsort(votes, kind="stable")
    levels, count = runs(votes[order])
    ones = np.add.reduceat(labels[order].astype(float), np.cumsum(count) - count) if len(levels) else np.zeros(0)
    stack: list[list[float]] = []  # lowest and highest vote, examples, ones
    for level, n, s in zip(levels, count, ones, strict=True):
        stack.append([level, level, n, s])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, high, n, s = stack.pop()
            stack[-1][1:] = [high, stack[-1][2] + n, stack[-1][3] + s]
    if not stack:
        return np.zeros(1), np.full(1, prior)
    return np.array([x for low, high, _, _ in stack for x in (low, high)]), np.repeat([(s + 2 * prior) / (n + 2) for _, _, n, s in stack], 2)


class ToxicityModel:
    """An index of examples with the calibration of its votes."""

    def __init__(self, index: BlockMaxIndex, prior: float, levels: np.ndarray | None = None, values: np.ndarray | None = None):
        self.index, self.prior = index, prior
        self.levels, self.values = (np.zeros(1), np.full(1, prior)) if levels is None else (levels, values)

    def votes(self, n: int, row: np.ndarray, example: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Of each text the share of label 1 among its neighbours, weighted by squared cosine; one unit of prior keeps faint votes near it."""
        weight = sims * sims
        ones = np.bincount(row, weight * self.index.labels[example], n)
        return (ones + 0.05 * self.prior) / (np.bincount(row, weight, n) + 0.05)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        """Calibrated: straight lines between blocks."""
        return 0.98 * np.interp(votes, self.levels, self.values) + 0.02 * votes


def _unit(doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(doc, weight * weight, n))
    return weight / np.maximum(norm[doc], 1e-12)


def _scored(examples, prior: float, levels: np.ndarray, values: np.ndarray):
    """A block's texts, from its postings and the factors and places of its terms."""

    def run(blocks: pa.Table, factors: pa.Table) -> pa.Table:
        if not len(blocks):
            return _OUT.empty_table()
        m = ToxicityModel(example_index(examples.value)[0], prior, levels, values)
        row = blocks.to_pylist()[0]
        n, firsts = len(row["ids"]), unpacked(row["firsts"])
        place, counts = np.cumsum(unpacked_planes(row["places"])), unpacked_planes(row["counts"])
        found = [_factors(r) for r in sorted(factors.to_pylist(), key=lambda r: r["bucket"])] or [(np.zeros(0), np.zeros(0, np.int64))]
        factor, spots = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = owners(firsts)
        weight = _unit(doc, (1 + np.log(counts)) * factor[place], n)
        term = spots[place]
        own = term >= 0
        upto = np.concatenate(([0], np.cumsum(own)))
        texts = Vectors(term[own], weight[own], upto[firsts])
        at, example, sims = m.index.search(texts, NEIGHBOURS)
        votes = m.votes(n, at, example, sims)
        cuts = pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32))
        near = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (m.index.ids[example], sims)]
        columns = [pa.array(row["ids"], pa.int64()), pa.array(m.scores(votes)), pa.array(votes), *near]
        return pa.Table.from_arrays(columns, schema=_OUT)

    return run


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            hashes, doc, place, counts = text_terms(texts)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            cut = [(hashes[place[a:b]].tobytes(), counts[a:b].astype(np.int32).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            keys = batch.column(0).slice(texts.first, len(texts))
            yield pa.RecordBatch.from_arrays([keys, pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], ["key", "terms", "counts"])


def first_examples(texts: DataFrame, examples: int = EXAMPLES) -> list[dict]:
    """Of (row, label, text) the distinct labelled texts that are first by a hash of the text, ``examples`` at most: their rows,
    labels, term hashes and counts. Copies take one place, whose label is the mean of theirs."""
    keys = F.coalesce("text", F.lit(""))
    labelled = texts.where("label IS NOT NULL").select("row", "label", "text", F.xxhash64(F.lit(3), keys).alias("place"), F.sha2(keys, 256).alias("key"))
    distinct = written(labelled.groupBy("place", "key").agg(F.min("row").alias("row"), F.avg("label").alias("label")), "distinct")
    share = min(1.0, 1.2 * examples / max(1, distinct.count()))  # room for chance; the first by hash are taken below
    ahead = distinct.where(F.pmod("place", F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    first = ahead.withColumn("turn", F.pmod("place", F.lit(1 << 30))).toArrow().sort_by([("turn", "ascending"), ("place", "ascending"), ("key", "ascending")]).slice(0, examples)
    picked = F.broadcast(texts.sparkSession.createDataFrame(first.select(["row", "key"]).to_pandas(), "row long, key string"))  # at most ``examples`` rows
    found = labelled.join(picked, ["row", "key"]).select("key", "text").mapInArrow(_example_terms, "key string, terms binary, counts binary")
    terms = {r["key"]: r for r in found.dropDuplicates(["key"]).toArrow().to_pylist()}  # an id can have a text more than once
    return [r | terms[r["key"]] for r in first.to_pylist()]


def packed_examples(rows: list[dict], terms: np.ndarray, weights: np.ndarray) -> bytes:
    """``first_examples`` with all their terms' hashes, in order, and factors, compressed behind a digest: a few megabytes, where the index
    built of them has many times that."""
    hashes = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    places = np.searchsorted(terms, np.concatenate([np.zeros(0, np.uint64), *hashes])).astype(np.int32)
    counts = b"".join([r["counts"] for r in rows])
    firsts = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int64)
    ids, labels = np.array([r["row"] for r in rows], np.int64), np.array([r["label"] for r in rows], float)
    blob = zlib.compress(pickle.dumps([x.tobytes() for x in (terms, weights, ids, labels, firsts, places)] + [counts]), 6)
    return hashlib.md5(blob).digest() + blob


_INDEXES: dict[bytes, tuple[BlockMaxIndex, Vectors]] = {}


def example_index(blob: bytes) -> tuple[BlockMaxIndex, Vectors]:
    """The index of ``packed_examples``, and the examples' vectors; a process builds it once."""
    if blob[:16] not in _INDEXES:
        _INDEXES.clear()
        kinds = (np.uint64, float, np.int64, float, np.int64, np.int32, np.int32)
        terms, weights, ids, labels, firsts, places, counts = (np.frombuffer(x, k) for x, k in zip(pickle.loads(zlib.decompress(blob[16:])), kinds, strict=True))
        vectors = Vectors(places.astype(np.int64), _unit(owners(firsts), (1 + np.log(counts)) * weights[places], len(ids)), firsts)
        _INDEXES[blob[:16]] = BlockMaxIndex(terms, ids, labels, vectors), vectors
    return _INDEXES[blob[:16]]


def _left_out(examples, prior: float):
    """The votes of a range of examples, each without itself, and their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors = example_index(examples.value)
        m = ToxicityModel(index, prior)
        for batch in batches:
            for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Vectors(vectors.term, vectors.weight, vectors.firsts[low : high + 1])
                votes = m.votes(high - low, *index.search(own, NEIGHBOURS, np.arange(low, high)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array(votes), pa.array(index.labels[low:high])], ["example", "vote", "label"])

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, examples: int = EXAMPLES
) -> DataFrame:
    """Rows (doc_id, score, predicted, vote, neighbours, cosines), one for each input row.

    Labels of rows where ``learn`` holds are learned; ids, labels and other columns are no inputs of a score, so equal
    texts have equal scores. All terms of all texts count: a term weighs 1 + ln of its count, times its inverse frequency over all
    texts, times how far the learned labels tell it apart (``term_weights``). At most ``examples`` distinct
    labelled texts are indexed, a documented bound; every text is searched, exactly, and the calibration is learned from all examples, each
    searched without itself. ``score`` is the calibrated vote of the nearest examples; ``neighbours`` names them by doc_id with their
    cosines. A null or empty text, or one that shares no term with an example, has no neighbours and the score of an empty
    vote. Null labels and null ids are not learned; an id labelled more than once counts with its largest label. Without labels
    every score is 0.5; an empty table gives no rows.

    A block of texts keeps its postings; only its distinct terms travel to where they are counted, and one factor
    each comes back, so a term of every text costs a row per block.
    """
    said = labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("row")).agg(F.max(label_col).cast("long").alias("label"))
    said = written(said, "labels")
    said = F.broadcast(said) if input_bytes(said) <= LABEL_BYTES else said  # so that the texts don't move
    rows = docs.select(F.col(id_col).cast("long").alias("row"), learn.alias("learn_"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(said, "row", "left").select("row", F.when(F.col("learn_") & F.col("label").isin(0, 1), F.col("label")).alias("label"), "text")
    held = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}  # three rows at most
    n_clean, n_toxic, n = held.get(0, 0), held.get(1, 0), sum(held.values())

    spark = docs.sparkSession
    buckets = parts_for(docs, PART_BYTES, 12)
    posted = written(texts.mapInArrow(_posted(buckets), _POSTED_DDL), "postings")
    chosen = first_examples(texts, examples)
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["terms"], np.uint64) for r in chosen]]))
    asked = spark.sparkContext.broadcast(known.tobytes())
    dealt = posted.where("bucket IS NOT NULL").select("bucket", "block", "terms", "held").repartition(buckets, "bucket")
    factors = written(dealt.groupBy("bucket").applyInArrow(_weighed(asked, n, n_clean, n_toxic), _WEIGHED_DDL), "factors")
    weights = np.zeros(len(known))
    for r in factors.where("block IS NULL").select("known", "spots", "weights").toArrow().to_pylist():  # the examples' terms, each once
        factor, places = _factors(r)
        weights[places] = factor
    prior = n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.5
    shared = spark.sparkContext.broadcast(packed_examples(chosen, known, weights))
    levels, values = np.zeros(1), np.full(1, prior)
    if chosen:
        ranges = [(low, min(low + 2 * QUERIES, len(chosen))) for low in range(0, len(chosen), 2 * QUERIES)]
        parts = spark.createDataFrame(ranges, "low long, high long").repartition(len(ranges))
        votes = parts.mapInArrow(_left_out(shared, prior), "example long, vote double, label double").toArrow().sort_by("example")
        levels, values = calibration(votes["vote"].to_numpy(), votes["label"].to_numpy(), prior)
    blocks = posted.where("bucket IS NULL").select(F.col("block").alias("own"), "ids", "firsts", "places", "counts")
    back = factors.where("block IS NOT NULL").select("block", "bucket", "known", "spots", "weights")
    scored = blocks.groupBy("own").cogroup(back.groupBy("block")).applyInArrow(_scored(shared, prior, levels, values), _OUT_DDL)
    return scored.select(F.col("row").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "vote", "neighbours", "cosines")
