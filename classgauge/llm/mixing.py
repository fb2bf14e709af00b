"""Operator 9: language-model scores by online logistic mixing of hashed-context bit predictors.

A run is a byte with the ORDERS bytes before it, the nearest highest, so that the contexts of all orders are its leading
bytes. A block of texts sends each distinct run once, with its counts, to the bucket that a hash of its nearest LOW + 1 context bytes
names; there all contexts of higher orders are complete, and states are looked up by whole contexts, which no others
share. So what the model holds grows with the corpus and is never in one place. Scores of distinct runs go back to the blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from classgauge.llm.packing import DEALT, DEALT_DDL, MERGED_DDL, dealt_rows, merged, packed, unpacked, unpacked_keys
from classgauge.llm.sizing import block_names, parts_for
from classgauge.llm.words import LOWER, SPACE, Texts, mix, per_text, runs, span_hashes, text_chunks
from classgauge.session import written

ORDERS = 6  # predictors see 1 to ORDERS bytes before a bit, and the bits of its byte so far
LOW = 2  # orders whose counts are broadcast: at most 256 ** (LOW + 1) numbers, whatever the corpus
LEVELS = 4  # of how often the longest known context was met
GATES = (ORDERS + 1) * LEVELS * 8  # weight sets: the longest context that is known, its level, and the bit's place
BINS = 33  # of the refinement stage
TUNE_PART = 8  # one document of so many is kept out of the first counts, to learn weights by
STEPS = 8  # blocks that the weights are learned on, one after the other
RATE, HOLD = 0.7, 20.0  # of a step, and what holds weights near where they start
UNKNOWN = -128
SCALE = 12.0  # steps of a state in one unit of log odds
BLOCK_BYTES, PIECE_BYTES = 16 << 20, 1 << 18
PART_BYTES = 16 << 20
RUN_PIECE = 1 << 16

BLANK, END = 0x20, 0x0A
FIRST, TUNE, HELD = range(3)

_POSTED = pa.schema([*DEALT, ("ids", pa.list_(pa.int64())), ("kinds", pa.binary()), ("bounds", pa.binary()), ("data", pa.binary()), ("ends", pa.int64())])
_POSTED_DDL = DEALT_DDL + ", ids array<long>, kinds binary, bounds binary, data binary, ends long"



def canonical(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased words, joined by one blank and closed by an end; and where each text starts."""
    starts, ends, firsts = texts.edges()
    words = np.diff(firsts)
    last = np.zeros(len(starts), bool)
    last[firsts[1:][words > 0] - 1] = True
    keep = ~SPACE[texts.data]
    data = LOWER[texts.data]
    gaps = ends[~last]  # white space of the same text
    keep[gaps], data[gaps] = True, BLANK
    size = per_text(ends - starts, firsts) + np.maximum(words - 1, 0)
    upto = np.cumsum(size)
    return np.insert(data[keep], upto, END), np.concatenate(([0], upto + np.arange(1, len(texts) + 1)))


def byte_runs(data: np.ndarray, bounds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the bytes from ``low`` to ``high``, and their texts. Before a text stand ends."""
    first, last = (int(np.searchsorted(bounds, x, "right")) - 1 for x in (low, high - 1))
    cuts = np.clip(bounds[first : last + 2], low, high)
    text = np.repeat(np.arange(first, last + 1), np.diff(cuts))
    inside = np.arange(low, high) - bounds[text]
    near = np.full(high - low + ORDERS, END, np.uint8)  # with the bytes before the piece
    begin = max(0, low - ORDERS)
    near[ORDERS - (low - begin) :] = data[begin:high]
    out = near[ORDERS:].astype(np.int64)
    for j in range(1, ORDERS + 1):
        before = near[ORDERS - j : len(near) - j].astype(np.int64)
        before[inside < j] = END
        out |= before << 8 * (ORDERS + 1 - j)
    return out, text


def context_keys(keys: np.ndarray, order: int) -> np.ndarray:
    """The runs with ``order`` bytes of context left."""
    return (keys >> 8 * (ORDERS + 1 - order)) << 8 | (keys & 0xFF)


def _word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words of canonical texts."""
    ends = np.flatnonzero((data == BLANK) | (data == END))
    starts = np.concatenate(([0], ends[:-1] + 1))
    own = ends > starts
    starts, ends = starts[own], ends[own]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _counted(parts: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their summed counts."""
    values, counts = np.concatenate(parts), np.concatenate(sizes)
    order = np.argsort(values, kind="stable")
    distinct, n = runs(values[order])
    return distinct, np.add.reduceat(counts[order], np.cumsum(n) - n) if len(n) else counts


def _distinct(keys: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, with their counts in first and tune texts, from pieces of keys and kinds."""
    parts, sizes, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    kinds = {k: ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]) for k in (FIRST, TUNE, HELD)}
    for piece, kind in keys:
        for k, (parts, sizes) in kinds.items():
            own = piece[kind == k]
            if not len(own):
                continue
            distinct, n = runs(np.sort(own))
            parts.append(distinct)
            sizes.append(n)
            if sum(map(len, parts[1:])) > 2 * len(parts[0]) + (1 << 20):
                parts[:], sizes[:] = ([x] for x in _counted(parts, sizes))
    done = {k: _counted(*v) for k, v in kinds.items()}
    every, _ = runs(np.sort(np.concatenate([v for v, _ in done.values()])))
    counts = []
    for k in (FIRST, TUNE):
        n = np.zeros(len(every), np.int64)
        n[np.searchsorted(every, done[k][0])] = done[k][1]
        counts.append(n)
    return every, *counts


def _pieces(data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for low in range(0, len(data), PIECE_BYTES):
        keys, text = byte_runs(data, bounds, low, min(low + PIECE_BYTES, len(data)))
        yield keys, kinds[text]


def _run_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((keys >> 8 * (ORDERS - LOW)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return buckets + (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _posted(buckets: int):
    """Of each block of texts: its distinct runs, dealt by their nearest context, and words, dealt by hash (the second half of the buckets), with counts; and the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = block_names()
        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            for texts in text_chunks(batch.column(2), BLOCK_BYTES):
                own = kinds[texts.first : texts.first + len(texts)]
                ids = batch.column(0).slice(texts.first, len(texts)).to_pylist()
                yield from block(next(names), ids, own, *canonical(texts))

    def block(name: str, ids: list, kinds: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, *counts = _distinct(_pieces(data, bounds, kinds))
        yield from dealt(name, keys, counts, _run_bucket(keys, buckets))
        starts, ends, text = _word_spans(data, bounds)
        hashes = span_hashes(data, starts, ends).view(np.int64)
        keys, *counts = _distinct(iter([(hashes, kinds[text])]))
        yield from dealt(name, keys, counts, _word_bucket(keys, buckets))
        row = (None, name, None, None, None, ids, kinds.tobytes(), packed(bounds), zlib.compress(data.tobytes(), 1), int((kinds != HELD).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _POSTED.types, strict=True)], schema=_POSTED)

    def dealt(name: str, keys: np.ndarray, counts: list[np.ndarray], bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")
        rows = [(*r, *[None] * 5) for r in dealt_rows(name, bucket[order], keys[order], *(c[order] for c in counts))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _POSTED.types, strict=True)], schema=_POSTED)

    return run


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, first, tune in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            low = context_keys(unpacked_keys(keys), LOW)
            order = np.argsort(low, kind="stable")
            distinct, n = runs(low[order])
            at = np.cumsum(n) - n
            sums = [np.add.reduceat(unpacked(c)[order], at) if len(at) else at for c in (first, tune)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct), *(pa.array(s) for s in sums)], ["key", "first", "tune"])


class Predictors:
    """What the predictors say of the bits of some runs, which hold all runs of their contexts beyond order LOW.

    A state is the log odds of a 1 in a context, after the bits so far, in SCALE steps a unit; UNKNOWN where the context was
    never met. ``low`` are the keys and counts of order LOW of the whole corpus.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]):
        self.keys = keys
        self.orders = []
        for order in range(1, ORDERS + 1):
            if order <= LOW:
                wide = (low[0] >> 8 * (LOW - order + 1)) << 8 | (low[0] & 0xFF) if order < LOW else low[0]
                values, n = _counted([wide], [low[1]])
                self.orders.append((values, n, None))
                continue
            own = context_keys(keys, order)
            turn = np.argsort(own, kind="stable")
            values, size = runs(own[turn])
            n = np.add.reduceat(counts[turn], np.cumsum(size) - size) if len(size) else counts
            number = np.empty(len(keys), np.int64)
            number[turn] = np.repeat(np.arange(len(values)), size)
            self.orders.append((values, n, number))

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place of a byte: the place, the runs' bits, the states (orders x runs), and the gates that pick the weights."""
        for place in range(8):
            states = np.empty((ORDERS, len(self.keys)), np.int8)
            longest, met = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
            for k, (values, n, number) in enumerate(self.orders):
                nodes, size = runs(values >> (8 - place))
                at = np.cumsum(size) - size
                total = np.add.reduceat(n, at) if len(at) else n
                ones = np.add.reduceat(n * ((values >> (7 - place)) & 1), at) if len(at) else n
                odds = np.clip(np.round(np.log((ones + 0.3) / (total - ones + 0.3)) * SCALE), -127, 127)
                said = np.where(total > 0, odds, UNKNOWN).astype(np.int8)
                if number is None:  # of the whole corpus: the run's own may not be among them
                    asked = context_keys(self.keys, k + 1) >> (8 - place)
                    spot = np.minimum(np.searchsorted(nodes, asked), max(len(nodes) - 1, 0))
                    hit = nodes[spot] == asked if len(nodes) else np.zeros(len(asked), bool)
                    states[k] = np.where(hit, said[spot], UNKNOWN) if len(nodes) else UNKNOWN
                    own = np.where(hit, total[spot], 0) if len(nodes) else np.zeros(len(asked), np.int64)
                else:
                    spot = np.repeat(np.arange(len(nodes)), size)[number]
                    states[k], own = said[spot], total[spot]
                known = own > 0
                longest[known], met[known] = k + 1, own[known]
            level = np.minimum(np.log2(np.maximum(met, 1)).astype(np.int64), LEVELS - 1)
            yield place, (self.keys >> (7 - place)) & 1, states, (longest * LEVELS + level) * 8 + place


def _inputs(states: np.ndarray) -> np.ndarray:
    """(runs x predictors and a constant)"""
    said = states.T.astype(float)
    return np.concatenate((np.where(states.T == UNKNOWN, 0.0, said / SCALE), np.full((len(said), 1), 0.3)), axis=1)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bins(dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spot = np.clip(dot, -7.99, 7.99) * (BINS - 1) / 16 + (BINS - 1) / 2
    return np.floor(spot + 0.5).astype(np.int64), spot


def _tune_inputs(low):
    """The states and gates of the bits of a bucket's tune runs, by first counts alone, in STEPS blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blobs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, first, tune = unpacked_keys(blobs[0]), unpacked(blobs[1]), unpacked(blobs[2])
                own = tune > 0
                step = (mix(keys[own].astype(np.uint64)) % np.uint64(STEPS)).astype(np.int64)
                parts: list[list] = [[] for _ in range(STEPS)]
                for _, bit, states, gate in Predictors(keys, first, low.value).bits():
                    for s in range(STEPS):
                        at = np.flatnonzero(own)[step == s]
                        parts[s].append((bit[at].astype(np.int8), np.ascontiguousarray(states[:, at].T), gate[at].astype(np.int16), tune[at]))
                for s, held in enumerate(parts):
                    blob = [zlib.compress(np.concatenate(x).tobytes(), 1) for x in zip(*held, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([b], pa.binary()) for b in blob)], ["step", "bit", "states", "gate", "n"])

    return run


def _learn(weights: np.ndarray, refine: bool):
    """Sums for one step of learning the weights, or for the refinement once they are learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, curve = np.zeros((GATES, ORDERS + 1)), np.zeros((GATES, ORDERS + 1, ORDERS + 1))
        bins = np.zeros((GATES, BINS, 2))
        for batch in batches:
            for row in batch.to_pylist():
                bits, states, gates, counts = (np.frombuffer(zlib.decompress(row[c]), t) for c, t in (("bit", np.int8), ("states", np.int8), ("gate", np.int16), ("n", np.int64)))
                states = states.reshape(-1, ORDERS)
                for low in range(0, len(bits), RUN_PIECE):
                    own = slice(low, low + RUN_PIECE)
                    x, gate, bit, n = _inputs(states[own].T), gates[own], bits[own], counts[own].astype(float)
                    dot = (x * weights[gate]).sum(1)
                    if refine:
                        np.add.at(bins, (gate, _bins(dot)[0], bit), n)
                        continue
                    p = _squash(dot)
                    error, spread = n * (bit - p), n * np.maximum(p * (1 - p), 1e-3)
                    for j in range(ORDERS + 1):
                        slope[:, j] += np.bincount(gate, error * x[:, j], GATES)
                        for k in range(j + 1):
                            curve[:, j, k] += np.bincount(gate, spread * x[:, j] * x[:, k], GATES)
        out = bins.ravel() if refine else np.concatenate((slope.ravel(), curve.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["at", "v"])

    return run


def _summed(rows: DataFrame, n: int) -> np.ndarray:
    table = rows.groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n)
    out[table["at"].to_numpy()] = table["v"].to_numpy()
    return out


class Mixer:
    """Weights and refinement; ``log10`` scores runs by what the predictors say."""

    def __init__(self, weights: np.ndarray, refined: np.ndarray):
        self.weights, self.refined = weights, refined

    def log10(self, predictors: Predictors) -> np.ndarray:
        """Log10 probability of each run's last byte after the others; over all 256 bytes they add up to 1."""
        out = np.zeros(len(predictors.keys))
        for _, bits, states, gates in predictors.bits():
            for at in range(0, len(out), RUN_PIECE):
                own = slice(at, at + RUN_PIECE)
                gate, bit = gates[own], bits[own]
                dot = (_inputs(states[:, own]) * self.weights[gate]).sum(1)
                spot = _bins(dot)[1]
                low = np.minimum(np.floor(spot).astype(np.int64), BINS - 2)
                second = self.refined[gate, low] * (1 - spot + low) + self.refined[gate, low + 1] * (spot - low)
                p = np.clip((_squash(dot) + second) / 2, 1e-6, 1 - 1e-6)
                out[own] += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def learned_mixer(every: DataFrame, low: DataFrame, buckets: int) -> Mixer:
    """Weights learned online on the tune texts: block after block is predicted with the weights so far, which then move against
    the errors by a damped Newton step, each gate's apart. Then the refinement, which maps a mixed prediction to the
    share of ones it had. The predictors know the first texts only, as they will know no text that they score unseen."""
    spark = every.sparkSession
    table = low.toArrow().sort_by("key")
    shared = spark.sparkContext.broadcast((table["key"].to_numpy(), table["first"].to_numpy()))
    inputs = every.where(F.col("bucket") < buckets).select("keys", "first", "second").mapInArrow(_tune_inputs(shared), "step int, bit binary, states binary, gate binary, n binary")
    inputs = written(inputs, "tune-inputs")
    weights = np.full((GATES, ORDERS + 1), 0.0)
    weights[:, :ORDERS] = 0.25
    start = weights
    for step in range(STEPS):
        block = inputs.where(F.col("step") == step)
        sums = _summed(block.mapInArrow(_learn(weights, False), "at int, v double"), weights.size * (ORDERS + 2))
        slope, curve = sums[: weights.size].reshape(weights.shape), sums[weights.size :].reshape(GATES, ORDERS + 1, ORDERS + 1)
        curve = curve + np.swapaxes(np.tril(curve, -1), 1, 2) + HOLD * np.eye(ORDERS + 1)
        weights = weights + RATE * np.linalg.solve(curve, (slope - HOLD * (weights - start))[:, :, None])[:, :, 0]
    bins = _summed(inputs.mapInArrow(_learn(weights, True), "at int, v double"), GATES * BINS * 2).reshape(GATES, BINS, 2)
    prior = _squash((np.arange(BINS) - (BINS - 1) / 2) * 16 / (BINS - 1))
    return Mixer(weights, (bins[:, :, 1] + 4 * prior) / (bins.sum(2) + 4))


def _returned(low, mixer, buckets: int):
    """For each block's keys of a bucket, in the order it sent them: the log10 probability of a run, or log10 of one more than a word's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, first, tune = unpacked_keys(row["keys"]), unpacked(row["first"]), unpacked(row["second"])
                if row["bucket"] >= buckets:
                    values = np.log10(first + tune + 1.0)
                else:
                    values = mixer.value.log10(Predictors(keys, first + tune, low.value)).astype(np.float32)
                for name, blob in zip(row["blocks"], row["places"], strict=True):
                    at = unpacked(blob)
                    columns = [pa.array([row["bucket"]], pa.int32()), pa.array([name]), pa.array([values[at].tobytes()])]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "logs"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many training words a bucket has, and how many different ones."""
    for batch in batches:
        for first, second in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = unpacked(first) + unpacked(second)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], ["tokens", "types"])


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64()),
])


def _union(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of ascending parts, merged two by two."""
    while len(parts) > 1:
        parts = [runs(np.sort(np.concatenate(parts[i : i + 2]), kind="stable"))[0] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.zeros(0, np.int64)


def _scored(buckets: int):
    """A block's texts, from the logs of its runs and words. In pieces, so that a long text needs no more than a short one."""

    def run(blocks: pa.Table, logs: pa.Table) -> pa.Table:
        if not len(blocks):
            return _SCORED.empty_table()
        row, parts = blocks.to_pylist()[0], {p["bucket"]: p["logs"] for p in logs.to_pylist()}
        data, bounds = np.frombuffer(zlib.decompress(row["data"]), np.uint8), unpacked(row["bounds"])
        n = len(row["ids"])

        def logs_of(keys: np.ndarray, bucket: np.ndarray, kind) -> np.ndarray:
            """The logs that came back, in the order of the keys."""
            order = np.argsort(bucket, kind="stable")
            out = np.empty(len(keys), kind)
            out[order] = np.concatenate([np.zeros(0, kind), *[np.frombuffer(parts[b], kind) for b in np.unique(bucket).tolist()]])
            return out

        held = []
        for at in range(0, len(data), PIECE_BYTES):
            own, text = byte_runs(data, bounds, at, min(at + PIECE_BYTES, len(data)))
            order = np.argsort(own, kind="stable")
            distinct, size = runs(own[order])
            number = np.empty(len(own), np.uint32)
            number[order] = np.repeat(np.arange(len(distinct), dtype=np.uint32), size)
            held.append((distinct, number, int(text[0]), np.diff(np.searchsorted(text, np.arange(text[0], text[-1] + 2)))))
        keys = _union([d for d, *_ in held])
        values = logs_of(keys, _run_bucket(keys, buckets), np.float32)
        score = np.zeros(n)
        for distinct, number, first, sizes in held:
            each = values[np.searchsorted(keys, distinct)].astype(float)[number]
            upto = np.concatenate(([0.0], np.cumsum(each)))
            ends = np.cumsum(sizes)
            score[first : first + len(sizes)] += upto[ends] - upto[ends - sizes]
        starts, ends, text = _word_spans(data, bounds)
        hashes = span_hashes(data, starts, ends).view(np.int64)
        keys, _ = runs(np.sort(hashes))
        each = logs_of(keys, _word_bucket(keys, buckets), np.float64)[np.searchsorted(keys, hashes)]
        columns = [
            pa.array(row["ids"], pa.int64()), pa.array(np.frombuffer(row["kinds"], np.int8) == HELD), pa.array(np.bincount(text, minlength=n)),
            pa.array(np.bincount(text[each > 0], minlength=n)), pa.array(np.bincount(text, each, n)), pa.array(score), pa.array(np.diff(bounds)),
        ]
        return pa.Table.from_arrays(columns, schema=_SCORED)

    return run


def counted_runs(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Blocks of texts; their distinct runs and words with counts over all texts, a row for each bucket; the counts of order LOW; and how many buckets are of runs."""
    text = F.col(text_col).cast("string")
    tune = F.pmod(F.xxhash64(text, F.lit("tune")), F.lit(TUNE_PART)) == 0
    kind = F.when(F.coalesce(held_out, F.lit(False)), HELD).when(text.isNotNull() & tune, TUNE).otherwise(FIRST)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), kind.alias("kind"), text.alias("text"))
    buckets = parts_for(source, PART_BYTES, 12)
    posted = written(source.mapInArrow(_posted(buckets), _POSTED_DDL), "posted-runs")
    dealt = posted.where("bucket IS NOT NULL").select(*DEALT.names)
    every = written(dealt.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(merged, MERGED_DDL), "merged-runs")
    low = every.where(F.col("bucket") < buckets).select("keys", "first", "second").mapInArrow(_low_counts, "key long, first long, tune long")
    low = written(low.groupBy("key").agg(F.sum("first").alias("first"), F.sum("tune").alias("tune")), "low-runs")
    return posted, every, low, buckets


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one for each input row.

    Tokens are the lower-cased (A-Z) words and one end. ``base_score`` is the add-one unigram log10 probability
    with counts of the documents that aren't held out; ``score`` the mixing model's log10 probability of
    the canonical text, its words joined by blanks and ended, learned from the same documents; ``bits_per_byte`` is over that text's
    bytes. A null ``held_out`` counts as false; ids may be null or repeat, and each row counts. A null or empty text is one end. Without
    training documents N and V are 0 and every bit has about half; an empty table gives no rows; other columns are ignored.
    Words are told apart by 64-bit hashes.

    Weights are learned on the training texts that one in TUNE_PART hashes pick, with counts of the others; then
    all training texts count. What is broadcast is the counts of order LOW, with a fixed bound, and the weights.
    """
    posted, every, low, buckets = counted_runs(docs, held_out, id_col, text_col)
    mixer = learned_mixer(every, low, buckets)
    counts = every.where(F.col("bucket") >= buckets).select("first", "second").mapInArrow(_totals, "tokens long, types long")
    sums = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).head()
    blocks = posted.where("bucket IS NULL").select(F.col("block").alias("own"), "ids", "kinds", "bounds", "data", "ends")
    n_ends = blocks.agg(F.coalesce(F.sum("ends"), F.lit(0))).head()[0]
    n, v = sums[0] + n_ends, sums[1] + (n_ends > 0)

    context = docs.sparkSession.sparkContext
    table = low.select("key", (F.col("first") + F.col("tune")).alias("n")).toArrow().sort_by("key")
    shared = context.broadcast((table["key"].to_numpy(), table["n"].to_numpy()))
    back = every.mapInArrow(_returned(shared, context.broadcast(mixer), buckets), "bucket int, block string, logs binary")
    scored = blocks.drop("ends").groupBy("own").cogroup(back.groupBy("block")).applyInArrow(
        _scored(buckets), "doc_id long, held_out boolean, words long, known long, logs double, score double, bytes long"
    )
    n_tokens = F.col("words") + 1
    return scored.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + int(n_ends > 0)).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(n_ends + 1) - n_tokens * math.log10(n + v + 1)).alias("base_score"),
        "score", (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )
