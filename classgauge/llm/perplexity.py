"""Operator 4: quality rules by n-gram perplexity, with a modified Kneser-Ney model of code points.

A gram is a symbol with the ORDER - 1 before it, the nearest highest, so that contexts of all orders are its leading digits. A
block of texts sends each distinct gram once, with its counts in both halves of the corpus, to the bucket that a hash of its nearest LOW
symbols names; there all contexts of higher orders are complete, as sorted arrays of whole grams. So the model grows with the
corpus and is never in one place. Texts are judged by the half they are not in; the bits of distinct grams go back to the blocks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classgauge.llm.mixing import _distinct, _union
from classgauge.llm.packing import packed, packed_keys, packed_planes, unpacked, unpacked_keys, unpacked_planes
from classgauge.llm.sizing import block_names, parts_for
from classgauge.llm.words import SPACE, Texts, mix, owners, per_text, runs, span_hashes, text_chunks, window_hashes
from classgauge.session import work_path, written

BITS, ORDER = 10, 6  # of a symbol, and symbols in a gram, which fits 64 bits
SYMBOLS = 1 << BITS
LOW = 3  # symbols that name a gram's bucket; what orders 1 and 2 hold is bounded by SYMBOLS ** 2, whatever the corpus
EDGE = 0  # stands ORDER - 1 times before each text
WHOLE, PAIRS = 960, 61  # code points that are one symbol, the most frequent; first symbols of those that are two; the rest are three
STEPS = 32  # of a bit, in which a gram's bits are rounded, so that sums don't depend on the blocks
LEAST_SPREAD = 0.04  # bits between the quartiles of a language, at least: about what ordinary prose has
SCALE, DIGIT = 1 << 32, 1 << 10  # bits in fixed point, and how much of them is told apart at a time
CHUNK = 1 << 20  # bytes of texts looked at together; some 100 times as much is held for them
BLOCK_BYTES = 16 << 20
PART_BYTES, TABLE_BYTES = 32 << 20, 8 << 20  # of input for one bucket of grams, and of blocks
SIGNS = "#*$%&|<>"  # counted as n_symbols

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS]] = True

_BASE_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_BITS_DDL = "char_bits double, step_bits double, bits double"

_DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])
_DEALT_DDL = "bucket int, block string, keys binary, first binary, second binary"
_MERGED = pa.schema([*_DEALT.remove(1), ("blocks", pa.list_(pa.string())), ("places", pa.list_(pa.binary()))])
_MERGED_DDL = "bucket int, keys binary, first binary, second binary, blocks array<string>, places array<binary>"


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, and each text's first; a byte that isn't UTF-8 counts as a lone surrogate."""
    try:
        points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.int32)
        firsts = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))[texts.offsets]
    except UnicodeDecodeError:
        raw = texts.data.tobytes()
        each = [raw[a:b].decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass") for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
        points, firsts = np.frombuffer(b"".join(each), np.int32), np.concatenate(([0], np.cumsum([len(x) // 4 for x in each])))
    return points, firsts


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which code points begin a word."""
    solid = (points != 0x20) & ((points < 0x09) | (points > 0x0D))
    opens = np.ones(len(points) + 1, bool)
    opens[1:-1] = ~solid[:-1]
    opens[firsts] = True
    return solid & opens[:-1]


def symbols(points: np.ndarray, firsts: np.ndarray, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the texts' characters, ``ORDER - 1`` edges before each text, and the text's first; and how many each character has.

    ``ranks`` has each code point's place by frequency, else its number is taken. No two code points have the same symbols.
    """
    rank = points.astype(np.int64) if ranks is None else ranks[points].astype(np.int64)
    wide, wider = rank >= WHOLE, rank >= WHOLE + PAIRS * SYMBOLS
    size = np.uint8(1) + wide + wider
    upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    out = np.empty(upto[-1], np.int16)
    out[upto[:-1]] = 1 + rank
    for own, less, lead, n in ((wide & ~wider, WHOLE, 1 + WHOLE, 2), (wider, WHOLE + PAIRS * SYMBOLS, 1 + WHOLE + PAIRS, 3)):
        at, left = upto[:-1][own], rank[own] - less
        for j in reversed(range(1, n)):
            out[at + j] = left % SYMBOLS
            left //= SYMBOLS
        out[at] = lead + left
    spots = upto[firsts]
    return np.insert(out, np.repeat(spots[:-1], ORDER - 1), EDGE), spots + (ORDER - 1) * np.arange(len(spots)), size


def grams(texts: Texts, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each symbol with the ORDER - 1 before it, each text's first, and how many each character has."""
    kinds, firsts, size = symbols(*code_points(texts), ranks)
    n = len(kinds)
    keys = kinds[ORDER - 1 :].astype(np.int64)
    for j in range(1, ORDER):
        keys |= kinds[ORDER - 1 - j : n - j].astype(np.int64) << BITS * (ORDER - j)
    own = np.ones(len(keys), bool)  # edges are given, not judged
    for j in range(1, ORDER):
        own[firsts[1:-1] - j] = False
    return keys[own], np.concatenate(([0], np.cumsum(np.diff(firsts) - (ORDER - 1)))), size


def shorter(keys):
    """The grams without their farthest symbol."""
    return (keys // SYMBOLS**2) * SYMBOLS + keys % SYMBOLS


def discounts(shape) -> np.ndarray:
    """What is taken from counts of 0, 1, 2, and 3 or more, from how many grams have counts of 1 to 4."""
    t = [int(x) for x in shape]
    y = t[0] / max(1, t[0] + 2 * t[1])
    return np.array([0.0, *(min(k, max(0.1, k - (k + 1) * y * t[k] / max(1, t[k - 1]))) for k in (1, 2, 3))])


def shape_of(counts: np.ndarray) -> np.ndarray:
    return np.array([np.sum(counts == k) for k in (1, 2, 3, 4)], np.int64)


def smoothed(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of ascending grams of one order, which hold all counted ones of their contexts; ``below`` are those of the order below."""
    if not len(keys):
        return below
    _, size = runs(keys // SYMBOLS)
    first = np.cumsum(size) - size
    cut = cuts[np.minimum(counts, 3)]
    total = np.repeat(np.add.reduceat(counts, first), size)
    spare = np.repeat(np.add.reduceat(cut, first), size)
    return np.where(total > 0, (counts - cut + spare * below) / np.maximum(total, 1), below)


class Levels:
    """Grams of one bucket and all their shorter ones down to order ``last``, with counts: of the grams themselves, below
    of how many different symbols stand before. ``keys`` ascend; ``counts`` are of any number of corpora, one a row."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, last: int):
        self.levels = [(keys, counts, None)]
        for _ in range(ORDER - last):
            upper, n, _ = self.levels[-1]
            keys, number = np.unique(shorter(upper), return_inverse=True)
            counts = np.array([np.bincount(number, c > 0, len(keys)).astype(np.int64) for c in n])
            self.levels.append((keys, counts, number))

    def probabilities(self, which: int, cuts: list[np.ndarray], below: np.ndarray) -> np.ndarray:
        """Of the grams, under the corpus ``which``: ``below`` are those of the last order, ``cuts`` the discounts of the others, longest first."""
        for at in reversed(range(len(self.levels) - 1)):
            keys, counts, _ = self.levels[at]
            below = smoothed(keys, counts[which], cuts[at], below[self.levels[at + 1][2]])
        return below


class KneserNey:
    """Interpolated modified Kneser-Ney probabilities of one corpus, in sorted arrays of grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.cuts = [discounts(shape_of(n[0])) for _, n, _ in Levels(self.keys, self.counts[None], 1).levels]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's last symbol after the others."""
        every = np.union1d(self.keys, keys)
        counts = np.zeros(len(every), np.int64)
        counts[np.searchsorted(every, self.keys)] = self.counts
        found = Levels(every, counts[None], 1)
        least, n, _ = found.levels[-1]
        below = smoothed(least, n[0], self.cuts[-1], np.full(len(least), 1 / SYMBOLS))
        return np.log10(found.probabilities(0, self.cuts, below))[np.searchsorted(every, keys)]


def base_counts(texts: Texts) -> list[np.ndarray]:
    """The five counts of the base rules for each text."""
    data = texts.data
    starts, ends, firsts = texts.edges()
    chars = np.concatenate(([0], np.cumsum(((data < 0x80) | (data >= 0xC0)) & ~SPACE[data])))
    signs = np.concatenate(([0], np.cumsum(_SIGN[data])))
    at = texts.offsets
    hashes = span_hashes(data, starts, ends)

    windows, owner = window_hashes(hashes, 3), owners(firsts)
    repeated = np.zeros(len(starts), bool)
    if len(windows):
        own = owner[: len(windows)] == owner[2:]
        spots = np.flatnonzero(own)
        keys = mix(windows[own] ^ (owner[spots].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        twin = np.zeros(len(ranked), bool)
        same = ranked[1:] == ranked[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        for j in range(3):
            repeated[spots[order[twin]] + j] = True

    breaks = np.flatnonzero(data == 0x0A)
    line_ends = np.sort(np.concatenate((breaks, at[1:])))
    line_starts = np.sort(np.concatenate((breaks + 1, at[:-1])))
    line_text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(breaks, at)) + 1)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    keys = mix(span_hashes(data, line_starts[filled], line_ends[filled]) ^ (line_text[filled].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first = np.unique(keys, return_index=True)
    copies = np.bincount(line_text[filled], minlength=len(texts)) - np.bincount(line_text[filled][first], minlength=len(texts))
    return [np.diff(firsts), chars[at[1:]] - chars[at[:-1]], signs[at[1:]] - signs[at[:-1]], copies, per_text(repeated, firsts)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks of compressed Arrow data, with their code points and how often each occurs. The last column is the text."""
    names = block_names()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    for batch in batches:
        size = pc.sum(pc.binary_length(batch.column(batch.num_columns - 1))).as_py() or 0
        limit = size // math.ceil(max(size, 1) / BLOCK_BYTES) * 17 // 16  # so that no small one is left over
        for block in text_chunks(batch.column(batch.num_columns - 1), limit):
            part = batch.slice(block.first, len(block))
            total = np.zeros(0, np.int64)
            for texts in text_chunks(part.column(part.num_columns - 1), CHUNK):
                found = np.bincount(code_points(texts)[0], minlength=len(total))
                found[: len(total)] += total
                total = found
            points = np.flatnonzero(total)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            row = (next(names), packed(points), packed(total[points]), sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([v], pa.binary()) for v in row[1:])], ["own", "points", "times", "rows"])


def _rows(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_next_batch()


def _halves(rows: pa.RecordBatch) -> np.ndarray:
    """Which half each text is in: equal texts are in the same."""
    return (rows.column(rows.num_columns - 2).to_numpy() & 1).astype(np.int8)


def _point_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for points, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(points)), pa.array(unpacked(times))], ["point", "n"])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((keys >> BITS * (ORDER - LOW)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _dealt(ranks, buckets: int):
    """The distinct grams of each block, dealt by their nearest symbols, with counts in both halves."""

    def pieces(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        half = _halves(rows)
        for texts in text_chunks(rows.column(rows.num_columns - 1), CHUNK):
            keys, firsts, _ = grams(texts, ranks.value)
            yield keys, np.repeat(half[texts.first : texts.first + len(texts)], np.diff(firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, *counts = _distinct(pieces(_rows(blob)))
                bucket = _bucket(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
                parts = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [bucket[[x[0] for x in parts]] if parts else [], [name] * len(parts), [packed_keys(keys[x]) for x in parts]]
                columns += [[packed_planes(c[x]) for x in parts] for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _DEALT.types, strict=True)], schema=_DEALT)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """A bucket's grams from all blocks, each once, with summed counts; and where each block's are among them."""
    rows = table.to_pydict()
    parts = [unpacked_keys(k) for k in rows["keys"]]
    keys = _union(list(parts))
    sums, places = [np.zeros(len(keys), np.int64) for _ in range(2)], []
    for part, *counts in zip(parts, rows["first"], rows["second"], strict=True):
        at = np.searchsorted(keys, part)
        places.append(packed(at))
        for total, n in zip(sums, counts, strict=True):
            total[at] += unpacked_planes(n)
    row = (rows["bucket"][0], packed_keys(keys), *(_packed_counts(n) for n in sums), rows["block"], places)
    return pa.table([pa.array([v], t) for v, t in zip(row, _MERGED.types, strict=True)], schema=_MERGED)


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts of any size, their lower and upper 31 bits apart."""
    return packed_planes(np.concatenate((counts & 0x7FFFFFFF, counts >> 31)))


def _unpacked_counts(blob: bytes) -> np.ndarray:
    low, high = unpacked_planes(blob).reshape(2, -1)
    return low + (high << 31)


def _levels(keys: bytes, first: bytes, second: bytes) -> Levels:
    return Levels(unpacked_keys(keys), np.array([_unpacked_counts(first), _unpacked_counts(second)]), LOW)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, for both halves: its grams of order LOW with their counts here; of each order above, how many grams have counts of 1 to 4."""
    for batch in batches:
        for bucket, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            levels = _levels(*blobs).levels
            found = [(LOW, *levels[-1][:2])]
            found += [(ORDER - i, np.arange(1, 5), np.array([shape_of(c) for c in n])) for i, (_, n, _) in enumerate(levels[:-1])]
            for order, keys, n in found:
                columns = [pa.array(np.full(len(keys), x, np.int32)) for x in (bucket, order)] + [pa.array(x) for x in (keys, *n)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "level", "key", "first", "second"])


def _of_low(shared):
    """Probabilities of some grams of order LOW with all of their contexts, in both halves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, (least, p, cuts) = table["key"].to_numpy(), shared.value
        at = np.searchsorted(least, shorter(keys))
        found = [smoothed(keys, table[name].to_numpy(), cuts[h], p[h][at]) for h, name in enumerate(("first", "second"))]
        return pa.table({"key": keys, "p": found[0], "q": found[1]})

    return run


def _returned(cuts: list[list[np.ndarray]]):
    """For each block's grams of a bucket, in the order it sent them: their bits in STEPS, for texts of the first half by the second's counts, then the other way."""

    def run(every: pa.Table, low: pa.Table) -> pa.Table:
        out = {"bucket": [], "block": [], "logs": []}
        low = low.sort_by("key")  # just the bucket's grams of that order, as its levels have them
        for row in every.to_pylist():
            found = _levels(row["keys"], row["first"], row["second"])
            bits = []
            for half, name in enumerate(("p", "q")):
                bits.append(np.round(-np.log2(found.probabilities(half, cuts[half], low[name].to_numpy())) * STEPS).astype(np.int64))
                bits[half][found.levels[0][1][1 - half] == 0] = 0  # no text asks for it
            for name, blob in zip(row["blocks"], row["places"], strict=True):
                at = unpacked(blob)
                for key, value in zip(out, (row["bucket"], name, packed_planes(np.concatenate((bits[1][at], bits[0][at])))), strict=True):
                    out[key].append(value)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=list(out))

    return run


def _judged(ranks, buckets: int, names: list[str]):
    """A block's rows with the counts of the base rules and the bits per character, from the bits of its grams."""

    def run(blocks: pa.Table, logs: pa.Table) -> pa.Table:
        parts = {p["bucket"]: unpacked_planes(p["logs"]).reshape(2, -1) for p in logs.to_pylist()}
        out = []
        for blob in blocks["rows"].to_pylist():
            rows = _rows(blob)
            half = _halves(rows)
            held = []
            for texts in text_chunks(rows.column(rows.num_columns - 1), CHUNK):
                own, firsts, size = grams(texts, ranks.value)
                distinct, number = np.unique(own, return_inverse=True)
                held.append((distinct, number.astype(np.uint32), firsts, size, texts))
            keys = _union([d for d, *_ in held])
            bucket = _bucket(keys, buckets)
            bits = np.empty((2, len(keys)), np.int64)
            if len(keys):
                bits[:, np.argsort(bucket, kind="stable")] = np.concatenate([parts[b] for b in np.unique(bucket).tolist()], axis=1)
            for distinct, number, firsts, size, texts in held:
                part = slice(texts.first, texts.first + len(texts))
                each = bits[:, np.searchsorted(keys, distinct)][np.repeat(half[part], np.diff(firsts)), number]
                if len(size) < len(each):
                    each = per_text(each, np.concatenate(([0], np.cumsum(size, dtype=np.int64))))
                points, firsts = code_points(texts)
                start = word_starts(points, firsts)
                costs = [per_text(v, firsts) / STEPS / np.maximum(1, per_text(n, firsts)) for v, n in ((each, np.ones(len(each), int)), (each * start, start))]
                columns = [c.slice(part.start, len(texts)) for c in rows.columns[:-1]]
                columns += [pa.array(x, pa.int64()) for x in base_counts(texts)] + [pa.array(x, pa.float64()) for x in (*costs, costs[0] + costs[1])]
                out.append(pa.RecordBatch.from_arrays(columns, names))
        return pa.Table.from_batches(out)

    return run


def _bucketed(rows: DataFrame, column: str, buckets: int) -> tuple[DataFrame, str]:
    """The rows, written once in buckets of a column, so that a later join by it doesn't shuffle them; and the name of their table."""
    name = f"classgauge_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, column).option("path", work_path(rows.sparkSession, "text-blocks")).saveAsTable(name)
    return rows.sparkSession.table(name), name


def _by_frequency(blocks: DataFrame) -> np.ndarray:
    """The place of each code point by frequency, then number; at most as many as Unicode has."""
    counts = blocks.select("points", "times").mapInArrow(_point_counts, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).toArrow()
    points = counts.sort_by([("n", "descending"), ("point", "ascending")])["point"].to_numpy()
    ranks = np.zeros(int(points.max()) + 1 if len(points) else 0, np.int32)
    ranks[points] = np.arange(len(points))
    return ranks


def gram_bits(blocks: DataFrame, ranks, buckets: int) -> DataFrame:
    """Rows (bucket, block, logs): the bits of each block's distinct grams by a model of each half of the texts.

    A bucket has its contexts of orders above LOW whole. Grams of order LOW are counted over all buckets and dealt again by
    context; their probabilities are joined back. Only orders 1 and 2 and the discounts pass the driver.
    """
    dealt = blocks.select("own", "rows").mapInArrow(_dealt(ranks, buckets), _DEALT_DDL)
    every = written(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merged, _MERGED_DDL), "merged-grams")
    shapes = written(every.select("bucket", "keys", "first", "second").mapInArrow(_shapes, "bucket int, level int, key long, first long, second long"), "gram-shapes")
    sums = [F.sum(c).alias(c) for c in ("first", "second")]
    low = written(shapes.where(F.col("level") == LOW).groupBy("key").agg(*sums), "low-grams")
    upper = {(level, key): n for level, key, *n in shapes.where(F.col("level") > LOW).groupBy("level", "key").agg(*sums).collect()}
    cuts = [[discounts([upper.get((n, k), (0, 0))[h] for k in range(1, 5)]) for n in range(ORDER, LOW, -1)] for h in range(2)]
    counted = low.agg(*[F.count_if(F.col(c) == k) for c in ("first", "second") for k in range(1, 5)]).head()

    two = F.shiftleft(F.shiftright("key", 2 * BITS), BITS).bitwiseOR(F.col("key").bitwiseAND(F.lit(SYMBOLS - 1)))
    pairs = low.groupBy(two.alias("key")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in ("first", "second")]).toArrow().sort_by("key")
    keys, n = pairs["key"].to_numpy(), [pairs[c].to_numpy() for c in ("first", "second")]
    ones, number = np.unique(shorter(keys), return_inverse=True)
    p = []
    for c in n:
        single = np.bincount(number, c > 0, len(ones)).astype(np.int64)
        below = smoothed(ones, single, discounts(shape_of(single)), np.full(len(ones), 1 / SYMBOLS))
        p.append(smoothed(keys, c, discounts(shape_of(c)), below[number]))
    shared = blocks.sparkSession.sparkContext.broadcast((keys, p, [discounts(counted[:4]), discounts(counted[4:])]))

    part = F.pmod(F.xxhash64(F.shiftright("key", BITS)), F.lit(parts_for(low, 8 << 20, 12)))
    third = low.groupBy(part.alias("part")).applyInArrow(_of_low(shared), "key long, p double, q double")
    asked = shapes.where(F.col("level") == LOW).select("bucket", "key").join(third, "key")
    return every.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_returned(cuts), "bucket int, block string, logs binary")


def _quartiles(values: DataFrame) -> DataFrame:
    """(lang_, n, q1, q3): count and quartiles by rank of each language's ``bits``.

    Ranks are found digit by digit of the bits as fixed-point numbers, from counts of at most DIGIT values a language,
    so no task sorts a language. Values within 1 / SCALE are one: the least of them stands for all.
    """
    digits = 4
    values = values.withColumn("v", F.floor(F.least("bits", F.lit(255.0)) * SCALE))
    sizes = values.groupBy("lang_").agg(F.count("*").alias("n"))
    ranks = F.posexplode(F.array(*[F.ceil(F.col("n") * q) for q in (0.25, 0.75)])).alias("q", "rank")
    at = sizes.select("lang_", "n", ranks).withColumn("prefix", F.lit(0).cast("long"))
    for k in reversed(range(digits)):
        upper, own = F.floor(F.col("v") / DIGIT ** (k + 1)), F.floor(F.col("v") / DIGIT**k)
        met = values.withColumns({"upper": upper, "own": own}).join(F.broadcast(at.withColumnRenamed("prefix", "upper")), ["lang_", "upper"])
        counts = met.groupBy("lang_", "n", "q", "rank", "own").agg(F.count("*").alias("c"), F.min("bits").alias("bits"))
        upto = F.sum("c").over(Window.partitionBy("lang_", "q").orderBy("own"))
        at = counts.withColumn("below", upto - F.col("c")).where("below < rank AND rank <= below + c")
        at = at.select("lang_", "n", "q", (F.col("rank") - F.col("below")).alias("rank"), F.col("own").alias("prefix"), *["bits"] * (not k))
    one = lambda q: F.max(F.when(F.col("q") == q, F.col("bits")))
    return at.groupBy("lang_", "n").agg(one(0).alias("q1"), one(1).alias("q3"))


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", keep: tuple[str, ...] = (),
    min_words: int = 50, max_repeat_percent: int = 50, reach: float = 3.0, least: int = 30,
) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_bits, step_bits, bits, base_failed, low, high, kept).

    One row per input row, with the columns ``keep`` besides; ids may be null or repeat. A text fails the base rules with under
    ``min_words`` words or over ``max_repeat_percent`` percent of words in repeated three-word windows.
    ``char_bits`` is the base-2 logarithm of the text's perplexity per character under a model of the texts of the other half: a hash of
    the text says in which half it is, so no text is judged by itself or its copies. ``step_bits`` is that of the characters
    that begin a word, where the order of words shows; ``bits`` is the sum of both. Code points are told apart, whatever their number. A document is kept
    if it passes the base rules and its bits lie within its language's band: from the first quartile less
    ``reach`` times the distance of the quartiles to the third quartile plus as much, both over that
    language's distinct texts that pass the base rules, so copies count once. The distance is taken as LEAST_SPREAD at
    least, and 1 + ``least`` / n times as wide with n such texts, as few texts tell little of a language. A null
    language is one of its own; one without such texts has no band. A null or empty text fails the
    base rules; an empty table gives no rows; other columns are ignored.
    """
    lang = F.lit(None) if lang_col is None else F.col(lang_col)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang_"),
        *[F.col(c).alias(f"kept_{c}") for c in keep], F.xxhash64(F.col(text_col).cast("string")).alias("text_key_"), F.col(text_col).cast("string").alias("text_"),
    )
    fields = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:-1])
    blocks, table = _bucketed(source.mapInArrow(_blocks, "own string, points binary, times binary, rows binary"), "own", parts_for(source, TABLE_BYTES, 12))
    try:
        ranks = docs.sparkSession.sparkContext.broadcast(_by_frequency(blocks))
        buckets = parts_for(source, PART_BYTES, 32)
        names = [*source.columns[:-1], *(x.split()[0] for x in f"{_BASE_DDL}, {_BITS_DDL}".split(", "))]
        back = gram_bits(blocks, ranks, buckets).groupBy("block")
        judged = blocks.select("own", "rows").groupBy("own").cogroup(back).applyInArrow(_judged(ranks, buckets, names), f"{fields}, {_BASE_DDL}, {_BITS_DDL}")
        judged = written(judged, "judged")
    finally:  # the files stay with the other written tables
        docs.sparkSession.sql(f"DROP TABLE {table}")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)

    texts = judged.where("NOT base_failed").groupBy("lang_", "text_key_").agg(F.min("bits").alias("bits"))
    bands = _quartiles(written(texts.select("lang_", "bits"), "bits"))
    spread = reach * (1 + least / F.col("n")) * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD))
    bands = bands.select("lang_", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    out = judged.drop("text_key_").join(F.broadcast(bands), "lang_", "left")
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)
