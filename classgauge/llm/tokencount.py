"""Operator 1: tokens per document, with each distinct pre-token cut into pieces once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.llm.sizing import block_names, parts_for
from classgauge.llm.words import LOWER, distinct_spans, owners, runs, text_chunks

BLOCK_BYTES = 24 << 20
BLOCK_TEXTS = 1 << 16
PART_BYTES = 16 << 20

_PACKED = pa.schema([
    ("bucket", pa.int32()), ("block", pa.string()), ("marked", pa.bool_()), ("words", pa.list_(pa.binary())), ("spread", pa.binary()),
    ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())),
])
PACKED_DDL = "bucket int, block string, marked boolean, words array<binary>, spread binary, docs binary, counts binary, ids array<long>, bytes array<long>"
_PARTS = pa.schema([("block", pa.string()), ("docs", pa.binary()), ("pieces", pa.binary()), ("ids", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64()))])
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _short(values: np.ndarray) -> bytes:
    """Small numbers, a byte each; those over 254 follow in full."""
    large = values > 254
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype(np.int64).tobytes()


def _long(blob: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(blob, np.int64, offset=n)
    return values


def frequencies(buckets: int, lower: bool = False):
    """Of each block of texts: its distinct pre-tokens, dealt by hash, with the texts that have them and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = block_names()
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for mark, part in ((m, batch.filter(pa.array(marks == m))) for m in (False, True)):
                for texts in text_chunks(part.column(2), BLOCK_BYTES, BLOCK_TEXTS):
                    yield packed(texts, part.column(0).slice(texts.first, len(texts)).to_pylist(), mark, next(blocks))

    def packed(texts, ids: list, mark: bool, block: str) -> pa.RecordBatch:
        rows = []
        starts, ends, firsts = texts.edges()
        words, number, _ = distinct_spans(LOWER[texts.data] if lower else texts.data, starts, ends)
        places = np.array([xxhash.xxh64_intdigest(w) % buckets for w in words], np.int64)
        order = np.argsort(places, kind="stable")  # words by bucket
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        pairs, counts = runs(np.sort(rank[number] << np.int64(32) | owners(firsts)))
        word, doc = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint16)
        cuts = np.searchsorted(places[order], np.arange(buckets + 1))
        spots = np.searchsorted(word, cuts)
        for b in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[b], cuts[b + 1]
            at = slice(spots[b], spots[b + 1])
            spread = np.bincount(word[at] - lo, minlength=hi - lo) - 1  # each word has a text
            rows.append((int(b), block, mark, [words[i] for i in order[lo:hi]], spread.astype(np.uint16).tobytes(), doc[at].tobytes(), _short(counts[at] - 1), None, None))
        rows.append((zlib.crc32(block.encode()) % buckets, block, mark, None, None, None, None, ids, np.diff(texts.offsets).tolist()))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

    return run


def _pieces(vocabulary: str):
    """Pieces of each distinct pre-token of a bucket, counted once; summed for each text of each block."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        out, words, lists = [], *distinct_words(rows)
        size = piece_counts(vocabulary, [x.decode("utf-8", "replace") for x in words])
        for i, number in lists:
            docs, counts = pairs_of(rows, i)
            total = np.bincount(docs, weights=np.repeat(size[number], spread_of(rows, i)) * counts).astype(np.int64)
            held = np.flatnonzero(total)
            out.append((rows["block"][i], held.astype(np.uint16).tobytes(), _short(total[held]), None, None))
        out += [(b, None, None, i, n) for b, i, n in zip(rows["block"], rows["ids"], rows["bytes"], strict=True) if i is not None]
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True), _PARTS.types, strict=True)], schema=_PARTS)

    return run


def distinct_words(rows: dict) -> tuple[list[bytes], list[tuple[int, np.ndarray]]]:
    """The distinct words of a bucket's rows, and for each row that has words its place and their numbers."""
    lists = [(i, w) for i, w in enumerate(rows["words"]) if w is not None]
    every = pa.array([x for _, w in lists for x in w], pa.binary()).dictionary_encode()
    numbers = np.split(every.indices.to_numpy(zero_copy_only=False), np.cumsum([len(w) for _, w in lists])[:-1]) if lists else []
    return every.dictionary.to_pylist(), [(i, n) for (i, _), n in zip(lists, numbers, strict=True)]


def spread_of(rows: dict, i: int) -> np.ndarray:
    """In how many texts each word of a row is."""
    return np.frombuffer(rows["spread"][i], np.uint16).astype(np.int64) + 1


def pairs_of(rows: dict, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the count of each pair of a word and a text that has it."""
    docs = np.frombuffer(rows["docs"][i], np.uint16)
    return docs, _long(rows["counts"][i], len(docs)) + 1


def piece_counts(vocabulary: str, words: list[str]) -> np.ndarray:
    """How many pieces the library cuts each word into; special strings count as it takes them by default."""
    if vocabulary.endswith(".model"):
        import sentencepiece

        return np.array([len(x) for x in sentencepiece.SentencePieceProcessor(model_file=vocabulary).encode(words, num_threads=1)], np.int64)
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(vocabulary)
    library.no_truncation()
    library.no_padding()
    out = []
    for at in range(0, len(words), 4096):
        out += [len(e.ids) for e in library.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
    return np.array(out, np.int64)


def _summed(table: pa.Table) -> pa.Table:
    rows = table.to_pydict()
    ((ids, sizes),) = [(i, n) for i, n in zip(rows["ids"], rows["bytes"], strict=True) if i is not None]
    total = np.zeros(len(ids), np.int64)
    for docs, pieces in zip(rows["docs"], rows["pieces"], strict=True):
        if docs is not None:
            spots = np.frombuffer(docs, np.uint16)
            total[spots] += _long(pieces, len(spots))
    return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total)], schema=_COUNTED)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one for each input row, ids that are null or repeat included.

    ``vocabulary`` is the path of a word-level vocabulary file, the same on every machine,
    whose pre-tokens never reach across white space and drop it. A null or empty text has no bytes and
    no tokens. An empty table gives no rows; other columns are ignored.

    A block of texts is kept as its distinct pre-tokens (runs without white space) and
    their per-text frequencies, dealt by the pre-token's hash. All blocks of a bucket meet,
    each distinct pre-token is cut into pieces once, and one number per text and bucket goes
    back to be added up: no ids are made, and a frequent word costs a row per block.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(False).alias("marked"), F.col(text_col).cast("string").alias("text"))
    buckets = parts_for(source, PART_BYTES, 12)
    packed = source.mapInArrow(frequencies(buckets), PACKED_DDL)
    parts = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_pieces(vocabulary), "block string, docs binary, pieces binary, ids array<long>, bytes array<long>")
    return parts.groupBy("block").applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
