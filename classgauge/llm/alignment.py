"""Operator 13: tokens of two tokenizers aligned by bytes, and how often each pair of ids meets.

A pair's documents in a block are compressed bitmaps with multiplicity planes. They stay with their block; only a pair's
popcounts travel, packed, to a bucket of its second id, and its corpus-wide score comes back to the block, where its postings hand it to
the documents. A pair of every document costs a number per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.llm.bitmaps import MOST_DOCS, Planes
from classgauge.llm.bpe import Bpe, segments
from classgauge.llm.packing import DEALT, DEALT_DDL, MERGED_DDL, dealt_rows, merged, packed, unpacked, unpacked_keys
from classgauge.llm.sizing import block_names, parts_for
from classgauge.llm.words import Texts, distinct_spans, mix, owners, runs, text_chunks
from classgauge.session import written

BLOCK_BYTES = 4 << 20
PART_BYTES = 16 << 20
BLANK = 0x20

_SUMS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())]
_BLOCK = pa.schema([*DEALT, ("ids", pa.list_(pa.int64())), *[(n, pa.list_(t)) for n, t in _SUMS], ("planes", pa.binary())])
_BLOCK_DDL = DEALT_DDL + (
    ", ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, planes binary"
)
_ROWS = pa.schema([("doc_id", pa.int64()), *_SUMS, ("n_best", pa.int64()), ("count_sum", pa.int64())])
_ROWS_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
_PAIRS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n_links", pa.int64()), ("n_docs", pa.int64()), ("best", pa.bool_())])


class _Cut:
    """Ids of spans by one tokenizer; ``spelled[i]`` are the bytes of id i."""

    def __init__(self, spelled: list[bytes]):
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def spans(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and each text's first of spans that tile the texts and can be cut apart."""
        raise NotImplementedError

    def cut(self, spans: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, each text's first, and which texts' ids spell other bytes than they have. Each distinct span is cut once."""
        starts, ends, firsts = self.spans(texts)
        spans, number, _ = distinct_spans(texts.data, starts, ends)
        own = self.cut(spans)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        every = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
        odd = self._misspelled(spans, every, sizes)
        opens = np.cumsum(sizes) - sizes
        lengths = sizes[number]
        at = np.concatenate(([0], np.cumsum(lengths)))
        flat = every[np.repeat(opens[number] - at[:-1], lengths) + np.arange(at[-1])]
        wrong = np.bincount(owners(firsts)[odd[number]], minlength=len(texts)) > 0
        return flat, at[firsts], wrong

    def _misspelled(self, spans: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which spans' ids spell other bytes than they have."""
        lengths = np.fromiter(map(len, spans), np.int64, len(spans))
        owner = np.repeat(np.arange(len(spans)), sizes)
        odd = np.bincount(owner, self.sizes[ids], len(spans)).astype(np.int64) != lengths
        kept = ids[~odd[owner]]
        size = self.sizes[kept]
        spelled = self.bytes[np.repeat(self.starts[kept] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        raw = np.frombuffer(b"".join([s for s, o in zip(spans, odd.tolist(), strict=True) if not o]), np.uint8)
        fine = np.flatnonzero(~odd)
        differs = np.repeat(fine, lengths[fine])[spelled != raw]
        odd[differs] = True
        return odd


class _ByteLevel(_Cut):
    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held = Bpe(path).bytes
        super().__init__([held.get(i, b"") for i in range(max(held) + 1)])
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()

    def spans(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return segments(texts)[:3]

    def cut(self, spans: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)]


class _Pieces(_Cut):
    """Pieces have blanks only in front, so no piece reaches over the place between another character and a blank."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("the model has pieces that reach from a word to the next")
        self.blank = self.library.piece_to_id("▁")
        super().__init__([bytes([int(n[3:-1], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def spans(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blank = texts.data == BLANK
        cut = np.zeros(len(blank) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[texts.offsets] = True
        bounds = np.flatnonzero(cut)
        return bounds[:-1], bounds[1:], np.searchsorted(bounds[:-1], texts.offsets)

    def cut(self, spans: list[bytes]) -> list[list[int]]:
        """Each span starts with a blank, which the model puts there itself unless nothing follows."""
        cut = self.library.encode([s[1:].decode() for s in spans], num_threads=1)
        return [ids if len(s) > 1 else [self.blank] for s, ids in zip(spans, cut, strict=True)]


@cache
def _cutters(path_a: str, path_b: str) -> tuple[_Cut, _Cut]:
    return _ByteLevel(path_a), _Pieces(path_b)


@cache
def _numerals(n: int) -> np.ndarray:
    """The ids as decimal text, each with every sign that may follow it."""
    return np.array([[str(i) + sign for sign in ("", ",", "|", ";")] for i in range(n)], object)


def _group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, firsts: np.ndarray) -> Iterator[str]:
    """The groups of each text as ``a1,a2|b1;a3|b2``, from ids and their groups; ``firsts`` has each text's first group."""
    n = int(firsts[-1])
    upto_a, upto_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n)))) for g in (group_a, group_b))
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[upto_a[1:] - 1] = last_b[upto_b[1:] - 1] = True
    sign_b = np.where(last_b, 3, 1)
    ends = firsts[1:][np.diff(firsts) > 0]
    sign_b[upto_b[ends] - 1] = 0
    words = _numerals(1 << int(max(a.max(initial=0), b.max(initial=0))).bit_length())
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + upto_b[group_a]] = words[a, np.where(last_a, 2, 1)]
    out[np.arange(len(b)) + upto_a[group_b + 1]] = words[b, sign_b]
    spots = (upto_a + upto_b)[firsts].tolist()
    for low, high in zip(spots[:-1], spots[1:], strict=True):
        yield "".join(out[low:high].tolist())


def _aligned(path_a: str, path_b: str, spell: bool, buckets: int):
    """Blocks of texts with their groups, the pairs of a block as bitmaps, and their popcounts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_a, cut_b = _cutters(path_a, path_b)
        names = block_names()
        for batch in batches:
            column = pc.fill_null(pc.cast(batch.column(1), pa.large_string()), "")
            filled = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
            for texts in text_chunks(filled, BLOCK_BYTES, MOST_DOCS):
                ids = batch.column(0).slice(texts.first, len(texts)).to_pylist()
                rows = block(next(names), ids, cut_a, cut_b, texts)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _BLOCK.types, strict=True)], schema=_BLOCK)

    def block(name: str, ids: list, cut_a: _Cut, cut_b: _Cut, texts: Texts) -> list[tuple]:
        (a, first_a, wrong_a), (b, first_b, wrong_b) = cut_a.ids(texts), cut_b.ids(texts)
        wrong = wrong_a | wrong_b
        doc_a, doc_b = owners(first_a), owners(first_b)
        keep_a, keep_b = ~wrong[doc_a], ~wrong[doc_b]
        a, b, doc_a, doc_b = a[keep_a], b[keep_b], doc_a[keep_a], doc_b[keep_b]
        ends_a, ends_b = np.cumsum(cut_a.sizes[a]), np.cumsum(cut_b.sizes[b])  # the texts left, one after another
        stops, twice = runs(np.sort(np.concatenate((ends_a, ends_b)), kind="stable"))  # a link is a stretch between neighbouring ends: one token of each
        cuts = stops[twice == 2]
        at_a, at_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
        link_doc = doc_a[at_a]
        n = len(texts)
        per_doc = [np.bincount(x, minlength=n) for x in (doc_a, doc_b, doc_a[np.searchsorted(ends_a, cuts)], link_doc)]
        firsts = np.concatenate(([0], np.cumsum(per_doc[2])))
        spelled = list(_group_texts(a, b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), firsts))
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled]
        met = a[at_a].astype(np.int64) << 32 | b[at_b]
        order = np.argsort(met, kind="stable")  # links of a pair stay in the texts' order
        pairs, held = runs(met[order])
        bucket = (mix((pairs & 0xFFFFFFFF).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")  # pairs by bucket
        rank = np.empty(len(pairs), np.int64)
        rank[turn] = np.arange(len(pairs))
        cells, counts = runs(np.sort(np.repeat(rank, held) * MOST_DOCS + link_doc[order]))
        planes = Planes.of(cells // MOST_DOCS, cells % MOST_DOCS, counts, len(pairs), n)
        rows = [(*r, *[None] * 8) for r in dealt_rows(name, bucket[turn], pairs[turn], planes.link_counts(), planes.doc_counts())]
        sums = [x.tolist() for x in per_doc]
        rows.append((None, name, None, None, None, ids, *sums, digests, spelled if spell else None, planes.packed()))
        return rows

    return run


def _best(keys: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Which pairs have the most links of all with their second id, ties included."""
    second = keys & 0xFFFFFFFF
    order = np.argsort(second, kind="stable")
    _, n = runs(second[order])
    top = np.maximum.reduceat(links[order], np.cumsum(n) - n) if len(n) else links
    best = np.empty(len(keys), bool)
    best[order] = links[order] == np.repeat(top, n)
    return best


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys, links, held = unpacked_keys(row["keys"]), unpacked(row["first"]), unpacked(row["second"])
            columns = [(keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), links, held, _best(keys, links)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PAIRS)


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's scores of a bucket, in the order in which it sent the pairs."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            keys, links = unpacked_keys(row["keys"]), unpacked(row["first"])
            best = _best(keys, links)
            for block, blob in zip(row["blocks"], row["places"], strict=True):
                at = unpacked(blob)
                columns = [pa.array([row["bucket"]], pa.int32()), pa.array([block]), pa.array([packed(links[at])]), pa.array([packed(best[at])])]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "own", "links", "best"])


def _scored(blocks: pa.Table, scores: pa.Table) -> pa.Table:
    """A block's texts, with what their pairs' scores add up to."""
    if not len(blocks):
        return _ROWS.empty_table()
    row = blocks.to_pylist()[0]
    planes = Planes.unpacked(row["planes"])
    parts = sorted(scores.to_pylist(), key=lambda p: p["bucket"])
    count, best = (np.concatenate([np.zeros(0, np.int64), *[unpacked(p[c]) for p in parts]]) for c in ("links", "best"))
    more = [row[n] if row[n] is not None else [None] * planes.n_docs for n, _ in _SUMS]
    values = [row["ids"], *more, planes.totals(best), planes.totals(count)]
    return pa.table([pa.array(v, t) for v, t in zip(values, _ROWS.types, strict=True)], schema=_ROWS)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", spell: bool = False) -> DataFrame:
    """The texts encoded both ways and aligned: a row for each block of texts, and a row for each bucket of its pairs; written, so that
    all later steps agree on the blocks."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(source.mapInArrow(_aligned(path_a, path_b, spell, parts_for(source, PART_BYTES, 12)), _BLOCK_DDL), "aligned")


def merged_pairs(blocks: DataFrame) -> DataFrame:
    """A row for each bucket: its pairs, each once, with links and documents added up over all blocks, whose documents are others."""
    dealt = blocks.where("bucket IS NOT NULL").select(*DEALT.names)
    return written(dealt.groupBy("bucket").applyInArrow(merged, MERGED_DDL), "pairs")


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, n_links, n_docs, best): how many links and documents hold a pair of ids, and whether no other ``a`` has more links with that ``b``."""
    return pairs.select("keys", "first", "second").mapInArrow(_pair_rows, "a int, b int, n_links long, n_docs long, best boolean")


def token_alignment(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", spell: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs of ids: rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups), one for
    each input row, and the table of ``pair_scores``.

    ``path_a`` is a byte-level vocabulary and cuts a blank and the text; ``path_b`` is a piece model that puts that
    blank itself. Both files are the same on every machine. Special tokens are never added, and their strings are plain text. Tokens are laid over
    the bytes: where both have an end a group ends, and a link is a pair of tokens that share a byte. A text that is null,
    empty, or whose tokens spell other bytes has no tokens: zeros, and '' for its groups. ``groups`` is null unless ``spell``
    asks for the groups themselves. Ids that are null or repeat keep their rows, each row counts in the pairs' scores; other columns are
    ignored; an empty table gives no rows. A text is never divided, so a block has at least one whole text.
    """
    blocks = aligned_blocks(docs, path_a, path_b, id_col, text_col, spell)
    pairs = merged_pairs(blocks)
    back = pairs.mapInArrow(_returned, "bucket int, own string, links binary, best binary")
    held = blocks.where("bucket IS NULL").select("block", "ids", *[n for n, _ in _SUMS], "planes")
    rows = held.groupBy("block").cogroup(back.groupBy("own")).applyInArrow(_scored, _ROWS_DDL)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"), pair_scores(pairs)
