"""Operator 7: byte-level BPE by a lexicon of frequent words, with exact merges for the rest."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.llm.lexicon import Lexicon, compile_lexicon
from classgauge.llm.words import Texts, distinct_spans, text_chunks
from classgauge.session import written

LEXICON_WORDS = 1 << 16  # at most so many words in the lexicon
WORD_BYTES = 64  # of a word in the lexicon, at most: with the number of words, the bound of what is broadcast
CACHED = 1 << 16  # white space and words whose ids a task remembers
LONG_WORD = 200
NO_RANK = 1 << 30
BLOCK_BYTES = 4 << 20

# The pattern that the vocabulary's words were cut with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLANK, LETTER, DIGIT, SIGN, HARD = range(5)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[0x80:] = HARD
KINDS[[0x20, *range(0x09, 0x0E)]] = BLANK
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5]] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[[0x27, 0x3C]] = HARD


@cache
def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies: themselves where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """The merges of one byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in held["model"]["vocab"].items()}
        merges = [[raw(x) for x in (p.split(" ") if isinstance(p, str) else p)] for p in held["model"]["merges"]]
        order = np.argsort(keys := np.array([self.ids[a] << 32 | self.ids[b] for a, b in merges], np.int64))
        self.pairs, self.pair_ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.ids[a + b] for a, b in merges], np.int32)
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.bytes = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.unusual = re.compile("[^\t\n\r -~ -ſ]")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        """The rank of each pair of parts, for words that are merged one by one."""
        return {(self.bytes[int(k) >> 32], self.bytes[int(k) & 0xFFFFFFFF]): int(r) for k, r in zip(self.pairs, self.pair_ranks, strict=True)}

    def pretokens(self, text: str) -> list[bytes]:
        """The pieces of a text that merges never cross. Rare characters are classed by the library itself."""
        if not self.unusual.search(text):
            return [w.encode() for w in self.words.findall(text)]
        letters = _byte_letters()
        return [bytes(letters[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def sections(self, text: str) -> list[str]:
        """The text cut at special strings, which take every second place."""
        return self.split.split(text) if self.split else [text]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (int32, as bytes) by its merges: the lowest rank first, leftmost first.

        Words of one length go together. Every round merges one pair in each word that
        still has one, so the words of a round always have equally many parts.
        """
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            if length > LONG_WORD:
                for i in own.tolist():
                    out[i] = self._merge_long(words[i])
                continue
            parts = self.first[np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8).reshape(-1, length)]
            ranks = self._ranks(parts[:, :-1], parts[:, 1:])
            while True:
                n, width = parts.shape
                at = ranks.argmin(1) if width > 1 else np.zeros(n, np.int64)
                best = ranks[np.arange(n), at] if width > 1 else np.full(n, NO_RANK)
                done = best == NO_RANK
                for i, ids in zip(own[done].tolist(), parts[done], strict=True):
                    out[i] = ids.tobytes()
                if done.all():
                    break
                own, parts, ranks, at, best = own[~done], parts[~done], ranks[~done], at[~done], best[~done]
                row = np.arange(len(own))
                parts[row, at] = self.made[best]
                parts = parts[np.arange(width) != (at + 1)[:, None]].reshape(len(own), width - 1)
                ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(own), width - 2)
                for spot in (at - 1, at):
                    ok = (spot >= 0) & (spot < width - 2)
                    ranks[row[ok], spot[ok]] = self._ranks(parts[row[ok], spot[ok]], parts[row[ok], spot[ok] + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NO_RANK)

    def _merge_long(self, word: bytes) -> bytes:
        """The same with a heap and links, for words so long that a round per merge would be slow."""
        import heapq

        n = len(word)
        ranks = self.ranks
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([self.ids[p] for p in parts if p is not None], np.int32).tobytes()


@cache
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def segments(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that can be encoded apart and tile each text: starts, ends, each text's first, and
    which are surely one pre-token.

    White space with the word after it never joins what stands around it. Such a span of plain
    letters (ASCII, U+00C0 to U+017F), digits and signs is cut on where the pattern cuts it: between
    letters, digits and signs, before the last white space, and after it unless that is a
    blank. Apostrophes, ``<`` and other characters leave it whole, for the pattern itself; a text with
    white space beyond ASCII is one span, as such a run may start inside a word.
    """
    data, offsets = texts.data, texts.offsets
    n = len(data)
    _, ends, firsts = texts.edges()
    after = np.concatenate((data[1:], np.zeros(2, np.uint8)))
    odd = (data >= 0x1C) & (data <= 0x1F)
    odd |= (data == 0xC2) & ((after[:n] == 0x85) | (after[:n] == 0xA0))
    odd |= ((data == 0xE1) & (after[:n] == 0x9A)) | ((data == 0xE3) & (after[:n] == 0x80))
    third = after[1 : n + 1]
    odd |= (data == 0xE2) & (after[:n] == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
    odd |= (data == 0xE2) & (after[:n] == 0x81) & (third == 0x9F)
    total = np.concatenate(([0], np.cumsum(odd)))
    whole = total[offsets[1:]] > total[offsets[:-1]]

    cut = np.zeros(n + 1, bool)  # a span ends here
    cut[ends] = True
    cut[ends[np.repeat(whole, np.diff(firsts))]] = False
    cut[offsets[1:]] = True
    cut[0] = False
    bounds = np.flatnonzero(cut)

    kind = KINDS[data]
    kind[1:][(data[1:] >= 0x80) & (data[1:] < 0xC0) & (kind[:-1] == LETTER)] = LETTER
    kind[1:][((data[1:] == 0x97) | (data[1:] == 0xB7)) & (data[:-1] == 0xC3)] = HARD
    hard = np.concatenate(([0], np.cumsum((kind == HARD) | odd)))
    if len(bounds):
        more = np.zeros(n + 1, bool)
        space = kind == BLANK
        more[1:n] = ~space[1:] & ~space[:-1] & (kind[1:] != kind[:-1])
        opens = np.flatnonzero(space[:-1] & ~space[1:]) + 1  # where a word follows white space
        more[opens - 1] = True
        more[opens[data[opens - 1] != 0x20]] = True
        starts = np.concatenate(([0], bounds[:-1]))
        easy = hard[bounds] == hard[starts]
        cut |= more & np.append(np.repeat(easy, bounds - starts), False)
        cut[0] = False
    ends = np.flatnonzero(cut)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return starts, ends, np.searchsorted(starts, offsets), hard[ends] == hard[starts]


def _span_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(0), BLOCK_BYTES):
            starts, ends, _, _ = segments(texts)
            spans, number, _ = distinct_spans(texts.data, starts, ends)
            counts = np.bincount(number, minlength=len(spans))
            yield pa.RecordBatch.from_arrays([pa.array(spans, pa.binary()), pa.array(counts, pa.int64())], ["span", "n"])


def _words_of(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            found = Counter()
            for span, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for section in bpe.sections(span.decode())[::2]:
                    for word in bpe.pretokens(section):
                        if len(word) <= WORD_BYTES:
                            found[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return run


def frequent_words(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = LEXICON_WORDS) -> list[bytes]:
    """The pre-tokens with the highest counts over all texts, at most ``limit``.

    The lowest count that is taken comes from a small table of how many words have a count
    in each range, so no more than ``limit`` words reach the driver.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    spans = texts.mapInArrow(_span_counts, "span binary, n long").groupBy("span").agg(F.sum("n").alias("n"))
    counts = spans.mapInArrow(_words_of(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "words")
    held, least = 0, None
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # a few hundred levels
        held += row["count"]
        if held > limit:
            break
        least = row["level"]
    return [] if least is None else [bytes(r.word) for r in counts.where(F.col("level") >= least).select("word").collect()]


def _encoded(path: str, image, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = _bpe(path), Lexicon(image.value)
        known: dict[bytes, bytes] = {}
        special = {s: np.array([i], np.int32).tobytes() for s, i in bpe.special.items()}

        def ids_of(spans: list[bytes], single: list[bool]) -> list[bytes]:
            """From the lexicon; by merges where a word isn't in it."""
            words = [s for s, one in zip(spans, single, strict=True) if one and s not in known]
            cuts: dict[bytes, list] = {}
            for span in [s for s, one in zip(spans, single, strict=True) if not one and s not in known]:
                cuts[span] = []
                for i, section in enumerate(bpe.sections(span.decode())):
                    cuts[span] += [special[section]] if i % 2 else [(w,) for w in bpe.pretokens(section)] if section else []
            words += {x[0] for own in cuts.values() for x in own if type(x) is tuple}.difference(words)
            found = lexicon.numbers(words)
            ids = dict.fromkeys(words, b"")
            for w, n in zip(words, found.tolist(), strict=True):
                if n >= 0:
                    ids[w] = lexicon.ids[lexicon.spans[n] : lexicon.spans[n + 1]].tobytes()
            unseen = [w for w, n in zip(words, found.tolist(), strict=True) if n < 0]
            ids.update(zip(unseen, bpe.merge_all(unseen), strict=True))
            fresh = {s: b"".join([ids[x[0]] if type(x) is tuple else x for x in own]) for s, own in cuts.items()}
            out = [known.get(s) or fresh.get(s) or ids.get(s, b"") for s in spans]
            if len(known) >= CACHED:
                known.clear()
            known.update((s, x) for more in (ids, fresh) for s, x in more.items() if len(s) <= WORD_BYTES)
            return out

        for batch in batches:
            for texts in text_chunks(batch.column(batch.num_columns - 1), BLOCK_BYTES // 2):
                starts, ends, firsts, single = segments(texts)
                spans, number, first = distinct_spans(texts.data, starts, ends)
                ids = ids_of(spans, single[first].tolist())
                opens = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int64)
                lengths = np.diff(opens)[number]
                ends_at = np.concatenate(([0], np.cumsum(lengths)))
                spots = np.repeat(opens[number] - ends_at[:-1], lengths) + np.arange(ends_at[-1])
                flat = np.frombuffer(b"".join(ids), np.int32)[spots]
                kept = pa.ListArray.from_arrays(pa.array(ends_at[firsts].astype(np.int32)), pa.array(flat))
                out, names = [*[c.slice(texts.first, len(texts)) for c in batch.columns[:-1]], kept], [*batch.schema.names[:-1], "ids"]
                if back:
                    out, names = [*out, pa.array([_spelled(bpe.bytes, x) for x in kept], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LEXICON_WORDS, keep: tuple = (), decode: bool = False) -> DataFrame:
    """Rows (doc_id, the columns ``keep``, ids), one for each input row, ids that are null or repeat included; with
    ``decode`` also ``decoded``, what the ids spell, from the same pass.

    ``vocabulary`` is the path of a byte-level vocabulary file, the same on every machine. The
    ids are those its library gives without added special tokens, truncation or padding; special
    strings inside a text give their own id, as there by default. A null or empty text has an
    empty list; an empty table gives no rows; other columns are ignored.

    The words that all texts have most often are compiled with their ids into a
    shared-suffix automaton, which every task maps into memory; other words go through
    the merges. What is broadcast is bounded by ``limit`` words of ``WORD_BYTES`` bytes.
    """
    bpe = _bpe(vocabulary)
    words = frequent_words(docs, vocabulary, text_col, limit)
    image = compile_lexicon(dict(zip(words, bpe.merge_all(words), strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast(image)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_encoded(vocabulary, shared, decode), _fields(source.dtypes[:-1], "ids array<int>" + ", decoded string" * decode))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _bpe(path).bytes
        for batch in batches:
            texts = [_spelled(held, ids) for ids in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def _spelled(held: dict[int, bytes], ids: pa.ListScalar) -> str | None:
    if not ids.is_valid:
        return None
    return b"".join([held.get(i, b"") for i in ids.values.to_numpy(zero_copy_only=False).tolist()]).decode("utf-8", "replace")


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple = ()) -> DataFrame:
    """Rows (doc_id, the columns ``keep``, ids, text): each id list with the text its bytes spell, special strings kept.

    Bytes that are not UTF-8 become U+FFFD, and ids outside the vocabulary spell nothing, as in
    the library. A null list has a null text.
    """
    source = encoded.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(_decoded(vocabulary), _fields(source.dtypes, "text string"))


def _fields(dtypes: list[tuple[str, str]], last: str) -> str:
    return "".join(f"`{n}` {t}, " for n, t in dtypes) + last
