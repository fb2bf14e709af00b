"""Operator 6: benchmark decontamination by templates whose numbers, names and units are typed slots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from classgauge.llm.words import Texts, distinct_spans, mix, owners, span_hashes, text_chunks, window_hashes
from classgauge.session import written

# Words that are units of measure.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l litre litres liter liters gallon gallons "
    "ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "c f k celsius fahrenheit kelvin degree degrees w kw watt watts j joule joules v volt volts a amp amps n newton newtons hz khz mhz ghz "
    "usd eur gbp dollar dollars euro euros cent cents percent kb mb gb tb".split()
)
NUMBER, NAME, UNIT, WORD = 1, 2, 3, 0
_NUMBER = re.compile(rb"[+\-]?[0-9][0-9.,:/]*%?")
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STOPS = (b".", b"!", b"?", b":")
_CODES = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
BLOCK_ITEMS_BYTES = 64 << 20  # of window hashes that are broadcast at a time


def _kinds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each distinct word: its type inside a sentence, whether it ends one, and its bare form."""
    kinds, stops, bare = np.zeros(len(words), np.int8), np.zeros(len(words), bool), []
    units = {u.encode() for u in UNITS}
    for i, word in enumerate(words):
        core = word.strip(_EDGE)
        stops[i] = word.rstrip(b"\"')]}").endswith(_STOPS)
        if _NUMBER.fullmatch(core):
            kinds[i] = NUMBER
        elif core.lower() in units:
            kinds[i] = UNIT
        elif core[:1].isupper() and len(core) > 1 and not core.isupper():
            kinds[i] = NAME
        bare.append(core.lower())
    return kinds, stops, bare


class Templates:
    """The template words of some texts: hashes, slot types, text of each, and the bare words."""

    def __init__(self, texts: Texts):
        starts, ends, firsts = texts.edges()
        words, number, _ = distinct_spans(texts.data, starts, ends)
        kinds, stops, self.bare = _kinds(words)
        sizes = np.fromiter(map(len, self.bare), np.int64, len(self.bare))
        joined = np.frombuffer(b"".join(self.bare), np.uint8)
        filled = np.flatnonzero(sizes)
        closes = np.cumsum(sizes)
        plain = np.zeros(len(words), np.uint64)
        plain[filled] = span_hashes(joined, (closes - sizes)[filled], closes[filled])
        owner = owners(firsts)
        opens = np.ones(len(number), bool)  # the first word of a sentence is no name
        opens[1:] = stops[number[:-1]] | (owner[1:] != owner[:-1])
        kind = kinds[number]
        kind = np.where((kind == NAME) & opens, WORD, kind)
        own = sizes[number] > 0  # a word of signs only is none
        self.number, self.kind, self.owner = number[own], kind[own], owner[own]
        self.codes = np.where(self.kind > 0, _CODES[self.kind], plain[self.number])

    def windows(self, width: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each window inside one text with enough words that aren't slots."""
        hashes = window_hashes(self.codes, width)
        n = len(hashes)
        if not n:
            return hashes, np.zeros(0, np.int64)
        words = np.concatenate(([0], np.cumsum(self.kind == WORD)))
        ok = (self.owner[:n] == self.owner[width - 1 :]) & (words[width:] - words[:-width] >= least_words)
        return hashes[ok], np.flatnonzero(ok)

    def slots(self, at: int, width: int) -> list[str]:
        return [self.bare[self.number[j]].decode("utf-8", "replace") for j in range(at, at + width) if self.kind[j] > 0]


_HITS = "doc_id long, text_key string, at int, window long, template string, slots array<string>"


def _windows(width: int, least_words: int, wanted):
    """Windows of each text with their template written out; with ``wanted`` only those whose hash is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            for texts in text_chunks(batch.column(2)):
                t = Templates(texts)
                hashes, at = t.windows(width, least_words)
                if keep is not None:
                    spot = np.minimum(np.searchsorted(keep, hashes), max(0, len(keep) - 1))
                    hit = keep[spot] == hashes if len(keep) else np.zeros(len(hashes), bool)
                    hashes, at = hashes[hit], at[hit]
                firsts = np.searchsorted(t.owner, np.arange(len(texts) + 1))
                owner = t.owner[at]
                ids = batch.column(0).slice(texts.first, len(texts)).take(pa.array(owner))
                keys = batch.column(1).slice(texts.first, len(texts)).take(pa.array(owner))
                names = ("", "<number>", "<name>", "<unit>")
                template = [" ".join(names[t.kind[j]] or t.bare[t.number[j]].decode("utf-8", "replace") for j in range(a, a + width)) for a in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, pa.array(at - firsts[owner], pa.int32()), pa.array(hashes.view(np.int64)), pa.array(template, pa.string()), pa.array([t.slots(a, width) for a in at.tolist()], pa.list_(pa.string()))],
                    ["doc_id", "text_key", "at", "window", "template", "slots"],
                )

    return run


def _keyed(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key of id and text, text); rows that are equal in both are one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text))
    return table.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("text_key"), text.alias("text"))


def template_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    width: int = 8, least_words: int = 5, least_windows: int = 3,
) -> DataFrame:
    """Rows (doc_id, text_key, item_id, n_windows, n_item_windows, n_slots, changed_slots, at, item_at).

    One row for each document and benchmark item that share at least ``least_windows`` windows (or all
    that the item has) of ``width`` template words in one alignment. Words lose case and signs at their ends;
    numbers, units and capitalised words inside a sentence are slots of that type, and a window has at least
    ``least_words`` other words. In an alignment, equal slot values of the item must stand for equal values
    in the document: windows with a value that breaks this are dropped. ``changed_slots`` counts slot
    values that differ, so re-parameterised questions have some. ``text_key`` names a document by id and
    text (rows equal in both are one document), so null and repeated ids are told apart. Items with
    fewer than ``width`` words, null or empty texts, and empty tables match nothing; other columns are ignored.

    Window hashes of the items are broadcast in blocks of a fixed size to sift the documents' windows where they
    are; what passes is joined with the items' windows on hash and template.
    """
    spark = docs.sparkSession
    items = _keyed(benchmark, item_id_col, item_text_col).mapInArrow(_windows(width, least_words, None), _HITS)
    items = written(items.select(F.col("doc_id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("at").alias("item_at"), "window", "template", F.col("slots").alias("item_slots")).dropDuplicates(["item_id", "item_key", "item_at"]), "items")
    sizes = items.groupBy("item_id", "item_key").agg(F.count("*").alias("n_item_windows"))
    blocks = 1 + items.count() * 8 // BLOCK_ITEMS_BYTES
    source = _keyed(docs, id_col, text_col)
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).select("window").distinct().toArrow()
        wanted = spark.sparkContext.broadcast(np.sort(part["window"].to_numpy().view(np.uint64)))
        hits = source.mapInArrow(_windows(width, least_words, wanted), _HITS)
        found = hits if found is None else found.unionByName(hits)
    found = written(found.distinct(), "hits")
    met = found.join(items, ["window", "template"]).withColumn("shift", F.col("at") - F.col("item_at"))
    same = ("doc_id", "text_key", "item_id", "item_key", "shift")
    pairs = F.explode(F.arrays_zip("item_slots", "slots"))
    values = met.select(*same, "at", pairs.alias("p")).select(*same, "at", F.col("p.item_slots").alias("said"), F.col("p.slots").alias("now"))
    uses = values.groupBy(*same, "said", "now").agg(F.count("*").alias("n"))
    ranked = uses.groupBy(*same, "said").agg(F.max(F.struct("n", "now"))["now"].alias("main"))
    broken = values.alias("v").join(ranked.alias("r"), [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*same, "said")])
    broken = broken.where("v.now <> r.main").select(*[F.col(f"v.{c}").alias(c) for c in (*same, "at")]).distinct()
    whole = met.alias("m").join(broken.alias("b"), [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*same, "at")], "left_anti")
    changed = F.size(F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != p["slots"]))
    runs_ = whole.groupBy(*same).agg(
        F.count("*").alias("n_windows"), F.max(F.size("slots")).alias("n_slots"), F.max(changed).alias("changed_slots"),
        F.min("at").alias("at"), F.min("item_at").alias("item_at"),
    )
    runs_ = runs_.alias("a").join(sizes.alias("s"), [F.col("a.item_id").eqNullSafe(F.col("s.item_id")), F.col("a.item_key") == F.col("s.item_key")]).select("a.*", "s.n_item_windows")
    best = runs_.where(F.col("n_windows") >= F.least(F.lit(least_windows), "n_item_windows"))
    best = best.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("n_windows", "n_item_windows", "n_slots", "changed_slots", "at", "item_at")).alias("b"))
    return best.select("doc_id", "text_key", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no benchmark item, all columns as they are."""
    bad = template_leaks(docs, benchmark, id_col, text_col, **options).select("text_key").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text))
    return docs.join(bad, key == bad["text_key"], "left_anti")
