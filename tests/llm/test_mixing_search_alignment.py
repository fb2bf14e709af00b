"""Operators 11 to 13 against brute force, on texts with nulls, repeats, ties, odd characters and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from classgauge.llm import sources
from classgauge.llm.alignment import aligned_blocks, merged_pairs, pair_scores, token_alignment
from classgauge.llm.bitmaps import Planes
from classgauge.llm.bpe import Bpe
from classgauge.llm.lexical import ranked_search, share_terms
from classgauge.llm.packing import packed, packed_keys, unpacked, unpacked_keys
from tests.llm.test_operators import BYTE_BPE, IDS, TEXTS, WORD, by_key, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MORE = ["a  b ", " lead", "tail ", "   ", "x▁y", "\x00nul", "<s> </s> <0x41>", "ﬁ ½ ①", "été", "\r\n\r\n", "A B\tC　D", "the same", "the same"]


@pytest.fixture(scope="module")
def texts():
    return [*TEXTS, *MORE]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use inside."""
    ids = [*IDS, *range(1000, 1000 + len(MORE))]
    rows = [(i, t, None if k % 7 == 3 else f"s{k % 4}", k, "x", k, "y", 1, "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    names = "doc_id long, text string, source string, size int, block string, target int, a string, copy int, row string"
    return spark.createDataFrame(rows, names).repartition(3)


def level_of(sizes, weights, share, most):
    """Targets by resharing what is over the caps, a source at a time."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + left * weights[s] / total >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += left * weights[s] / total
            break
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= full
    return target


def test_targets_fill_up_to_the_caps(spark):
    r = random.Random(3)
    for n, share, most in ((1, 1.5, 2.0), (9, 1.5, 2.0), (23, 0.3, 1.0), (6, 2.0, 2.0)):
        sizes = {f"q{i:02d}": int(10 ** r.uniform(0, 5)) for i in range(n)} | {None: 50, "a_empty": 0}
        rows = spark.createDataFrame([(s, v) for s, v in sizes.items()] + [("q00", 0)], "source string, size long")
        got = {x.source: x for x in sources.source_targets(rows, (3, 1, 2), share, most).collect()}
        names = sorted((s for s in sizes if s is not None)) + [None]
        want = level_of(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, share, most)
        assert {s: got[s].weight for s in names} == {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        assert all(abs(got[s].target - want[s]) <= 1e-6 * max(1, want[s]) for s in names)
        assert abs(sum(x.target for x in got.values()) - share * sum(sizes.values())) < 1e-3
    with pytest.raises(ValueError):
        sources.source_targets(rows, (3,), 3.0, 2.0)


def test_mix(spark, docs, texts, monkeypatch):
    plan = sources.mixing_plan(docs).collect()
    assert len(plan) == len(texts)
    for row in plan:
        size = len(WORD.findall(row.row.text or ""))
        assert row.size == size and row.taken == row.copies * size <= 2 * size
        assert math.floor(row.rate) <= row.copies <= math.floor(row.rate) + 1
        assert row.row.row == "z"  # the input's own column of that name
    again = sources.mixing_plan(docs.repartition(7)).collect()
    assert by_key((r.doc_id, r.taken) for r in plan) == by_key((r.doc_id, r.taken) for r in again)
    for broadcast in (1 << 30, 0):  # one plan for a small table of sources, another for a large one
        monkeypatch.setattr(sources, "BROADCAST_BYTES", broadcast)
        mixed = sources.mixed_documents(docs)
        assert mixed.columns == [*docs.columns, "copy_"]
        times = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
        want = collections.Counter()
        for r in plan:
            want[r.doc_id, r.row.text] += r.copies
        assert times == +want
    assert sources.mixing_plan(docs.where("false")).count() == 0


def test_taken_words_come_near_targets(spark):
    """With one source of a third of all rows, and one text that a third of them share."""
    rows = [(i, "hot words here" if i % 9 < 3 else "w " * (1 + i % 50), f"s{i % 5}" if i % 3 else "big") for i in range(30_000)]
    plan = sources.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 6 and all(abs(r.taken - r.target) < 0.05 * r.target for r in sums)


def brute_search(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, collections.Counter(t), len(t)) for i, t in held if t]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_search_is_that_of_brute_force(spark, docs, texts, monkeypatch):
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(1, sentence(30, 1)), (2, sentence(25, 1)), (2, "THE of the"), (3, None), (4, ""), (5, "nowhereatall"), (6, "word"), (None, "日本語 end"), (1, sentence(30, 1)), (8, TEXTS[17])]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    want = by_key(brute_search(own, [x for x in items if x[1]], 10))
    assert by_key(ranked_search(docs, table).collect()) == want
    for name, value in (("ITEM_BYTES", 200), ("CELLS", 1)):  # several blocks of items; one document at a time
        monkeypatch.setattr(f"classgauge.llm.lexical.{name}", value)
        assert by_key(ranked_search(docs, table).collect()) == want
    assert ranked_search(docs.where("false"), table).count() == 0 == ranked_search(docs, table.where("false")).count()


def test_shared_terms_are_summed_once():
    r = random.Random(2)
    common = list(range(12))
    items = [np.array(r.choices(range(12, 80), k=20) + common + [3, 3]) for _ in range(40)] + [np.array([5]), np.zeros(0, np.int64)]
    plan = share_terms(items)
    parts = [[t] for t in plan.term.tolist()]
    for a, b in plan.pairs.tolist():
        parts.append(parts[a] + parts[b])
    assert [sorted(t for s in row.tolist() for t in parts[s]) for row in plan.items] == [sorted(x.tolist()) for x in items]
    assert plan.additions < 0.7 * sum(len(x) - 1 for x in items if len(x))
    done = set(range(len(plan.term)))
    for level in plan.levels():
        assert all(x in done for x in plan.pairs[level].ravel().tolist())
        done |= set((len(plan.term) + level).tolist())
    assert len(done) == len(plan.term) + len(plan.pairs)


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    pieces, spelled = sentencepiece.SentencePieceProcessor(model_file=PIECES), Bpe(BYTE_BPE).bytes
    piece = lambda i: bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    rows, counts, held = [], collections.Counter(), collections.Counter()
    for text in texts:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a, bytes_b = [spelled[i] for i in a], [piece(i) for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append(([], [], [], []))
            continue
        cover_a, cover_b = ([k for k, x in enumerate(own) for _ in x] for own in (bytes_a, bytes_b))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(cover_a, cover_b, strict=True)))]
        groups, last = [([], [])], (0, 0)
        ends = lambda own: {x: k for k, x in enumerate(np.cumsum([len(t) for t in own]).tolist(), 1)}
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        groups = []
        for at in sorted(ends_a.keys() & ends_b.keys()):
            groups.append((a[last[0] : ends_a[at]], b[last[1] : ends_b[at]]))
            last = ends_a[at], ends_b[at]
        counts.update(links)
        held.update(set(links))
        rows.append((a, b, groups, links))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest, text))
    return out, counts, held, top


def test_alignment_is_that_of_brute_force(docs, texts, monkeypatch):
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, counts, held, top = brute_alignment([t for _, t in own])
    assert sum(1 for (_, t), w in zip(own, want, strict=True) if t and not w[0]) == 1  # the one whose blank sign is spelled as a blank
    for size in (2 << 20, 1000):  # the long texts are longer than such a block
        monkeypatch.setattr("classgauge.llm.alignment.BLOCK_BYTES", size)
        rows, pairs = token_alignment(docs, BYTE_BPE, PIECES, spell=True)
        assert by_key(rows.collect()) == by_key((i, *w) for (i, _), w in zip(own, want, strict=True))
        assert by_key(pairs.collect()) == by_key((a, b, n, held[a, b], n == top[b]) for (a, b), n in counts.items())
    empty, pairs = token_alignment(docs.where("false"), BYTE_BPE, PIECES)
    assert empty.count() == 0 == pairs.count()


def test_pair_scores_do_not_depend_on_blocks(spark, docs, monkeypatch):
    """One text that a third of all rows hold."""
    many = docs.select("doc_id", "text").unionByName(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("the hot text, again and again").alias("text")))
    one = by_key(pair_scores(merged_pairs(aligned_blocks(many.coalesce(1), BYTE_BPE, PIECES))).collect())
    monkeypatch.setattr("classgauge.llm.alignment.BLOCK_BYTES", 500)
    assert by_key(pair_scores(merged_pairs(aligned_blocks(many.repartition(5), BYTE_BPE, PIECES))).collect()) == one


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_packed_numbers_come_back(n):
    r = np.random.default_rng(n)
    keys = np.unique(np.concatenate((r.integers(-(2**63), 2**63 - 1, n // 2), r.integers(0, 300, n - n // 2) << 40)))
    assert unpacked_keys(packed_keys(keys)).tolist() == keys.tolist()
    counts = r.integers(-(2**63), 2**63 - 1, n)
    assert unpacked(packed(counts)).tolist() == counts.tolist()
    runs = np.sort(r.integers(0, 1 << 20, n))
    assert unpacked_keys(packed_keys(runs)).tolist() == runs.tolist()
    assert n < 100 or len(packed_keys(runs)) < 0.4 * runs.nbytes


@pytest.mark.parametrize("n_docs", [1, 9, 4000])
def test_planes_add_up(n_docs):
    r = np.random.default_rng(n_docs)
    n_keys = 40
    counts = r.integers(0, 9, (n_keys, n_docs)) * (r.random((n_keys, n_docs)) < np.linspace(0, 1, n_keys)[:, None] ** 3)
    keys, own = np.nonzero(counts)
    planes = Planes.unpacked(Planes.of(keys, own, counts[keys, own], n_keys, n_docs).packed())
    scores = r.integers(0, 1 << 40, n_keys)
    assert planes.link_counts().tolist() == counts.sum(1).tolist()
    assert planes.doc_counts().tolist() == (counts > 0).sum(1).tolist()
    assert planes.totals(scores).tolist() == (scores @ counts).tolist()
    with pytest.raises(ValueError):
        Planes.of(keys, own, counts[keys, own], n_keys, 1 << 17)
