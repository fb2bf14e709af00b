"""Operators against brute force, on texts with nulls, repeats, ties and odd characters."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from classgauge.llm import words as W
from classgauge.llm.bpe import bpe_decode, bpe_encode
from classgauge.llm.components import connected_components
from classgauge.llm.jaccard import shingle_components
from classgauge.llm.lexicon import Lexicon, compile_lexicon
from classgauge.llm.linedup import dedup_lines
from classgauge.llm import mixing
from classgauge.llm.mixing import lm_scores
from classgauge.llm.perplexity import ORDER, SYMBOLS, KneserNey, _quartiles, code_points, grams, quality_verdicts, symbols
from classgauge.llm.shards import _repairs, balanced_shards
from classgauge.llm.templates import template_leaks, without_leaks
from classgauge.llm.tokencount import token_counts
from classgauge.llm import toxicity
from classgauge.llm.toxicity import BlockMaxIndex, Vectors, first_examples, toxicity_scores
from classgauge.llm.urlfilter import filtered_urls

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

random.seed(5)
VOCAB = ["the", "of", "Straße", "naïve", "don't", "3,14", "x<|endoftext|>y", "日本語", "a\u00a0b", "Ünï", "co-op", "😀", "end.", "İx", "ΣΑΣ"] + [
    "".join(random.choices("abcdeionrst", k=random.randint(2, 9))) for _ in range(200)
]


def sentence(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCAB) + r.choice([" ", " ", " ", "  ", "\n", " \t", "\n\n "]) for _ in range(n))


BASE = sentence(120, 1)
TEXTS = [
    None, "", " \n\t ", "one", "one two three four", "  lead  and   trail  ", "\u00a0\n x\u2003\n y", "<|endoftext|>", "it's we'll 'S", "\x1c a \x85 b",
    BASE, BASE, BASE.replace("the", "teh", 1), BASE + " more", sentence(80, 2), sentence(60, 3), "word " * 4000, sentence(3000, 4), "日本語" * 50, "é" * 300,
    *[sentence(40, s) for s in range(10, 30)],
]
IDS = [None, *range(1, len(TEXTS) - 1), 5]  # one null, one twice


@pytest.fixture(scope="module")
def docs(spark):
    """The texts with columns whose names operators use inside."""
    rows = [(i, t, "en" if k % 3 else None, float(k), b"x") for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row double, node binary").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_words_are_cut_as_by_pattern():
    for texts in W.text_chunks(pa.array(TEXTS), 500):
        starts, ends, firsts = texts.edges()
        for d in range(len(texts)):
            own = TEXTS[texts.first + d] or ""
            cut = [texts.data[a:b].tobytes().decode() for a, b in zip(starts[firsts[d] : firsts[d + 1]], ends[firsts[d] : firsts[d + 1]], strict=True)]
            assert cut == WORD.findall(own)
    a, b = (W.span_hashes(np.frombuffer(x, np.uint8), np.array([s]), np.array([s + 3])) for x, s in ((b"..abc", 2), (b"abc", 0)))
    assert a == b


@pytest.mark.parametrize(("path", "which"), [(WORD_BPE, 1), (BYTE_BPE, 7)])
def test_tokens_are_those_of_the_library(spark, docs, empty, path, which):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    if which == 1:
        got = token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens").collect()
        assert by_key(got) == by_key((i, len((t or "").encode()), len(w)) for i, t, w in zip(IDS, TEXTS, want, strict=True))
        assert token_counts(empty, path).count() == 0
        return
    for limit in (0, 50, 1 << 16):  # with an empty, a small and a full lexicon
        got = bpe_encode(docs, path, limit=limit, decode=True).collect()
        assert by_key((r.doc_id, r.ids, r.decoded) for r in got) == by_key((i, w, library.decode(w, skip_special_tokens=False)) for i, w in zip(IDS, want, strict=True))
    rows = spark.createDataFrame([(1, [50256, 72]), (2, None), (3, []), (4, [220, 10**7]), (5, [128])], "doc_id long, ids array<int>")
    back = {r.doc_id: r.text for r in bpe_decode(rows, path).collect()}
    assert back[1] == "<|endoftext|>i" and back[2] is None and back[3] == "" and back[4] == " " and back[5] == library.decode([128], skip_special_tokens=False)
    assert bpe_encode(empty, path).count() == 0


def test_lexicon_finds_its_words_only():
    words = {w.encode(): np.arange(i % 4, dtype=np.int32).tobytes() for i, w in enumerate(dict.fromkeys(VOCAB))}
    lexicon = Lexicon(compile_lexicon(words))
    asked = [*words, b"", b"no", b"the ", b"th", "Stra".encode()]
    numbers = lexicon.numbers(asked)
    assert numbers.tolist() == [sorted(words).index(w) if w in words else -1 for w in asked]
    assert all(lexicon.ids[lexicon.spans[n] : lexicon.spans[n + 1]].tobytes() == words[w] for w, n in zip(asked, numbers, strict=True) if n >= 0)
    suffixes = compile_lexicon({(a + "ings").encode(): b"" for a in "abcdefgh"})
    assert np.frombuffer(suffixes, np.int32, 4).tolist()[1:3] == [6, 12]  # states and edges: one tail for all


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return by_key((i, len(s), find(i)) for i, s in sets)


def test_jaccard_components(spark, docs, empty):
    own = [(i, t) for i, t in zip(IDS, TEXTS, strict=True) if i is not None]
    got = by_key(shingle_components(docs).collect())
    want = brute_components([(i, t) for i, t in own if i != 5])
    assert [x for x in got if x[0] != 5] == want
    assert {x[2] for x in got if x[0] == 5} == {5} and len(got) == len(own)
    assert shingle_components(empty).count() == 0


def test_jaccard_chains_and_centres(spark):
    """Copies that link only through others, and a centre that links what is apart."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        edit = list(base)
        for k in r.sample(range(80), r.choice([1, 2, 3])):
            edit[k] = f"e{i}_{k}"
        rows.append((i, " ".join(edit)))
    rows += [(100 + i, " ".join(base[i * 2 : i * 2 + 40])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_key(shingle_components(docs).collect()) == brute_components(rows)


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(1, 2), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(path).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1}


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    hit = {j + k for j in range(len(w) - 2) for k in range(3) if c[tuple(w[j : j + 3])] > 1}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(hit)


def test_quality_counts_and_bands(docs, empty):
    got = quality_verdicts(docs, least=5).collect()
    counts = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    want = [(i, *(c := base_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in zip(IDS, TEXTS, strict=True)]
    assert by_key(counts) == by_key(want)
    for r in got:
        assert r.kept == (not r.base_failed and r.low <= r.bits <= r.high)
    assert quality_verdicts(empty).count() == 0


def test_quality_bands_with_copies_and_rare_languages(spark):
    """Copies don't narrow a band, and a language of a few texts isn't judged by the others."""
    rows = [(i, sentence(70, i), "en") for i in range(20)] + [(100 + i, sentence(70, 500), "en") for i in range(90)]
    rows += [(1000 + i, sentence(70, 1000 + i), "fr") for i in range(1500)]  # so that the model isn't one of the copies
    other = str.maketrans("abcdeionrst", "qxzjkvwmpyh")
    rows += [(300 + i, sentence(70, 300 + i).translate(other), "rare") for i in range(3)]
    got = quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("NOT base_failed").collect()
    for ids in (range(20), range(100, 190), range(300, 303)):
        own = [r.kept for r in got if r.doc_id in ids]
        assert own and sum(own) >= 0.9 * len(own), ids
    values = [(lang, abs(random.Random(k).gauss(2.3, 0.01))) for k, lang in enumerate(["a"] * 400 + ["b"] * 7 + ["c"])]
    values += [("d", 1.5 + 1e-7 * k) for k in range(101)]
    found = {r.lang_: (r.n, r.q1, r.q3) for r in _quartiles(spark.createDataFrame(values, "lang_ string, bits double")).collect()}
    for lang in "abcd":
        own = sorted(v for x, v in values if x == lang)
        assert found[lang] == (len(own), *(own[math.ceil(q * len(own)) - 1] for q in (0.25, 0.75)))


def test_kneser_ney_adds_up_to_one():
    (texts,) = W.text_chunks(pa.array([t for t in TEXTS if t][:12]))
    keys, counts = np.unique(grams(texts)[0], return_counts=True)
    model = KneserNey(keys, counts)
    for context in [*(keys[::150] // SYMBOLS), 5 * SYMBOLS + 7, SYMBOLS ** (ORDER - 1) - 1]:
        assert np.sum(10 ** model.log10(context * SYMBOLS + np.arange(SYMBOLS))) == pytest.approx(1, abs=1e-4)


def kneser_ney(corpus, order, first):
    """Log2 probabilities by interpolated modified Kneser-Ney, from dictionaries, of tuples of any symbols; ``first`` is the uniform one below all orders."""
    counts = [collections.Counter(g for text in corpus for g in text)]
    for _ in range(order - 1):
        counts.append(collections.Counter(g[1:] for g in counts[-1]))
    cuts, contexts = [], []
    for c in counts:
        t = [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
        y = t[0] / max(1, t[0] + 2 * t[1])
        cuts.append([0, *(min(k, max(0.1, k - (k + 1) * y * t[k] / max(1, t[k - 1]))) for k in (1, 2, 3))])
        contexts.append(collections.defaultdict(list))
        for g, n in c.items():
            contexts[-1][g[:-1]].append(n)

    def p(g, at=0):
        if at == order:
            return first
        sizes = contexts[at].get(g[:-1])
        if not sizes:
            return p(g[1:], at + 1)
        n = counts[at][g]
        return (n - cuts[at][min(n, 3)] + sum(cuts[at][min(k, 3)] for k in sizes) * p(g[1:], at + 1)) / sum(sizes)

    return lambda g: math.log2(p(g))


def test_perplexity_against_dictionaries(spark):
    """Every text is judged by the texts of the other half, all code points told apart."""
    texts = sorted({t for t in TEXTS if t} | {sentence(60, s) for s in range(100, 130)} | {"Слово за словом " * 9, "слова Слово за", "次の言葉は " * 7})
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string").repartition(4)
    keys = {r.doc_id: r.h & 1 for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    code = lambda t: [tuple(("\0" * (ORDER - 1) + t)[i : i + ORDER]) for i in range(len(t))]
    models = [kneser_ney([code(t) for i, t in enumerate([*texts, texts[0]]) if keys[i] != half], ORDER, 1 / SYMBOLS) for half in (0, 1)]
    for r in quality_verdicts(docs, lang_col=None).collect():
        text = [*texts, texts[0]][r.doc_id]
        each = [-models[keys[r.doc_id]](g) for g in code(text)]
        begins = {m.start() for m in WORD.finditer(text)}
        steps = [x for i, x in enumerate(each) if i in begins]
        assert r.char_bits == pytest.approx(sum(each) / len(each), abs=0.02)
        assert r.step_bits == pytest.approx(sum(steps) / max(1, len(steps)), abs=0.02)
        assert r.bits == r.char_bits + r.step_bits


def test_code_points_have_their_own_symbols():
    points = [0, 9, 65, 97, 959, 960, 961, 1983, 1984, 0x3042, 0xD7FF, 0xE000, 63423, 63424, 63425, 0x1F600, 0x10FFFF]
    (texts,) = W.text_chunks(pa.array([chr(p) for p in points]))
    got, firsts, size = symbols(*code_points(texts))
    each = [tuple(got[a + ORDER - 1 : b].tolist()) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    assert len(set(each)) == len(points) and [len(x) for x in each] == size.tolist() == [1] * 5 + [2] * 8 + [3] * 4
    assert all(0 < x[0] < SYMBOLS and min(x) >= 0 and max(x) < SYMBOLS for x in each)
    heads = {n: {x[0] for x in each if len(x) == n} for n in (1, 2, 3)}
    assert not heads[1] & heads[2] and not heads[2] & heads[3] and not heads[1] & heads[3]
    broken = W.Texts(np.frombuffer(b"a\xffb\xd0", np.uint8), np.array([0, 2, 4]), 0)
    assert code_points(broken)[0].tolist() == [97, 0xDCFF, 98, 0xDCD0] and code_points(broken)[1].tolist() == [0, 2, 4]


def test_texts_in_random_order_are_rejected(spark):
    def prose(seed):
        r = random.Random(seed)
        return " ".join(" ".join(r.choices(VOCAB[15:], k=r.randint(4, 9))).capitalize() + "." for _ in range(r.randint(20, 60)))

    mixed = []
    for seed in range(20):
        words = prose(1000 + seed).split()
        random.Random(seed).shuffle(words)
        mixed.append((1000 + seed, " ".join(words), "en"))
    rows = [(seed, prose(seed), "en") for seed in range(400)] + mixed
    got = [(r.doc_id, r.kept) for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_repeat_percent=100).collect()]
    assert sum(kept for i, kept in got if i < 400) >= 380
    assert not any(kept for i, kept in got if i >= 1000)


def test_lm_scores(docs, empty):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = lm_scores(docs, held).collect()
    rows = [((WORD.findall((t or "").translate(LOWER))), i is not None and zlib.crc32(str(i).encode()) % 7 == 2, i) for i, t in zip(IDS, TEXTS, strict=True)]
    c = collections.Counter(x for w, h, _ in rows if not h for x in [*w, None])
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 6)) for w, h, i in rows]
    assert by_key((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == by_key(want)
    assert all(r.score < 0 for r in got)
    assert lm_scores(empty, held).count() == 0


def canonical_text(text):
    return " ".join(WORD.findall((text or "").translate(LOWER))).encode() + b"\n"


def test_canonical_texts_and_their_runs():
    for texts in W.text_chunks(pa.array(TEXTS), 4000):
        data, bounds = mixing.canonical(texts)
        own = [canonical_text(t) for t in TEXTS[texts.first : texts.first + len(texts)]]
        assert data.tobytes() == b"".join(own) and np.diff(bounds).tolist() == [len(x) for x in own]
        want = [int.from_bytes(bytes(reversed((b"\n" * 6 + x)[i : i + 6])) + x[i : i + 1], "big") for x in own for i in range(len(x))]
        got = [k for low in range(0, len(data), 37) for k in mixing.byte_runs(data, bounds, low, min(low + 37, len(data)))[0].tolist()]
        assert got == want  # pieces shorter than most texts


def brute_states(keys, counts, order):
    """The counts of ones and of all, by context and the bits so far."""
    nodes = collections.defaultdict(lambda: [0, 0])
    for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
        context = key >> 8 * (7 - order)
        for place in range(8):
            node = nodes[context, place, (key & 0xFF) >> (8 - place)]
            node[0] += n * ((key >> (7 - place)) & 1)
            node[1] += n
    return nodes


def test_predictors_know_whole_contexts():
    """States, gates and scores against dictionaries; over all bytes after a context the probabilities sum to 1."""
    (texts,) = W.text_chunks(pa.array([sentence(300, 7), "thath that", ""]))
    data, bounds = mixing.canonical(texts)
    keys, n = W.runs(np.sort(mixing.byte_runs(data, bounds, 0, len(data))[0]))
    contexts = [int(keys[5]) >> 8, int(keys[len(keys) // 2]) >> 8, 0x0102030405060 << 4 & ~0xFF | 0x31]
    asked = np.array([c << 8 | b for c in contexts for b in range(256)])
    every = np.unique(np.concatenate((keys, asked)))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, keys)] = n
    low = mixing._counted([mixing.context_keys(keys, 2)], [n])
    predictors = mixing.Predictors(every, counts, low)
    known = [brute_states(keys, n, k) for k in range(1, 7)]
    r = np.random.default_rng(1)
    weights, refined = r.normal(0.3, 0.2, (mixing.GATES, 7)), np.sort(r.random((mixing.GATES, mixing.BINS)), axis=1)
    want = np.zeros(len(every))
    for place, bits, states, gates in predictors.bits():
        for i in r.choice(len(every), 300, replace=False).tolist():
            key, longest, met = int(every[i]), 0, 0
            for k in range(1, 7):
                ones, total = known[k - 1].get((key >> 8 * (7 - k), place, (key & 0xFF) >> (8 - place)), (0, 0))
                state = round(math.log((ones + 0.3) / (total - ones + 0.3)) * 12) if total else mixing.UNKNOWN
                assert states[k - 1, i] == max(state, -127) or not total and states[k - 1, i] == mixing.UNKNOWN
                longest, met = (k, total) if total else (longest, met)
            level = min(int(math.log2(max(met, 1))), 3)
            assert gates[i] == (longest * 4 + level) * 8 + place and bits[i] == key >> (7 - place) & 1
    scores = dict(zip(every.tolist(), mixing.Mixer(weights, refined).log10(predictors).tolist(), strict=True))
    for c in contexts:
        assert abs(sum(10 ** scores[c << 8 | b] for b in range(256)) - 1) < 1e-9


def test_scores_do_not_depend_on_blocks(spark, docs, monkeypatch):
    """Long texts in pieces, several blocks and buckets: the same scores, and those of a dictionary model of the same weights."""
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    mixer = mixing.Mixer(np.full((mixing.GATES, 7), 0.3), np.tile(np.linspace(0.01, 0.99, mixing.BINS), (mixing.GATES, 1)))
    monkeypatch.setattr(mixing, "learned_mixer", lambda *_: mixer)
    one = by_key((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 2)) for r in lm_scores(docs.coalesce(1), held).collect())
    for name, value in (("BLOCK_BYTES", 3000), ("PIECE_BYTES", 700), ("PART_BYTES", 1 << 14)):
        monkeypatch.setattr(mixing, name, value)
    assert by_key((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 2)) for r in lm_scores(docs.repartition(4), held).collect()) == one
    rows = list(zip(IDS, (canonical_text(t) for t in TEXTS), strict=True))
    runs = lambda x: [int.from_bytes(bytes(reversed((b"\n" * 6 + x)[i : i + 6])) + x[i : i + 1], "big") for i in range(len(x))]
    counts = collections.Counter(k for i, x in rows if not (i is not None and i % 3 == 0) for k in runs(x))
    keys = np.array(sorted({k for _, x in rows for k in runs(x)}))
    n = np.array([counts[int(k)] for k in keys])
    predictors = mixing.Predictors(keys, n, mixing._counted([mixing.context_keys(keys[n > 0], 2)], [n[n > 0]]))
    log = dict(zip(keys.tolist(), mixer.log10(predictors).tolist(), strict=True))
    want = by_key((i, round(sum(log[k] for k in runs(x)), 1)) for i, x in rows)
    assert [(a, round(d, 1)) for a, _, _, d in one] == want or all(abs(a[3] - b[1]) < 0.06 for a, b in zip(one, want, strict=True))


def test_mixing_beats_the_base_on_unseen_texts(spark):
    """And more texts make it better."""
    r = random.Random(4)
    nouns, verbs = ["".join(r.choices("bcdfgklmnprst", k=1) + r.choices("aeiou", k=1) + r.choices("lmnrst", k=2)) for _ in range(60)], ["runs to", "sees the", "holds a", "takes no"]
    line = lambda: f"the {r.choice(nouns)} {r.choice(verbs)} {r.choice(nouns)}."
    rows = [(i, " ".join(line() for _ in range(12))) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bits = []
    for most in (60, 600):
        got = lm_scores(table.where(f"doc_id < {most} OR doc_id % 7 = 2"), F.col("doc_id") % 7 == 2).where("held_out").agg(F.avg("score"), F.avg("base_score"), F.avg("bits_per_byte")).head()
        assert got[0] > got[1]
        bits.append(got[2])
    assert bits[1] < bits[0] < 2


def test_block_max_search_is_exact(monkeypatch):
    rng = np.random.default_rng(3)
    dense = rng.random((500, 60)) * (rng.random((500, 60)) < np.linspace(0.02, 0.5, 60))
    dense[400:] = dense[:100]  # ties
    dense[7] = 0
    dense /= np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-12)

    def vectors(rows):
        places = [np.flatnonzero(d) for d in rows]
        firsts = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
        return Vectors(np.concatenate(places), np.concatenate([d[p] for d, p in zip(rows, places, strict=True)]), firsts)

    for common, queries in ((0.05, 256), (0.2, 3), (1.0, 40), (-1.0, 256)):  # parts by product and by postings, and either alone
        monkeypatch.setattr(toxicity, "COMMON", common)
        monkeypatch.setattr(toxicity, "QUERIES", queries)
        index = BlockMaxIndex(np.arange(60, dtype=np.uint64), np.arange(500), np.zeros(500), vectors(dense))
        for skip in (None, np.arange(0, 500, 25)):
            row, example, sims = index.search(vectors(dense[::25]), 16, skip)
            for i, q in enumerate(dense[::25]):
                cosine = dense @ q
                if skip is not None:
                    cosine[skip[i]] = -1
                want = np.lexsort((np.arange(500), -np.round(cosine, 11)))[:16]
                want = want[cosine[want] > 1e-11]
                assert example[row == i].tolist() == want.tolist() and np.allclose(sims[row == i], cosine[want])
    small = BlockMaxIndex(np.arange(60, dtype=np.uint64), np.arange(3), np.zeros(3), vectors(dense[:3]))
    assert len(small.search(vectors(dense[:2]), 16)[0]) <= 6
    none = BlockMaxIndex(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), vectors(dense[:0]) if False else Vectors(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)))
    assert len(none.search(vectors(dense[:2]), 16)[0]) == 0


def test_toxicity_scores_are_those_of_brute_force(spark):
    """Every term counts, those without a label's text too; each score comes from all examples' cosines."""
    rows = [(i, sentence(25, i) + (" vile, SCUM!" if i % 4 == 0 else "")) for i in range(120)] + [(500, "unseen words only here"), (501, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, block int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels, F.col("doc_id") % 5 != 1).collect()}
    edges = toxicity.EDGES.decode()
    counts = {i: collections.Counter(w.strip(edges) for w in WORD.findall((t or "").translate(LOWER))) for i, t in rows}
    learned = [i for i in range(120) if i % 5 != 1]
    held = {t: [0, 0, 0] for c in counts.values() for t in c}
    for i, c in counts.items():
        for t in c:
            held[t][2] += 1
            if i in learned:
                held[t][int(i % 4 == 0)] += 1
    toxic = sum(i % 4 == 0 for i in learned)
    names = list(held)
    factor = dict(zip(names, toxicity.term_weights(np.array([held[t] for t in names]), len(rows), len(learned) - toxic, toxic).tolist(), strict=True))
    assert min(factor.values()) > 0
    unit = {}
    for i, c in counts.items():
        w = {t: (1 + math.log(n)) * factor[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        unit[i] = {t: x / norm for t, x in w.items()}
    for i, _ in rows:
        sims = sorted(((round(sum(x * unit[e].get(t, 0.0) for t, x in unit[i].items()), 9), e) for e in learned), reverse=True)
        want = [s for s, _ in sims[:16] if s > 1e-9]
        assert np.allclose(got[i].cosines, want, atol=1e-8)
        weight = np.array(want) ** 2
        near = dict((e, s) for s, e in sims)
        vote = (sum(near[e] ** 2 * (e % 4 == 0) for e in got[i].neighbours) + 0.05 * toxic / len(learned)) / (weight.sum() + 0.05)
        assert abs(got[i].vote - vote) < 1e-7


def test_toxicity_learns_and_is_blind_to_ids(spark, empty):
    r = random.Random(1)
    rows = [(i, sentence(30, i) + (" ".join(r.sample(["vile", "scum", "rotten"], 2)) if i % 4 == 0 else "")) for i in range(400)]
    rows += [(1000, rows[0][1]), (None, rows[0][1]), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {(r.doc_id, k): r for k, r in enumerate(toxicity_scores(docs, labels, F.col("doc_id") % 10 != 1).orderBy("doc_id").collect())}
    scores = {r.doc_id: r for r in got.values()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    right = [scores[i].predicted == (i % 4 == 0) for i in range(1, 400, 10)]
    assert sum(right) >= 0.95 * len(right)
    assert scores[0].score == scores[1000].score == scores[None].score and scores[1001].neighbours == [] and scores[1001].predicted == 0
    assert toxicity_scores(docs.where("false"), labels, F.lit(True)).count() == 0
    assert {r.score for r in toxicity_scores(docs, labels.where("false"), F.lit(True)).collect()} == {0.5}


def test_toxicity_terms_travel_once_and_factors_in_few_bytes(monkeypatch):
    """A block's row has no terms of its own, and what comes back for a term takes about a byte, not the eight of a double."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("abcdeionrst", k=8)) for _ in range(60)) for _ in range(400)] + ["", "a a a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([i % 2 for i in range(len(texts))]), pa.array(texts)], ["row", "label", "text"])
    monkeypatch.setattr(toxicity, "block_names", lambda: iter(["0-0"]))
    rows = pa.Table.from_batches(list(toxicity._posted(3)([batch]))).to_pylist()
    (block,) = [x for x in rows if x["bucket"] is None]
    dealt = [x for x in rows if x["bucket"] is not None]
    hashes, doc, place, counts = toxicity.text_terms(next(W.text_chunks(pa.array(texts))))
    assert block["terms"] is None and sorted(np.concatenate([toxicity.unpacked_keys(x["terms"]).view(np.uint64) for x in dealt])) == sorted(hashes)
    asked = np.unique(hashes[::7])
    shared = type("Shared", (), {"value": asked.tobytes()})
    back = []
    for x in dealt:
        out = pa.Table.from_batches(list(toxicity._weighed(shared, 402, 201, 201)(iter(pa.Table.from_pylist([x]).to_batches())))).to_pylist()
        weights, places = toxicity._factors(out[0])
        own = toxicity.unpacked_keys(x["terms"]).view(np.uint64)
        assert all(asked[p] == h if p >= 0 else h not in asked for h, p in zip(own, places))
        held = toxicity.unpacked_planes(x["held"]).reshape(3, -1).T
        assert (weights == toxicity.term_weights(held, 402, 201, 201)).all()
        alone, spots = toxicity._factors(out[1])
        assert (alone == weights[places >= 0]).all() and (spots == places[places >= 0]).all()
        back.append(sum(len(out[0][c]) for c in ("known", "spots", "weights")))
    assert sum(back) < 2 * len(hashes)
    held = np.cumsum(toxicity.unpacked_planes(block["places"])), toxicity.unpacked_planes(block["counts"])
    assert len(held[0]) == len(place) and sorted(held[1]) == sorted(counts)


def test_a_third_of_copies_keeps_its_words(spark):
    """A group of copies that is over a third of all rows is found by its own, very common words."""
    copied = "grim spiteful words that all of these many copies have"
    rows = [(i, sentence(30, i) + (" vile scum" if i % 4 == 0 else "")) for i in range(200)] + [(200 + i, copied) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200 or i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels, F.col("doc_id") % 10 != 1).where("doc_id >= 200").collect()
    assert len(got) == 120 and all(r.predicted == 1 and r.neighbours and abs(r.cosines[0] - 1) < 1e-9 for r in got)


def test_examples_are_distinct_and_the_same_in_any_order(spark):
    """Copies take one place in the index, the bound is met exactly, and row order doesn't matter."""
    rows = [(i, int(i % 3 == 0), sentence(30, i) + (" vile" if i % 3 == 0 else "")) for i in range(150)]
    rows += [(150 + i, int(i < 15), "the same copied text") for i in range(60)]
    texts = spark.createDataFrame(rows, "row long, label long, text string")
    for most in (40, 1000):
        a, b = ([(r["row"], r["label"]) for r in first_examples(t, most)] for t in (texts.repartition(5), texts.orderBy(F.desc("row")).coalesce(2)))
        assert a == b and len({i for i, _ in a}) == len(a) == min(most, 151) and sum(i >= 150 for i, _ in a) <= 1
    assert dict(a)[150] == 0.25


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.com/de/a", "ftp://x.org/fr/", "http://org", "x://bad.com/page.html", "x://www.BAD.com/page/", "x://ok.com/Page", "://", "a://b://c/d", "http://notexample.net/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.com/page",), (None,), ("bad.com/page",)], "url_key string")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filtered_urls(pages, rules, listed).collect()}
    want = {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        4: ("example.com", "/de/a", "example.com/de/", "block"), 5: ("x.org", "/fr/", "org/fr/", "allow"), 6: ("org", "", None, "allow"), 7: ("bad.com", "/page.html", None, "block"),
        8: ("www.bad.com", "/page/", None, "block"), 9: ("ok.com", "/Page", None, "allow"), 10: ("", "", None, "allow"), 11: ("b:", "//c/d", None, "allow"), 12: ("notexample.net", "/en/", "net/", "block"),
    }
    assert got == want
    assert {r.verdict for r in filtered_urls(pages, [], listed.where("false")).collect()} == {"allow"}
    assert filtered_urls(pages.where("false"), rules, listed).count() == 0


def test_shards_are_even_and_keep_groups(spark, docs, empty):
    linked = [(i, f"a line that many texts of group {i % 12} share word for word\nown {i}") for i in range(600)]
    rows = [*zip(IDS, TEXTS, strict=True), *[(10_000 + i, t) for i, t in linked], *[(20_000 + i, "the same text") for i in range(300)]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = balanced_shards(table).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    sizes = by_key((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert by_key((r.doc_id, r.size, r.text_crc32) for r in got) == sizes
    home = {r.doc_id: r.shard for r in got if r.doc_id and 10_000 <= r.doc_id < 20_000}
    together = sum(max(collections.Counter(home[10_000 + i] for i in range(g, 600, 12)).values()) for g in range(12)) / 600
    assert together > 0.3  # an eighth by chance
    assert balanced_shards(empty).count() == 0


def test_repairs_even_any_sizes():
    for sizes in ([0] * 8, [1, 0, 0], [100, 3, 3, 7], [5], [10, 0, 10, 0]):
        keep, moves = _repairs(dict(enumerate(sizes)))
        after = {s: keep[s] for s in keep}
        for _, _, n, to, at in moves:
            assert at == after[to]
            after[to] += n
        assert sum(after.values()) == sum(sizes) and max(after.values()) - min(after.values()) <= 1


def brute_lines(rows, min_words):
    seen, out = set(), []
    for i, t in sorted(dict.fromkeys(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (t or "").split("\n")
        f = [(p, x, len(WORD.findall(x))) for p, x in enumerate(lines) if WORD.search(x)]
        spans = set()
        for a in range(len(f)):
            s = 0
            for b in range(a, len(f)):
                s += f[b][2]
                if s >= min_words:
                    spans.add((a, b))
                    break
            s = 0
            for b in range(a, -1, -1):
                s += f[b][2]
                if s >= min_words:
                    spans.add((b, a))
                    break
        gone = set()
        for a, b in sorted(spans):
            key = tuple(x[1] for x in f[a : b + 1])
            if key in seen:
                gone |= {f[j][0] for j in range(a, b + 1)}
            seen.add(key)
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)))
    return out


def test_line_runs(spark, docs, empty):
    r = random.Random(3)
    pool = [f"line {k} has these words" if k % 3 else f"l{k}" for k in range(12)]
    rows = [(i, "\n".join(r.choice([*pool, "", f"own {i} {j}", f"own {i} {j} and more"]) for j in range(r.randint(0, 30)))) for i in range(80)]
    rows += [(90, rows[0][1]), (90, rows[0][1]), (None, rows[1][1]), (None, None), (91, "x" * 50), (92, "\n\n")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    want = brute_lines(rows, 8)
    assert by_key(set(map(tuple, got.collect()))) == by_key(set(want)) and got.count() == len(rows)
    assert dedup_lines(docs).count() == len(TEXTS) and dedup_lines(docs).columns == [*docs.columns, "n_deleted_lines"]
    assert dedup_lines(empty).count() == 0


def test_template_leaks(spark, docs, empty):
    q = "When Anna came home she counted 12 red apples beside the old barn and later Ben found 12 green pears under that tall tree for 3 euros."
    varied = q.replace("Anna", "Clara").replace("12", "45").replace("3 euros", "9 dollars")
    broken = q.replace("12 red", "45 red").replace("12 green", "46 green")
    rows = [(1, "So it goes: " + q), (2, varied.lower().replace("clara", "Clara").replace("ben", "Ben") + " And then."), (3, broken), (4, sentence(200, 77)), (None, q), (5, None), (6, ""), (7, q), (7, q)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, window string")
    bench = spark.createDataFrame([(1, q), (2, "too short"), (3, None)], "item_id long, text string")
    got = {r.doc_id: r for r in template_leaks(table, bench).collect()}
    assert set(got) == {1, 2, 3, 7, None} and got[1].changed_slots == 0 and got[2].changed_slots > 0
    assert got[3].n_windows < got[7].n_windows  # windows with the broken value are dropped
    assert sorted((r.doc_id or 0) for r in without_leaks(table, bench).collect()) == [4, 5, 6]
    assert without_leaks(docs, bench).count() == len(TEXTS) and without_leaks(empty, bench).count() == 0
    assert without_leaks(docs, bench.where("false")).count() == len(TEXTS)


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_hot_keys_are_joined_the_same(spark, monkeypatch, share):
    """With no key hot, a few and all: the rows of a plain join, null keys and rows without a partner too."""
    from classgauge.llm import sizing

    monkeypatch.setattr(sizing, "HOT_SHARE", share)
    rows = [(i, None if i % 50 == 0 else 7 if i % 3 == 0 else i % 20, i % 2, i) for i in range(300)]
    table = spark.createDataFrame(rows, "i long, a long, b int, v int")
    counted = table.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("v").alias("first"), F.count("*").alias("n_")).where("n_ > 9 AND a <> 3")
    held = {(r["a"], r["b"]): r["first"] for r in counted.collect()}
    got = sizing.join_counted(table, counted, ["a", "b"], len(rows), ["i"])
    assert got.columns == ["i", "a", "b", "v", "first"]
    assert by_key(got.collect()) == by_key((*r, held.get((r[1], r[2]))) for r in rows)


def test_line_dedup_does_not_depend_on_hot_lines(spark, docs, monkeypatch):
    from classgauge.llm import sizing

    one = by_key(dedup_lines(docs.select("doc_id", "text"), 5).collect())
    monkeypatch.setattr(sizing, "HOT_SHARE", 2)
    assert by_key(dedup_lines(docs.select("doc_id", "text"), 5).collect()) == one and any(r[2] for r in one)
