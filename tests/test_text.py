import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from classgauge.functions import text as tx

MEEM, REH, BEH = "م", "ر", "ب"


def clean(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(tx.normalize(F.col("t"))).collect()]


def cut(spark, *texts, profile="arabic"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(tx.terms(F.col("t"), profile)).collect()]


def test_normalizer_cases(spark):
    cases = {
        None: "",
        MEEM + "ُ" + REH: MEEM + REH,
        MEEM + "ــ" + REH: MEEM + REH,
        "أ": "ا",
        "إ": "ا",
        "آ": "ا",
        "ى": "ي",
        "ة": "ه",
        MEEM + "ٓ" + REH: MEEM + " " + REH,
        MEEM + "٣" + REH: MEEM + " " + REH,
        "  a!!b  ": "a b",
        "Ab \tC\x1cd": "Ab C d",
    }
    assert clean(spark, *cases) == list(cases.values())


def test_terms_cases(spark):
    got = cut(spark, "abc" + MEEM + REH, MEEM + REH + " hi " + BEH, MEEM, "", None)
    assert got == [[], [MEEM + REH, BEH, MEEM + REH + " " + BEH], [MEEM], [], []]


def test_generic_terms(spark):
    assert cut(spark, "Ab c-D 1", profile="generic") == [["ab", "c", "d", "ab c", "c d"]]


def reference_terms(text):
    """The definition, one rule after another."""
    if text is None:
        return "", []
    t = "".join(c for c in text if not ("ؗ" <= c <= "ؚ" or "ً" <= c <= "ْ" or c == "ـ"))
    for old, new in (("إ", "ا"), ("أ", "ا"), ("آ", "ا"), ("ى", "ي"), ("ة", "ه")):
        t = t.replace(old, new)
    t = re.sub(r"[^0-9a-zA-Zء-ي\s]", " ", t)
    t = re.sub(r"\s+", " ", t).strip()
    tok = re.findall(r"(?u)\b[ء-ي]+\b", t)
    return t, tok + [a + " " + b for a, b in zip(tok, tok[1:])]


ALPHABET = st.one_of(
    st.characters(min_codepoint=0x0600, max_codepoint=0x06FF),
    st.sampled_from("abZ09 \t\n  !_\U0001f600İ"),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=40, max_size=60))
def test_terms_follow_the_definition(spark, texts):
    want = [reference_terms(t) for t in texts]
    assert clean(spark, *texts) == [w[0] for w in want]
    assert cut(spark, *texts) == [w[1] for w in want]


def test_token_lists(spark):
    cases = {
        "['a', 'b']": "a b",
        "['a', \"it's\"]": "a it's",
        "[]": "",
        "['a',]": "a",
        "['a' , ] ": "a",
        "('a', 'b')": "a b",
        "('a',)": "a",
        r"['a\x0fb']": "a\x0fb",
        "['a,]', 'b']": "a,] b",
        "[,]": None,
        "['a', 'b'": None,
        "nan": None,
        None: None,
        r"['‏a']": "‏a",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(tx.parse_token_list(F.col("t"))).collect()] == list(cases.values())


def test_strip_matches_python(spark):
    texts = [" a ", " a b\x1d", "\n\t", "a\x85", "　 \x0b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(tx.strip_blanks(F.col("t"))).collect()] == [t.strip() for t in texts]
