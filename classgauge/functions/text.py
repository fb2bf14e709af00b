"""Text clean-up, tokens and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from classgauge.functions.vectors import let

# Code points removed, folded and kept by the Arabic profile.
DIACRITICS = "".join(map(chr, [*range(0x0617, 0x061B), *range(0x064B, 0x0653)]))
TATWEEL = "\u0640"
FOLD_FROM = "\u0625\u0623\u0622\u0649\u0629"  # alef with hamza below, above, with madda; alef maksura; teh marbuta
FOLD_TO = "\u0627\u0627\u0627\u064a\u0647"  # alef three times; yeh; heh
ARABIC_LETTER = r"[\u0621-\u064A]"

# What a Python string's strip() takes for whitespace.
BLANK = r"[\t\n\x0b\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

PROFILES = ("arabic", "generic")


def _check(profile: str) -> None:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normalize(text: Column, profile: str = "arabic") -> Column:
    """Clean one text column; null becomes the empty string.

    Arabic: diacritics and tatweel go, letter variants fold, everything but
    ASCII letters and digits, Arabic letters and blanks turns into a blank, and
    runs of blanks collapse. Deleting and folding touch one character each and
    do not depend on one another, so a single ``translate`` does them all.
    """
    _check(profile)
    text = F.coalesce(text, F.lit(""))
    if profile == "generic":
        return F.lower(text)
    text = F.translate(text, FOLD_FROM + DIACRITICS + TATWEEL, FOLD_TO)
    text = F.regexp_replace(text, r"[^0-9a-zA-Z\u0621-\u064A]+", " ")
    return F.trim(text)


def tokens(clean: Column, profile: str = "arabic") -> Column:
    """Words of a normalised text. Arabic: only words made of Arabic letters alone."""
    _check(profile)
    if profile == "generic":
        return F.regexp_extract_all(clean, F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(F.split(clean, " "), lambda w: w.rlike(f"^{ARABIC_LETTER}+$"))


def unigrams_and_bigrams(tok: Column) -> Column:
    """All words, then each word joined to the next by one blank."""

    def both(t: Column) -> Column:
        n = F.size(t) - 1
        pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n > 0, F.concat(t, pairs)).otherwise(t)

    return let(tok, both)


def terms(text: Column, profile: str = "arabic") -> Column:
    """The list of terms of a raw text."""
    return unigrams_and_bigrams(tokens(normalize(text, profile), profile))


def parse_token_list(literal: Column) -> Column:
    """Words of a printed list such as ``['a', 'b']``, joined by blanks.

    The text is parsed as data, never run. A comma before the closing bracket, round brackets
    around two or more words and two-digit escapes are put in the form the JSON reader takes. What it
    then does not take (or null) gives null; callers route such rows to a reject table.
    """
    blank = r"[\t\n\r ]*"
    text = F.regexp_replace(literal, rf"(?s)^{blank}\((.*,.*)\){blank}$", "[$1]")
    text = F.regexp_replace(text, rf"([^\[\s]){blank},{blank}\]{blank}$", "$1]")
    text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    return F.array_join(F.from_json(text, "array<string>"), " ")
