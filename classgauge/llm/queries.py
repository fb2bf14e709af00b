"""Registered queries of the operators, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classgauge.llm.alignment import token_alignment
from classgauge.llm.bpe import bpe_encode
from classgauge.llm.jaccard import shingle_components
from classgauge.llm.lexical import ranked_search
from classgauge.llm.linedup import dedup_lines
from classgauge.llm.mixing import lm_scores
from classgauge.llm.perplexity import quality_verdicts
from classgauge.llm.shards import balanced_shards
from classgauge.llm.sources import mixing_plan
from classgauge.llm.templates import template_leaks
from classgauge.llm.tokencount import token_counts
from classgauge.llm.toxicity import toxicity_scores
from classgauge.llm.urlfilter import canonical, filtered_urls, url_host, url_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(n: int):
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(-1))


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(_table(spark, folder, "documents"), _vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_shards(_table(spark, folder, "documents"))


# The rules and the host words that the query's list is made of.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOSTS = "(casino|pills|spam|bets)"


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    parts = pages.withColumnRenamed("url", "url_").select(url_host(F.col("url_")).alias("host"), url_path(F.col("url_")).alias("path"))
    listed = parts.where(F.col("host").rlike(LISTED_HOSTS)).select(canonical(F.col("host"), F.col("path")).alias("url_key"))
    return filtered_urls(pages, URL_RULES, listed)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "low", "high"
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scores = toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"), _remainder(4) != 2)
    return scores.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted", "neighbours", "cosines")


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return template_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_bpe_coding(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = _vocabulary("byte_bpe_50k.json")
    coded = bpe_encode(_table(spark, folder, "documents"), vocabulary, decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(_table(spark, folder, "documents"))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(_table(spark, folder, "documents"), _remainder(7) == 2)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_deleted_lines", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256")
    )


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing_plan(_table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return plan.select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=10)


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = token_alignment(_table(spark, folder, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
    return rows.drop("groups")


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_URL_PARTS = r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
),
named AS (SELECT *, regexp_replace(host, '^www[.]', '') || regexp_replace(path, '(/index)?([.]html?)?/*$', '') AS u FROM cut),
list AS (SELECT DISTINCT u FROM named WHERE regexp_matches(host, '(casino|pills|spam|bets)')),
rules(said, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(said, length(h || p)) AS said FROM named, rules
  WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
)
SELECT n.page_id, host, path, rule, coalesce(said, CASE WHEN list.u IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  (host <> '' AND list.u IS NOT NULL) AS listed
FROM named n LEFT JOIN fit USING (page_id) LEFT JOIN list ON list.u = n.u AND host <> ''
"""

_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words
),
sizes AS (SELECT doc_id, count(g) AS n FROM words LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM sizes JOIN reach ON a = doc_id GROUP BY doc_id, n
"""

_LINES = f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
split AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM docs),
filled AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS w FROM split WHERE regexp_matches(line, '{_WORD}')),
lines AS (
  SELECT *, row_number() OVER o AS i, (sum(w) OVER o)::BIGINT AS upto FROM filled WINDOW o AS (PARTITION BY doc_id ORDER BY place)
),
spans AS (SELECT doc_id, list(line ORDER BY i) AS ll FROM lines GROUP BY doc_id),
ahead AS (SELECT a.doc_id, a.i AS a, b.i AS b FROM (SELECT *, upto - w + 20 AS need FROM lines) a ASOF JOIN lines b ON a.doc_id = b.doc_id AND a.need <= b.upto),
behind AS (SELECT b.doc_id, a.i AS a, b.i AS b FROM (SELECT *, upto - 20 AS room FROM lines) b ASOF JOIN (SELECT *, upto - w AS before FROM lines) a ON a.doc_id = b.doc_id AND b.room >= a.before),
windows AS (SELECT * FROM ahead UNION SELECT * FROM behind),
ranked AS (
  SELECT doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(ll[a:b], chr(10)) ORDER BY doc_id, a) AS rk FROM windows JOIN spans USING (doc_id)
),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE rk > 1),
places AS (SELECT doc_id, list(place) AS gone, count(*) AS n FROM gone JOIN lines USING (doc_id, i) GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN gone IS NULL THEN text
    ELSE array_to_string([ls[k] FOR k IN range(1, len(ls) + 1) IF NOT list_contains(gone, k)], chr(10)) END AS t
  FROM docs LEFT JOIN places USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_deleted_lines, length(t)::BIGINT AS n_chars_left, sha256(t) AS text_sha256 FROM texts
"""

_MIX = f"""
WITH sized AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
heavy AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [3, 1, 2][place % 3 + 1]::DOUBLE AS w FROM sums),
inorder AS (
  SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM heavy WINDOW o AS (ORDER BY cap / w, place)
),
steps AS (SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size) FROM sums) - before) / rest AS lvl FROM inorder),
found AS (SELECT arg_min(lvl, k) AS lvl FROM steps WHERE cap >= lvl * w),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM found) * w, cap)) AS target FROM heavy),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
drawn AS (SELECT *, ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sized),
mixed AS (
  SELECT doc_id, size, d.source, source_size, target, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies
  FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT *, copies * size AS taken FROM mixed
"""

_RANKED = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0),
normed AS (SELECT doc_id, w, 100 - 75 + ((75 * len(w)::BIGINT * n_docs) // n_terms) AS m FROM words, total WHERE len(w) > 0),
tf AS (SELECT doc_id, m, unnest(w) AS term, count(*)::BIGINT AS tf FROM (SELECT doc_id, m, w, row_number() OVER () AS r FROM normed) GROUP BY r, doc_id, m, term),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
),
asked AS (SELECT item_id, term, count(*)::BIGINT AS q FROM items GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "op3_url_filters": _URL_PARTS,
    "op8_ngram_jaccard_join": _JACCARD,
    "op10_line_dedup": _LINES,
    "op11_source_mixing": _MIX,
    "op12_ranked_search": _RANKED,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_sharding, op3_url_filters, op4_quality_rules, op5_toxicity, op6_benchmark_decontamination, op7_bpe_coding, op8_ngram_jaccard_join, op9_lm_scoring, op10_line_dedup,
    op11_source_mixing, op12_ranked_search, op13_token_alignment)
}
