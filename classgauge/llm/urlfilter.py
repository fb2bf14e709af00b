"""Operator 3: URL rules and a list of canonical URLs, sifted by a blocked Bloom filter and joined exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
BLOCK_BITS = 64  # a block is one long
PROBES = 4


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url_, instr(url_, '://') + 3)")).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end; empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url_, instr(url_, '://') + 3)")).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """A host without ``www.`` with its path without a final ``/``, ``.html`` or ``index.html``."""
    return F.concat(F.regexp_replace(host, "^www[.]", ""), F.regexp_replace(path, "(/index)?([.]html?)?/*$", ""))


def _block(url: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks) if isinstance(blocks, int) else blocks)


def _mask(url: Column) -> Column:
    """A long with PROBES bits, from a second hash."""
    mask = F.lit(0).cast("long")
    h = F.xxhash64(F.lit(7), url)
    for k in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return mask


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, bits) of a blocked Bloom filter of the column ``url_key``: a URL sets its bits in one block only."""
    return listed.groupBy(_block(F.col("url_key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("url_key"))).alias("bits"))


def filtered_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, listed), one for each input row.

    ``rules`` are a few (verdict, host, path start), fixed in the plan; a rule fits its host and all subdomains
    where the path starts with the rule's, and the longest host and path together win. Where no rule fits, a URL whose canonical form is
    in ``listed`` (column ``url_key``) is blocked and any other allowed. Canonical forms first pass a
    blocked Bloom filter, one equi-join on the block; only possible hits reach the exact join,
    which removes the false ones. Equal URLs are judged once, so a hot URL costs a row per task. A null URL, or one without ``://``, has
    an empty host and path and is never listed; ids may be null or repeat; empty tables are fine;
    other columns are ignored.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url_"))
    source = source.select("page_id", url_host(F.col("url_")).alias("host"), url_path(F.col("url_")).alias("path"))
    source = source.withColumn("url_key", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    keys = source.where("url_key IS NOT NULL").select("url_key").distinct()

    listed = listed.select(F.col("url_key").cast("string")).where("url_key IS NOT NULL").distinct()
    blocks = max(1, listed.count() * BITS_PER_URL // BLOCK_BITS)
    bloom = bloom_blocks(listed, blocks)
    sifted = keys.withColumn("block", _block(F.col("url_key"), blocks)).join(bloom, "block")
    mask = _mask(F.col("url_key"))
    hits = sifted.where(F.col("bits").bitwiseAND(mask) == mask).select("url_key")
    hits = hits.join(listed, "url_key", "left_semi").select(F.col("url_key").alias("hit_"))

    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    rule = verdict = None
    for said, host, path in longest:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    rule, verdict = (none, none) if rule is None else (rule, verdict)
    out = source.join(hits, source["url_key"] == hits["hit_"], "left")
    out = out.withColumn("listed", F.col("hit_").isNotNull())
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")
