"""The registered queries beside their SQL, and the pipeline stage by stage."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from classgauge.llm.queries import ORACLES, QUERIES
from classgauge.session import written
from tools.check import TABLES, same


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    assert same(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()) == "same"


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert last.count() == kept.count() and last.where("NOT exact").count() == 0


def test_stages_are_those_of_brute_force(spark, sf, tmp_path):
    """Each stage on its own input: SQL for lines and near copies, plain rules for quality, the library for ids."""
    import re

    from tokenizers import Tokenizer

    import public_tokenizers
    from classgauge.llm.perplexity import quality_verdicts
    from classgauge.llm.templates import template_leaks

    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"key_": F.lit("mine"), "cuts_": F.lit(1), "n_deleted_lines": F.lit("x"), "d_": F.lit(2), "lines": F.lit(3)})
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs = written(docs, "stage")
        docs = stage(spark, docs, sf)
        assert name == "bpe_coding" or docs.columns == inputs[name].columns
    inputs["end"] = docs
    rows = {name: {r["doc_id"]: r for r in table.collect()} for name, table in inputs.items()}

    verdicts = {r["doc_id"]: r for r in quality_verdicts(inputs["quality_rules"]).collect()}
    for i, r in rows["quality_rules"].items():
        v, words = verdicts[i], word.findall(r["text"] or "")
        assert not (len(words) < 50 and v["kept"]) and v["kept"] == (not v["base_failed"] and v["low"] <= v["bits"] <= v["high"])
        assert (i in rows["line_dedup"]) == v["kept"]

    def sql(name: str, table: str, query: str):
        con = duckdb.connect()
        inputs[table].select("doc_id", "text").write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path / name}/*.parquet'")
        return con.execute(query).fetchall()

    for i, deleted, chars, digest in sql("lines", "line_dedup", ORACLES["op10_line_dedup"]):
        kept = rows["ngram_jaccard_join"].get(i)
        if kept is None:
            assert deleted > 0
        else:
            assert (len(kept["text"]), hashlib.sha256(kept["text"].encode()).hexdigest()) == (chars, digest) and kept["n_deleted_lines"] == "x"
    components = {i: c for i, _, c in sql("near", "ngram_jaccard_join", ORACLES["op8_ngram_jaccard_join"])}
    assert set(rows["benchmark_decontamination"]) == {i for i, c in components.items() if i == c}
    leaks = {r["doc_id"] for r in template_leaks(inputs["benchmark_decontamination"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(rows["bpe_coding"]) == set(rows["benchmark_decontamination"]) - leaks
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in rows["end"].items():
        assert r["ids"] == library.encode(rows["bpe_coding"][i]["text"], add_special_tokens=False).ids and r["exact"]


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
