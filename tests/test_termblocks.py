from pyspark.sql import functions as F

from classgauge.operators import features, introspect, textmodel

# Repeated and null keys, null and empty texts, a text with no known term, and a word of every text.
ROWS = [
    (1, "a b a", 0), (2, "a b c", 0), (3, "a c c", 1), (4, "a c d", 1), (5, "a", 2), (5, "a d", 2), (None, "a b", 1), (None, "c d a", 1),
    (6, None, 0), (7, "", 2), (8, "zz", 2), (9, "a B c", 0), (10, "d a c", 1),
]


def table(spark):
    return spark.createDataFrame(ROWS, "id long, text string, label int").repartition(3)


def plain(x):
    return str([plain(y) for y in x]) if isinstance(x, list) else str(round(x, 9) if isinstance(x, float) else x)


def flat(df):
    return sorted(tuple(map(plain, r)) for r in df.collect())


def both(monkeypatch, make):
    small = flat(make())
    with monkeypatch.context() as m:
        m.setattr(features, "BROADCAST_BYTES", 0)
        big = flat(make())
    return small, big


def test_blocks_give_the_rows_of_the_broadcast_join(spark, monkeypatch):
    df = table(spark)
    vocab = features.fit_vocabulary(df, "text", "generic")
    counts = features.term_counts(df, "id", "text", "generic", carry=("label",))
    for make in (
        lambda: features.tfidf_long(counts, "id", vocab).select("id", "label", "term", "term_idx", "df", "idf", "weight"),
        lambda: introspect.top_terms(features.tfidf_long(counts, "id", vocab), "id"),
        lambda: textmodel.fit_centroid(df, "id", "text", "label", vocab, "generic").table(spark).select("term_idx", "term", "df", "idf", "w"),
    ):
        small, big = both(monkeypatch, make)
        assert small and small == big


def test_block_scores_keep_texts_without_terms(spark, monkeypatch):
    df = table(spark)
    vocab = features.fit_vocabulary(df, "text", "generic")
    for model in (textmodel.fit_centroid(df, "id", "text", "label", vocab, "generic"), textmodel.fit_naive_bayes(df, "id", "text", "label", vocab, "generic")):
        small, big = both(monkeypatch, lambda: textmodel.term_logits(df, "id", "text", model))
        assert small == big and len(small) == len({r[0] for r in ROWS})
        small, big = both(monkeypatch, lambda: textmodel.score_texts(df, "text", model, driver_bytes=0))
        assert small == big and len(small) == len(ROWS)


def test_vectors_from_blocks(spark, monkeypatch):
    df = table(spark)
    vocab = features.fit_vocabulary(df, "text", "generic")
    make = lambda: features.tfidf_vectors(df, "text", "generic", vocab, driver_bytes=0)
    small, big = both(monkeypatch, lambda: make().select("id", "text", "label", F.unwrap_udt("features")["indices"], F.unwrap_udt("features")["values"]))
    assert small == big and len(small) == len(ROWS)


def test_a_large_table_moves_no_row_per_term(spark, monkeypatch):
    """Past the broadcast bound a term of every text is asked for once a block, not once a text."""
    rows = spark.range(2000).selectExpr("id", "concat('the word ', char(97 + id % 26), ' ', char(97 + id % 25)) text", "int(id % 3) label")
    vocab = features.fit_vocabulary(rows, "text", "generic")
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    counts = features.term_counts(rows, "id", "text", "generic")
    plan = features.tfidf_long(counts, "id", vocab, with_term=False)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not any("hashpartitioning(_join" in line for line in moved) and "Window" not in plan


def test_tasks_grow_with_the_input(spark, tmp_path):
    """A task's share of the input is bounded, whatever the session's number of partitions."""
    from classgauge.operators.termblocks import task_parts

    rows = spark.range(1000).selectExpr("id", "repeat(uuid(), 10) text")
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert task_parts(df, 1 << 10) > 8 == task_parts(df)


def test_rows_past_the_driver_bound_are_scored_in_place(spark, monkeypatch, tmp_path):
    """Rows keep their columns, nulls and copies, in blocks of any size; texts are not dealt by hash, counted or joined back."""
    from classgauge.operators import termblocks

    more = spark.sql("SELECT id, concat_ws(' ', transform(sequence(0, int(id % 40)), i -> char(97 + (i * id) % 5))) text, int(id % 3) label FROM range(300)")
    table(spark).unionByName(more).selectExpr("*", "array(id, null) many", "timestamp_seconds(id) at", "if(id % 2 = 0, struct(text as t), null) part").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    vocab = features.fit_vocabulary(df, "text", "generic")
    model = textmodel.fit_centroid(df, "id", "text", "label", vocab, "generic")
    small = flat(textmodel.score_texts(df, "text", model))
    for n_terms, n_rows in ((termblocks.BLOCK_TERMS, termblocks.BLOCK_ROWS), (7, 1000), (1000, 3)):
        monkeypatch.setattr(termblocks, "BLOCK_TERMS", n_terms)
        monkeypatch.setattr(termblocks, "BLOCK_ROWS", n_rows)
        assert flat(textmodel.score_texts(df, "text", model, driver_bytes=0)) == small
    plan = textmodel.score_texts(df, "text", model, driver_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    batch = [b for b in df.selectExpr("id", "split(text, ' ') terms").toArrow().to_batches()]
    blocks = list(termblocks._cut(iter(batch)))
    assert sum(map(len, blocks)) == df.count() and max(map(len, blocks)) <= 3


def test_vectors_past_the_driver_bound_stay_in_rows(spark, monkeypatch, tmp_path):
    """Texts are not dealt by hash, counted by Spark or joined back; blocks of any size give the same vectors."""
    from classgauge.operators import termblocks

    table(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    vocab = features.fit_vocabulary(df, "text", "generic")
    plain_vectors = lambda **at: flat(features.tfidf_vectors(df, "text", "generic", vocab, **at).select("id", "text", "label", F.unwrap_udt("features")["indices"], F.unwrap_udt("features")["values"]))
    small = plain_vectors()
    monkeypatch.setattr(features, "term_counts", None)
    for n_terms in (termblocks.BLOCK_TERMS, 4):
        monkeypatch.setattr(termblocks, "BLOCK_TERMS", n_terms)
        assert plain_vectors(driver_bytes=0) == small and len(small) == len(ROWS)
    for at in ({}, {"driver_bytes": 0}):
        assert features.tfidf_vectors(df, "text", "generic", vocab, keep=["label"], **at).columns == ["label", "features"]


def test_introspection_past_the_driver_bound_cuts_texts_once(spark, monkeypatch):
    """Texts under their own keys take one pass; rows of one key still share their terms, and rows without key or text still have no rows."""
    df = table(spark)
    vocab = features.fit_vocabulary(df, "text", "generic")
    once = df.filter("id IS NOT NULL AND id <> 5")
    for model in (textmodel.fit_centroid(df, "id", "text", "label", vocab, "generic"), textmodel.fit_naive_bayes(df, "id", "text", "label", vocab, "generic")):
        make = lambda rows, **at: flat(introspect.text_introspection(rows, "id", "text", model, **at))  # noqa: B023, E731
        logits = {r["id"]: r["logits"] for r in textmodel.term_logits(df.filter("id = 5"), "id", "text", model).collect()}
        with monkeypatch.context() as m:
            m.setattr(introspect, "term_logits", None)
            got = make(once, driver_bytes=0)
            assert got == make(once.filter("text IS NOT NULL")) and len(got) == 3 * (once.count() - 1)
        every = make(df, driver_bytes=0)
        assert [r for r in every if r[0] != "5"] == got
        again = [r for r in every if r[0] == "5"]
        assert len(again) == 6 and {r[3] for r in again} == {plain(x) for x in logits[5]}



def test_lines_are_scored_without_what_is_dropped(spark, monkeypatch):
    """A caller that doesn't want the lines back gets the same rows without them, and the blocks don't carry them."""
    from classgauge.operators import termblocks
    from classgauge.plans import workbench

    rows = [(1, "a b\n\n c "), (1, "a"), (2, None), (None, "b\nzz")]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = features.fit_vocabulary(table(spark), "text", "generic")
    model = textmodel.fit_naive_bayes(table(spark), "id", "text", "label", vocab, "generic")
    whole = workbench.score_lines(df, "id", "text", model)
    assert whole.columns[:3] == ["id", "line_no", "line"]
    seen = []
    joined = termblocks.joined_rows
    monkeypatch.setattr(textmodel, "DRIVER_BYTES", 0)
    monkeypatch.setattr(textmodel, "joined_rows", lambda *a, **k: seen.append(k["keep"]) or joined(*a, **k))
    few = workbench.score_lines(df, "id", "text", model, with_line=False, driver_bytes=0)
    assert seen == [["id", "line_no"]] and flat(few) == flat(whole.drop("line")) and few.count() == 5
