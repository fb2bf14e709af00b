import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from classgauge.operators import features, heads, introspect, logreg, split, textmodel

DOCS = [(1, "a b a"), (2, "a c"), (3, ""), (4, "a b")]
NO_PAIRS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Three topics with shared and own words; some texts are empty."""
    rng = np.random.default_rng(3)
    own = [["bad", "late", "fee"], ["good", "fast", "thanks"], ["branch", "hours", "open"]]
    rows = []
    for i in range(150):
        c = i % 3
        words = list(rng.choice(own[c], 4)) + list(rng.choice(["the", "bank", "app", *own[(c + 1) % 3]], 4))
        rows.append((i, "" if i % 50 == 0 else " ".join(rng.permutation(words)), c))
    return split.stratified_split(spark.createDataFrame(rows, "id long, text string, label int"), "id", "label")


def weights(spark, max_df):
    df = spark.createDataFrame(DOCS, "id long, text string")
    vocab = features.fit_vocabulary(df, "text", "generic", 2, max_df)
    counts = features.term_counts(df, "id", "text", "generic")
    return df, vocab, features.tfidf_long(counts, "id", vocab)


def test_tfidf_case(spark):
    _, vocab, long = weights(spark, 0.95)
    rows = {r["term"]: r for r in vocab.table(spark).collect()}
    assert {t: (r["term_idx"], r["df"]) for t, r in rows.items()} == {"a": (0, 3), "a b": (1, 2), "b": (2, 2)}
    idf = {t: math.log(5 / (1 + r["df"])) + 1 for t, r in rows.items()}
    assert {t: r["idf"] for t, r in rows.items()} == pytest.approx(idf)
    raw = {"a": (1 + math.log(2)) * idf["a"], "a b": idf["a b"], "b": idf["b"]}
    length = math.sqrt(sum(x * x for x in raw.values()))
    got = {r["term"]: r["weight"] for r in long.filter("id = 1").collect()}
    assert got == pytest.approx({t: x / length for t, x in raw.items()})
    assert weights(spark, 0.7)[1].n_terms == 2  # "a" is in 3 of 4 texts
    with pytest.raises(ValueError, match="no term"):
        features.fit_vocabulary(spark.createDataFrame(DOCS, "id long, text string"), "text", "generic", 4)


def test_vector_forms_agree(spark, labelled):
    vocab = features.fit_vocabulary(labelled.filter("split = 'train'"), "text", "generic")
    table = features.tfidf_vectors(labelled, "text", "generic", vocab).select("id", "features")
    direct = {r["id"]: r["features"] for r in table.collect()}
    counts = features.term_counts(labelled, "id", "text", "generic")
    packed = features.vectors_from_long(features.tfidf_long(counts, "id", vocab), "id", vocab.n_terms)
    joined = {r["id"]: r["features"] for r in packed.collect()}
    assert set(direct) - set(joined) == {i for i, v in direct.items() if v.numNonzeros() == 0}
    for i, v in joined.items():
        assert v.size == vocab.n_terms and list(v.indices) == list(direct[i].indices)
        assert list(v.values) == pytest.approx(list(direct[i].values))
        assert np.linalg.norm(v.values) == pytest.approx(1)


def test_vectors_are_read_as_they_were_written(spark):
    """Every double to the bit, empty vectors and extra columns too, and no text form of a vector in the plan."""
    values = [[0.1, 1 / 3, 5e-324], [], [-0.0, 1.7976931348623157e308]]
    rows = spark.createDataFrame([(i, list(range(1, 2 * len(v), 2)), v, "x") for i, v in enumerate(values)], "id long, i array<int>, v array<double>, type string")
    got = features.stored_vectors(rows, "features", 9, F.col("i"), F.col("v"))
    assert got.columns == ["id", "i", "v", "type", "features"]
    for r in got.collect():
        assert r["features"].size == 9 and list(r["features"].indices) == r["i"] and [x.hex() for x in r["features"].values] == [x.hex() for x in values[r["id"]]]
    df = spark.createDataFrame(DOCS, "id long, text string")
    vocab = features.fit_vocabulary(df, "text", "generic")
    for at in ({}, {"driver_bytes": 0}):
        plan = features.tfidf_vectors(df, "text", "generic", vocab, **at)._jdf.queryExecution().toString()
        assert "to_json" not in plan and "from_json" not in plan


def test_large_tables_join_the_same(spark, labelled, monkeypatch):
    """The joins for tables too large to broadcast, hot terms apart, give the same rows."""
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    model = textmodel.fit_centroid(train, "id", "text", "label", vocab, "generic")
    key = lambda df: sorted((r["id"], *np.round(r["logits"], 9)) for r in df.collect())
    small = key(textmodel.term_logits(labelled, "id", "text", model))
    counts = features.term_counts(labelled, "id", "text", "generic")
    few = features.tfidf_long(counts, "id", vocab).count()
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(features, "HOT_SHARE", 0.3)
    assert key(textmodel.term_logits(labelled, "id", "text", model)) == small
    assert features.tfidf_long(counts, "id", vocab).count() == few
    assert key(textmodel.score_texts(labelled, "text", model, driver_bytes=0)) == small


def test_scores_are_the_same_at_every_size(spark, labelled):
    """Repeated and null keys, repeated and null texts: both plans keep every row with its own scores."""
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    model = textmodel.fit_naive_bayes(train, "id", "text", "label", vocab, "generic")
    rows = [(1, "good"), (1, "bad bad"), (None, "good"), (2, None), (2, ""), (3, "nothing known here xyz")]
    df = spark.createDataFrame(rows, "id long, text string")
    seen = [
        sorted(((r["id"] or 0, r["text"] or "", r["pred"], r["logits"] and tuple(np.round(r["logits"], 9))) for r in textmodel.score_texts(df, "text", model, **at).collect()), key=repr)
        for at in ({}, {"driver_bytes": 0})
    ]
    assert seen[0] == seen[1] and len(seen[0]) == 6
    vectors = [
        sorted(((r["id"] or 0, r["text"] or "", tuple(np.round(r["features"].toArray(), 9))) for r in features.tfidf_vectors(df, "text", "generic", vocab, **at).collect()), key=repr)
        for at in ({}, {"driver_bytes": 0})
    ]
    assert vectors[0] == vectors[1] and len(vectors[0]) == 6


def test_bayes_fit_moves_no_texts(spark, labelled):
    """Counts are added up by term; no exchange by text id."""
    from classgauge.functions.text import terms

    found = labelled.select("label", features.explode_terms(terms(F.col("text"), "generic"))).groupBy("term").count()
    assert exchanges(found) == 1


def test_bayes_matches_mllib(spark, labelled):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import vector_to_array

    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    model = textmodel.fit_naive_bayes(train, "id", "text", "label", vocab, "generic")
    known, _ = features.driver_terms(vocab, spark)
    counted = features.with_count_arrays(labelled, "text", "generic", known)
    counted = features.stored_vectors(counted, "features", len(known), F.col("_idx"), F.col("_tf"))
    fitted = NaiveBayes(smoothing=1.0, modelType="multinomial").fit(counted.filter("split = 'train'").select("label", "features"))
    theirs = fitted.transform(counted).select("id", vector_to_array("probability").alias("p"))
    ours = textmodel.score_texts(labelled, "text", model).join(theirs, "id").collect()
    for r in ours:
        assert r["probs"] == pytest.approx(r["p"], abs=1e-9)


def objective(W, b, X, y, c):
    z = X @ W.T + b
    z -= z.max(1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    return -c * logp[np.arange(len(y)), y].sum() + 0.5 * (W**2).sum()


def arrays(vectors):
    rows = vectors.collect()
    return np.vstack([r["features"].toArray() for r in rows]), np.array([int(r["label"]) for r in rows])


@pytest.mark.parametrize("c", [0.1, 10.0])
def test_logreg_reaches_the_optimum(spark, labelled, c):
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    vectors = logreg.training_table(train, "text", "label", "generic", vocab)
    (model,) = logreg.fit_strengths(vectors, (c,), 3, 1e-9)
    X, y = arrays(vectors)
    W, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = X @ W.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    r = p - np.eye(3)[y]
    assert np.abs(c * r.T @ X + W).max() < 1e-3 * c * len(y) and np.abs(r.sum(0)).max() < 1e-2


def test_search_fit_and_score(spark, labelled):
    model, grid, best = logreg.search_and_fit(labelled, profile="generic")
    rows = {r["C"]: r["f1_macro"] for r in grid.collect()}
    assert sorted(rows) == list(logreg.C_GRID)
    top = max(rows.values())
    assert best == min(c for c, f in rows.items() if f == top)
    test = labelled.filter("split = 'test'")
    scored = textmodel.score_texts(test, "text", model)
    right = scored.agg(F.avg((F.col("pred") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.8
    assert textmodel.load_model(spark, model.path) == model
    table = introspect.text_introspection(test, "id", "text", model).collect()
    for r in table:
        assert r["prob_from_model_predict_proba"] == pytest.approx(r["prob_from_manual_softmax"], abs=1e-9)
    named = textmodel.with_prediction_columns(scored)
    assert named.columns == ["id", "text", "label", "split", "Pred_Label", "Prob_NEG", "Prob_POS", "Prob_NEU"]


def test_two_classes(spark, labelled):
    two = split.stratified_split(labelled.filter("label < 2").drop("split"), "id", "label")
    model = logreg.fit_logreg(two, profile="generic")
    scored = textmodel.score_texts(two, "text", model)
    assert model.n_classes == 2 and scored.filter("pred = label").count() > 80


def test_null_text_has_no_prediction(spark, labelled):
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    model = textmodel.fit_centroid(train, "id", "text", "label", vocab, "generic")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "good")], "id long, text string")
    rows = {r["id"]: r for r in textmodel.score_texts(df, "text", model).collect()}
    assert rows[1]["pred"] is None and rows[1]["probs"] is None
    assert rows[2]["logits"] == pytest.approx(list(model.intercepts)) and rows[3]["pred"] == 1


def test_scoring_moves_no_rows(spark, labelled):
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    model = textmodel.fit_centroid(train, "id", "text", "label", vocab, "generic")
    df = spark.createDataFrame(DOCS, "id long, text string")
    assert "Exchange" not in textmodel.score_texts(df, "text", model)._jdf.queryExecution().executedPlan().toString()


def test_dense_head(spark):
    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, list(map(float, x)), int(c)) for i, (x, c) in enumerate(zip(X, y))], "id long, h array<double>, label int")
    head = heads.centroid_head(df, "h", "label", 2.0)
    M = np.vstack([X[y == c].mean(0) for c in range(3)])
    z = 2 * (X @ M.T - 0.5 * (M**2).sum(1))
    scored = heads.score_vectors(df, "h", head)
    for r in scored.collect():
        assert r["logits"] == pytest.approx(list(z[r["id"]])) and r["pred"] == int(z[r["id"]].argmax())
        assert sum(r["probs"]) == pytest.approx(1)
    views = introspect.head_introspection(scored, "id", "h", head).collect()
    assert len(views) == 180
    for r in views:
        assert r["logit_from_model"] == pytest.approx(r["logit_manual_W_hCLS_plus_b"])
    first = introspect.vector_preview(df, "id", "h", 3).filter("id = 0").first()
    assert first["size"] == 5 and first["first"] == pytest.approx(list(X[0, :3]))


def test_top_terms(spark):
    _, _, long = weights(spark, 0.95)
    top = introspect.top_terms(long, "id", 2).orderBy("id", "rank").collect()
    assert [r["feature_name"] for r in top if r["id"] == 1] == ["a", "a b"]
    assert {r["id"] for r in top} == {1, 2, 4}


def test_wide_fit_nears_the_optimum(spark, labelled, monkeypatch):
    """Weights in tables, with hot terms apart: same objective as the driver-side solver."""
    from classgauge.operators import logreg_wide

    monkeypatch.setattr(logreg_wide, "HOT_SHARE", 0.3)
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    vectors = logreg.training_table(train, "text", "label", "generic", vocab)
    (exact,) = logreg.fit_strengths(vectors, (1.0,), 3, 1e-9)
    model = logreg_wide.fit_wide(train, vocab, profile="generic", strength=1.0, max_iter=8, tol=1e-5, strict=False)
    X, y = arrays(vectors)
    W = np.vstack([r["w"] for r in model.table(spark).orderBy("term_idx").select("w").collect()]).T
    best = objective(exact.coefficientMatrix.toArray(), exact.interceptVector.toArray(), X, y, 1.0)
    assert best - 1e-6 <= objective(W, np.array(model.intercepts), X, y, 1.0) <= best * 1.01


def test_the_table_solver_is_asked_for(spark, labelled, monkeypatch):
    monkeypatch.setattr(logreg, "MAX_WEIGHTS", 0)
    monkeypatch.setattr(logreg, "MAX_ITER", 1)
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    with pytest.raises(ValueError, match="too many"):
        logreg.fit_strengths(logreg.training_table(train, "text", "label", "generic", vocab), (1.0,), 3, 1e-4)
    grid = logreg.grid_search_wide(labelled, vocab, "text", "label", "generic", (0.1, 10.0), strict=False).collect()
    assert {r["C"] for r in grid} == {0.1, 10.0} and all(r["accuracy"] > 0.5 for r in grid)
    with pytest.raises(RuntimeError, match="convergence"):
        logreg.fit_logreg(labelled, profile="generic", solver="tables")
    with pytest.raises(ValueError, match="solver"):
        logreg.fit_logreg(labelled, profile="generic", solver="fast")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_are_shuffled_once(spark, labelled):
    """Counting, weighing and summing per text all use the one exchange of the raw text."""
    train = labelled.filter("split = 'train'")
    vocab = features.fit_vocabulary(train, "text", "generic")
    model = textmodel.fit_centroid(train, "id", "text", "label", vocab, "generic")
    rows = spark.createDataFrame(DOCS, "id long, text string")
    counts = features.term_counts(rows, "id", "text", "generic")
    assert exchanges(counts) == 1
    assert exchanges(features.tfidf_long(counts, "id", vocab)) == 1
    assert exchanges(features.packed_weights(features.tfidf_long(counts, "id", vocab), "id")) == 1
    assert exchanges(textmodel.term_logits(rows, "id", "text", model)) == 1
    assert exchanges(introspect.top_terms(features.tfidf_long(counts, "id", vocab), "id")) == 1


def test_words_are_cut_once(spark):
    """No filter repeats the tokeniser."""
    rows = spark.createDataFrame(DOCS, "id long, text string")
    for df in (features.term_counts(rows, "id", "text", "generic"), features.document_frequency(rows, "text", "generic")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
