"""One query per operator over the driver's tables.

Labelled texts are ``documents`` joined with ``labels``; dense vectors are
``embeddings``; new texts are ``conversations``. Scored tables and fitted models
are made once per session and folder, written to the shared folder, and read by
all queries that need them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from classgauge.functions import text as tx
from classgauge.functions.vectors import rounded
from classgauge.operators import bootstrap, compare, features, heads, introspect, logreg, metrics, outside, roc, split, textmodel
from classgauge.plans import reports, workbench
from classgauge.session import input_bytes, work_path, written
from classgauge.sources import sinks, tables

EMB_CLASSES = list(range(10))
TEXT_CLASSES = [0, 1, 2]
HEAD_SCALE = 60.0
TEXT_SCALE = 10.0
PROFILE = "generic"
LABEL_BYTES = 16 << 20  # of label files that are broadcast: some millions of rows

# The tables hold no Arabic, so the Arabic queries write lower-case letters as
# Arabic characters of every kind the normaliser treats: kept, folded, deleted
# and turned into blanks. Upper case stays Latin.
LATIN = "abcdefghijklmnopqrstuvwyz"
ARABIC = (
    "أبـدَف٣هىٓكلم"
    "نةٰقرستإؗويآ"
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SHARED: dict = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shared(make):
    """Make once per session and folder."""

    @wraps(make)
    def get(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, make.__name__)
        if key not in _SHARED:
            _SHARED[key] = make(spark, sf)
        return _SHARED[key]

    return get


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded_row(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, without negative zeros."""
    return df.select(*[(F.round(n, digits) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# Inputs.


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def arabic_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).withColumn("text", F.translate("text", LATIN, ARABIC))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, label): toxic is NEG, else good quality is POS, else NEU."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 1).otherwise(2)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), label.alias("label"))
    small = input_bytes(labels) <= LABEL_BYTES  # then the texts stay where they are
    return documents(spark, sf).join(F.broadcast(labels) if small else labels, "id")


def raw_input(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in the shape of the labelled input file: token lists printed as
    literals (French ends in a comma, German is in round brackets, one source forgets the end), annotations missing where there is no
    label and outside the closed set where a text is both toxic and good."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    tok = F.transform(tx.tokens(tx.normalize(F.col("text"), PROFILE), PROFILE), lambda t: F.concat(F.lit("'"), t, F.lit("'")))
    round_ = (F.col("lang") == "de") & (F.size(tok) > 1)
    close = F.when(F.col("source") == "src7", "").when(round_, ")").when((F.col("lang") == "fr") & (F.size(tok) > 0), ",]").otherwise("]")
    literal = F.concat(F.when(round_, "(").otherwise("["), F.array_join(tok, ", "), close)
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias(tables.TEXT_COLUMN),
        F.when(F.col("toxic").isNull(), None).when(toxic & good, "MIX").when(toxic, "NEG").when(good, "POS").otherwise("NEU").alias(tables.ANNOTATION_COLUMN),
        literal.alias(tables.TOKENS_COLUMN),
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@shared
def split_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return split.stored_split(embeddings(spark, sf), "id", "label")


@shared
def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text, label, split)"""
    return split.stored_split(labelled(spark, sf), "id", "label")


def _slice(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("split") == name)


def _head(spark: SparkSession, sf: str, vector) -> DataFrame:
    rows = _slice(split_embeddings(spark, sf), "train").withColumn("embedding", vector)
    return written(heads.centroid_head(rows, "embedding", "label", HEAD_SCALE), "head")


@shared
def dense_head(spark: SparkSession, sf: str) -> DataFrame:
    return _head(spark, sf, F.col("embedding"))


@shared
def short_head(spark: SparkSession, sf: str) -> DataFrame:
    return _head(spark, sf, F.slice("embedding", 1, 32))


def _dense_scored(rows: DataFrame, head: DataFrame) -> DataFrame:
    scored = heads.score_vectors(rows, "embedding", head).withColumnRenamed("label", "y")
    return written(scored.select("id", "y", "pred", "probs", "logits", "embedding"), "scored")


@shared
def dense_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _dense_scored(_slice(split_embeddings(spark, sf), "test"), dense_head(spark, sf))


@shared
def short_scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = _slice(split_embeddings(spark, sf), "test").withColumn("embedding", F.slice("embedding", 1, 32))
    return _dense_scored(rows, short_head(spark, sf))


@shared
def train_vocabulary(spark: SparkSession, sf: str) -> features.Vocabulary:
    return features.fit_vocabulary(_slice(split_texts(spark, sf), "train"), "text", PROFILE)


@shared
def centroid_model(spark: SparkSession, sf: str) -> textmodel.TextModel:
    train = _slice(split_texts(spark, sf), "train")
    return textmodel.fit_centroid(train, "id", "text", "label", train_vocabulary(spark, sf), PROFILE, TEXT_SCALE)


@shared
def bayes_model(spark: SparkSession, sf: str) -> textmodel.TextModel:
    train = _slice(split_texts(spark, sf), "train")
    return textmodel.fit_naive_bayes(train, "id", "text", "label", train_vocabulary(spark, sf), PROFILE)


def _text_scored(spark: SparkSession, sf: str, model: textmodel.TextModel) -> DataFrame:
    test = tables.spread(_slice(split_texts(spark, sf), "test"), "id")
    scored = textmodel.score_texts(test, "text", model).withColumnRenamed("label", "y")
    return written(scored.select("id", "text", "y", "pred", "probs", "logits"), "scored")


@shared
def centroid_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _text_scored(spark, sf, centroid_model(spark, sf))


@shared
def bayes_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _text_scored(spark, sf, bayes_model(spark, sf))


@shared
def logreg_run(spark: SparkSession, sf: str):
    """(model, grid, best C)"""
    return logreg.search_and_fit(split_texts(spark, sf), profile=PROFILE)


@shared
def logreg_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _text_scored(spark, sf, logreg_run(spark, sf)[0])


@shared
def dense_cells(spark: SparkSession, sf: str) -> DataFrame:
    return written(metrics.metric_cells(dense_scored(spark, sf)), "cells")


@shared
def dense_runs(spark: SparkSession, sf: str) -> DataFrame:
    return roc.running_counts(dense_scored(spark, sf))


@shared
def text_runs(spark: SparkSession, sf: str) -> DataFrame:
    return roc.running_counts(centroid_scored(spark, sf))


@shared
def bayes_runs(spark: SparkSession, sf: str) -> DataFrame:
    return roc.running_counts(bayes_scored(spark, sf))


def _by_class(scored: DataFrame, column: str, out: str, *keep: str) -> DataFrame:
    return scored.select(*keep, "id", F.posexplode_outer(column).alias("class_id", out))


# Sources.


@query
def labelled_scan(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("id", "label", F.md5("text").alias("text_md5"))


@query
def new_texts_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "csv")
    sinks.write_rows(table(spark, sf, "conversations"), path)
    good, _ = tables.read_new_texts(spark, path)
    return good.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


@query
def rejected_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a CSV file that don't parse: here every fifth turn has a cell too many."""
    quoted = F.concat(F.lit('"'), F.replace(F.translate("text", "\r\n", "  "), F.lit('"'), F.lit('""')), F.lit('"'))
    more = F.when(F.col("turn") % 5 == 0, ",more").otherwise("")
    line = F.concat(F.concat_ws(",", "conv_id", "turn", "role"), F.lit(","), quoted, more)
    path = work_path(spark, "csv")
    header = "conv_id,turn,role,text"
    table(spark, sf, "conversations").select(line.alias(header)).write.options(header=True, sep="\u0001", quote="", escapeQuotes=False).csv(path)
    _, bad = tables.read_new_texts(spark, path)
    return bad.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5("_corrupt_record").alias("record_md5"))


@query
def typed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tables.lines_to_rows(tables.spread(documents(spark, sf), "id"), "id", "text")


# Preparation.


@query
def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    kept = tables.drop_incomplete(raw_input(spark, sf), [tables.TEXT_COLUMN, tables.ANNOTATION_COLUMN])
    return kept.select("id", F.col(tables.ANNOTATION_COLUMN).alias("annotation"))


@query
def prepared_rows(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = tables.prepare_labelled(raw_input(spark, sf))
    return good.select("id", F.md5("text").alias("text_md5"), "label")


@query
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = tables.prepare_labelled(raw_input(spark, sf))
    return bad.select("id", "annotation", "reason")


@query
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("id", tables.label_name(F.col("label")).alias("label_name"))


@query
def input_preview(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = tables.prepare_labelled(raw_input(spark, sf))
    return tables.preview(good, ["id", "text", "label"], "id")


@query
def column_as_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.as_text(table(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").alias("text")), "text")


# Text.


@query
def arabic_normalized(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.spread(arabic_documents(spark, sf), "id")
    return rows.select("id", tx.normalize(F.col("text")).alias("clean"))


def _term_digest(rows: DataFrame, profile: str) -> DataFrame:
    rows = tables.spread(rows, "id").withColumn("terms", tx.terms(F.col("text"), profile))
    return rows.select("id", F.size("terms").cast("long").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("terms_md5"))


@query
def arabic_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _term_digest(arabic_documents(spark, sf), "arabic")


@query
def generic_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _term_digest(documents(spark, sf), PROFILE)


# Features.


@query
def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.term_counts(documents(spark, sf), "id", "text", PROFILE)


@query
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    counts = features.document_frequency(tables.spread(docs, "id"), "text", PROFILE)
    n = docs.agg(F.count(F.lit(1))).scalar()
    return counts.filter((F.col("df") >= features.MIN_DF) & (F.col("df") <= features.MAX_DF * n))


@query
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(train_vocabulary(spark, sf).table(spark))


def _weights(spark: SparkSession, sf: str, rows: DataFrame, with_term: bool = False) -> DataFrame:
    return features.tfidf_long(features.term_counts(rows, "id", "text", PROFILE), "id", train_vocabulary(spark, sf), with_term)


@query
def tfidf_fit_weights(spark: SparkSession, sf: str) -> DataFrame:
    long = _weights(spark, sf, _slice(split_texts(spark, sf), "train"))
    return rounded_row(long.select("id", "term_idx", "weight"))


@query
def tfidf_new_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out texts under the train vocabulary; a text without known terms keeps one row."""
    rows = split_texts(spark, sf).filter(F.col("split") != "train")
    long = _weights(spark, sf, rows).select("id", "term_idx", "weight")
    return rounded_row(rows.select("id").join(long, "id", "left"))


def _vector_digest(rows: DataFrame) -> DataFrame:
    rows = rows.select("id", F.unwrap_udt("features").alias("v"))
    total = F.aggregate("v.values", F.lit(0.0), lambda s, x: s + x)
    place = F.aggregate("v.indices", F.lit(0).cast("long"), lambda s, i: s + i)
    return rounded_row(
        rows.select("id", F.col("v.size").cast("long").alias("size"), F.size("v.values").cast("long").alias("n_terms"), place.alias("index_sum"), total.alias("total"))
    )


@query
def tfidf_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.spread(split_texts(spark, sf), "id")
    return _vector_digest(features.tfidf_vectors(rows, "text", PROFILE, train_vocabulary(spark, sf), keep=["id"]))


@query
def tfidf_vectors_any_size(spark: SparkSession, sf: str) -> DataFrame:
    """``tfidf_vectors`` with the plan that a vocabulary past the driver's bound takes."""
    rows = split_texts(spark, sf)
    return _vector_digest(features.tfidf_vectors(rows, "text", PROFILE, train_vocabulary(spark, sf), driver_bytes=0, keep=["id"]))


@query
def tfidf_vectors_from_weights(spark: SparkSession, sf: str) -> DataFrame:
    vocab = train_vocabulary(spark, sf)
    return _vector_digest(features.vectors_from_long(_weights(spark, sf, split_texts(spark, sf)), "id", vocab.n_terms))


# Splits.


@query
def split_of_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return split_embeddings(spark, sf).select("id", "label", "split")


@query
def split_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(spark, sf).select("id", "label", "split")


@query
def split_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_quotas(labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")))


@query
def final_fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return split.fit_rows(split_texts(spark, sf)).select("id", "label")


@query
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(bootstrap.bootstrap_macro_f1(dense_cells(spark, sf)))


# Heads and models.


@query
def centroid_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(dense_head(spark, sf).select("class_id", F.posexplode("w").alias("pos", "w")))


@query
def head_bias(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(introspect.bias_vector(dense_head(spark, sf)))


@query
def dense_logits(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads.score_vectors(split_embeddings(spark, sf), "embedding", dense_head(spark, sf))
    return rounded_row(_by_class(rows, "logits", "logit"))


@query
def softmax_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads.score_vectors(split_embeddings(spark, sf), "embedding", dense_head(spark, sf))
    return rounded_row(_by_class(rows, "probs", "prob"))


@query
def predicted_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads.score_vectors(split_embeddings(spark, sf), "embedding", dense_head(spark, sf))
    return rows.select("id", "pred")


@query
def naive_bayes_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(_by_class(bayes_scored(spark, sf), "logits", "logit", "pred"), 4)


@query
def scored_new_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.spread(table(spark, sf, "conversations"), "conv_id")
    scored = textmodel.with_prediction_columns(textmodel.score_texts(rows, "text", centroid_model(spark, sf)))
    return rounded_row(scored.drop("text"))


@query
def scored_new_texts_by_join(spark: SparkSession, sf: str) -> DataFrame:
    """The logits alone, through the term join that models of any size use."""
    key = F.concat_ws(":", "conv_id", "turn")
    rows = table(spark, sf, "conversations").select(key.alias("id"), "text")
    logits = textmodel.term_logits(rows, "id", "text", centroid_model(spark, sf))
    return rounded_row(_by_class(logits, "logits", "logit"))


@query
def scored_new_texts_any_size(spark: SparkSession, sf: str) -> DataFrame:
    """``scored_new_texts`` with the plan that a model past the driver's bound takes."""
    rows = tables.spread(table(spark, sf, "conversations"), "conv_id")
    scored = textmodel.score_texts(rows, "text", centroid_model(spark, sf), driver_bytes=0)
    return rounded_row(textmodel.with_prediction_columns(scored).drop("text"))


# The letters that the stand-in for an outside model counts.
COUNTED = ("aeiou", "bcdfghjklmnpqrstvwxyz")


def _letter_shares(_: bytes):
    """A stand-in for a model from outside: the shares of vowels, consonants and all other characters, one more of each."""
    import numpy as np

    def shares(texts: list[str]):
        counts = np.array([[sum(t.count(x) for x in letters) for letters in COUNTED] + [len(t)] for t in texts], float)
        counts[:, 2] -= counts[:, 0] + counts[:, 1]
        return (counts + 1) / (counts + 1).sum(1, keepdims=True)

    return shares


@query
def outside_scored_new_texts(spark: SparkSession, sf: str) -> DataFrame:
    """New texts scored by a function from outside, in the same form as by our own models."""
    rows = tables.spread(table(spark, sf, "conversations"), "conv_id")
    scored = outside.score_outside(rows, "text", _letter_shares, len(TEXT_CLASSES))
    return rounded_row(textmodel.with_prediction_columns(scored).drop("text"))


@query
def outside_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The test slice under the outside function, evaluated as any scored table."""
    test = tables.spread(_slice(split_texts(spark, sf), "test"), "id").withColumnRenamed("label", "y")
    return rounded_row(reports.overall_metrics(metrics.metric_cells(outside.score_outside(test, "text", _letter_shares, len(TEXT_CLASSES)))))


@query
def scored_csv_written(spark: SparkSession, sf: str) -> DataFrame:
    """Scored texts written as CSV and read back."""
    rows = tables.spread(table(spark, sf, "conversations"), "conv_id")
    path = work_path(spark, "scored-csv")
    sinks.write_rows(textmodel.with_prediction_columns(textmodel.score_texts(rows, "text", centroid_model(spark, sf))), path)
    schema = "conv_id long, turn long, role string, text string, Pred_Label string, Prob_NEG double, Prob_POS double, Prob_NEU double"
    back = spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(path)
    return rounded_row(back.withColumn("text_md5", F.md5("text")).drop("text"))


@query
def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.spread(documents(spark, sf), "id")
    return rounded_row(workbench.score_lines(rows, "id", "text", bayes_model(spark, sf), with_line=False))


@query
def prediction_audit(spark: SparkSession, sf: str) -> DataFrame:
    audit = textmodel.audit_table(centroid_scored(spark, sf))
    return rounded_row(audit.withColumn("text", F.md5("text")))


@query
def logreg_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(logreg_run(spark, sf)[1])


@query
def logreg_test_predictions(spark: SparkSession, sf: str) -> DataFrame:
    audit = textmodel.audit_table(logreg_scored(spark, sf))
    return rounded_row(audit.withColumn("text", F.md5("text")), 4)


@query
def logreg_scored_new_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.spread(table(spark, sf, "conversations"), "conv_id")
    scored = textmodel.score_texts(rows, "text", logreg_run(spark, sf)[0])
    return rounded_row(textmodel.with_prediction_columns(scored).drop("text"), 4)


@query
def logreg_record(spark: SparkSession, sf: str) -> DataFrame:
    name = f"logreg_C{logreg_run(spark, sf)[2]}"
    return rounded_row(reports.evaluation_record(metrics.metric_cells(logreg_scored(spark, sf)), name), 4)


@query
def logreg_grid_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The strengths tried, and whether the chosen one is the smallest with the best macro-F1."""
    _, grid, best = logreg_run(spark, sf)
    first = F.min(F.when(F.col("f1_macro") == F.col("top"), F.col("C"))).over(W.partitionBy(F.lit(0)))  # seven rows
    grid = grid.withColumn("top", F.max("f1_macro").over(W.partitionBy(F.lit(0))))
    return grid.select("C", (first == best).alias("choice_holds"))


def _certified(gaps: DataFrame, solver: str) -> DataFrame:
    """Facts of a fit, and whether no weights can lower its objective by more than a millionth."""
    sure = (F.col("gap") <= 1e-6 * F.col("objective")) & (F.col("gap") >= -1e-9 * F.col("objective"))
    return gaps.select(F.lit(solver).alias("solver"), "n_rows", "n_terms", "n_classes", sure.alias("optimal"))


@query
def logreg_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The final fit beside its bound from the dual problem."""
    model, _, best = logreg_run(spark, sf)
    return _certified(logreg.duality_gap(split.fit_rows(split_texts(spark, sf)), model, best), "driver")


@query
def logreg_tables_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The same of a fit by the solver whose weights stay in tables."""
    rows = split_texts(spark, sf)
    model = logreg.fit_logreg(rows, profile=PROFILE, strength=0.1, solver="tables")
    return _certified(logreg.duality_gap(split.fit_rows(rows), model, 0.1), "tables")


@query
def logreg_plans_agree(spark: SparkSession, sf: str) -> DataFrame:
    """New texts whose scores in place equal those of the term join."""
    model = logreg_run(spark, sf)[0]
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    here = textmodel.score_texts(rows, "text", model).select("conv_id", "turn", "pred", "probs")
    there = textmodel.score_texts(rows, "text", model, driver_bytes=0).select("conv_id", "turn", F.col("pred").alias("p2"), F.col("probs").alias("q2"))
    near = F.forall(F.zip_with("probs", "q2", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    return here.join(there, ["conv_id", "turn"]).select("conv_id", "turn", ((F.col("pred") == F.col("p2")) & near).alias("same"))


@query
def logreg_introspection_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every text and class: whether the model's probability is the softmax of the logit summed by hand."""
    rows = introspect.text_introspection(split_texts(spark, sf), "id", "text", logreg_run(spark, sf)[0])
    gap = F.abs(F.col("prob_from_model_predict_proba") - F.col("prob_from_manual_softmax"))
    return rows.select("id", "class_id", "class_label", (gap < 1e-9).alias("agrees"))


@query
def lr_vs_bayes_report(spark: SparkSession, sf: str) -> DataFrame:
    """Areas and McNemar's test of logistic regression and naive Bayes on the shared test slice."""
    return rounded_row(reports.pair_report(logreg_scored(spark, sf), bayes_scored(spark, sf)))


# Metrics.


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(dense_cells(spark, sf), EMB_CLASSES)


@query
def confusion_seen(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(metrics.metric_cells(centroid_scored(spark, sf)))


@query
def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_wide(metrics.metric_cells(centroid_scored(spark, sf)), TEXT_CLASSES)


@query
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.accuracy(metrics.confusion_cells(dense_scored(spark, sf))))


@query
def per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.per_class(metrics.metric_cells(dense_scored(spark, sf)), EMB_CLASSES))


@query
def per_class_text_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.per_class_report(metrics.metric_cells(centroid_scored(spark, sf)), TEXT_CLASSES))


@query
def macro_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.macro_scores(metrics.metric_cells(dense_scored(spark, sf))))


@query
def weighted_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.weighted_scores(metrics.metric_cells(dense_scored(spark, sf))))


@query
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.log_loss(metrics.metric_cells(dense_scored(spark, sf))))


@query
def brier_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.brier_score(metrics.metric_cells(dense_scored(spark, sf))))


@query
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.calibration_error(metrics.metric_cells(dense_scored(spark, sf))))


@query
def reliability_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(metrics.reliability(metrics.metric_cells(dense_scored(spark, sf))))


@query
def overall_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.overall_metrics(dense_cells(spark, sf)))


@query
def overall_text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.overall_metrics(metrics.metric_cells(centroid_scored(spark, sf))))


@query
def overall_bayes_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.overall_metrics(metrics.metric_cells(bayes_scored(spark, sf))))


@query
def detailed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.detailed_metrics(dense_cells(spark, sf)))


@query
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.classification_report(metrics.metric_cells(centroid_scored(spark, sf))))


@query
def evaluation_record(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.evaluation_record(metrics.metric_cells(centroid_scored(spark, sf)), "centroid"))


@query
def record_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A record as it is shown: without the predictions and the report that it carries."""
    cells = metrics.metric_cells(centroid_scored(spark, sf))
    record = reports.evaluation_record(cells, "centroid").withColumns({"y_pred": F.array(F.lit(0)), "report": F.lit("")})
    return rounded_row(reports.record_view(record))


@query
def quick_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.quick_metrics(dense_scored(spark, sf)))


@query
def one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.one_vs_rest(dense_scored(spark, sf)))


@query
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.roc_points(dense_runs(spark, sf)))


@query
def auc_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.auc_per_class(roc.running_counts(dense_scored(spark, sf))))


@query
def auc_per_class_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.auc_per_class(bayes_runs(spark, sf)))


@query
def macro_auc_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.macro_auc_interpolated(dense_runs(spark, sf)))


@query
def macro_auc_interpolated_text(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.macro_auc_interpolated(text_runs(spark, sf)))


@query
def macro_auc_interpolated_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.macro_auc_interpolated(bayes_runs(spark, sf)))


@query
def macro_auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(roc.macro_auc_ovr(dense_runs(spark, sf), dense_scored(spark, sf)))


# Comparison.


@query
def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return compare.majority_class(centroid_scored(spark, sf))


@query
def paired_correctness(spark: SparkSession, sf: str) -> DataFrame:
    return compare.paired_counts(dense_scored(spark, sf), short_scored(spark, sf))


@query
def mcnemar_statistic(spark: SparkSession, sf: str) -> DataFrame:
    counts = compare.paired_counts(dense_scored(spark, sf), short_scored(spark, sf))
    return rounded_row(compare.mcnemar(counts, with_p=False))


@query
def mcnemar_p_value(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(compare.mcnemar(compare.baseline_counts(dense_scored(spark, sf))))


@query
def baseline_report(spark: SparkSession, sf: str) -> DataFrame:
    models = {
        "centroid": centroid_scored(spark, sf),
        "bayes": bayes_scored(spark, sf),
        "dense": dense_scored(spark, sf),
    }
    return rounded_row(reports.baseline_report(models))


@query
def model_pair_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(reports.pair_report(centroid_scored(spark, sf), bayes_scored(spark, sf)))


# Introspection.


@query
def text_introspection(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.spread(split_texts(spark, sf), "id")
    return rounded_row(introspect.text_introspection(rows, "id", "text", centroid_model(spark, sf)))


@query
def text_introspection_any_size(spark: SparkSession, sf: str) -> DataFrame:
    """``text_introspection`` with the plan that a model past the driver's bound takes."""
    return rounded_row(introspect.text_introspection(split_texts(spark, sf), "id", "text", centroid_model(spark, sf), driver_bytes=0))


@query
def weight_preview_by_term(spark: SparkSession, sf: str) -> DataFrame:
    """The preview's columns under their terms, given back as rows to have fixed names."""
    wide = rounded_row(introspect.weight_preview_wide(spark, centroid_model(spark, sf), by_term=True))
    names = [c for c in wide.columns if c != "class_id"]
    cells = F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"`{n}`").alias("w")) for n in names])
    return wide.select("class_id", F.explode(cells).alias("c")).select("class_id", "c.term", "c.w")


@query
def scored_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first scored rows of the new texts, as shown beside the file."""
    rows = table(spark, sf, "conversations").withColumn("at", F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")))
    first = tables.preview(rows, ["conv_id", "turn", "role", "text"], "at")
    return rounded_row(textmodel.with_prediction_columns(textmodel.score_texts(first, "text", centroid_model(spark, sf))).drop("text"))


@query
def written_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The report files of an evaluation, read back: overall numbers, classes, and the predictions' count by labels."""
    path = work_path(spark, "evaluation")
    workbench.write_evaluation(centroid_scored(spark, sf), path)
    read = lambda name, schema: spark.read.options(header=True, escape='"', multiLine=True).schema(schema).csv(f"{path}/{name}")
    overall = read("detailed_metrics", "row int, metric string, value double").filter("row < 10").select(F.lit("overall").alias("file"), F.col("metric").alias("name"), "value")
    names = "class_id int, class_label string, precision double, recall double, f1 double, support long"
    classes = read("per_class_report", names).select(F.lit("classes").alias("file"), F.col("class_label").alias("name"), F.col("f1").alias("value"))
    audit = "text string, true_label_id int, true_label string, pred_label_id int, pred_label string, prob_NEG double, prob_POS double, prob_NEU double"
    counts = read("test_predictions", audit).groupBy(F.concat_ws(">", "true_label", "pred_label").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rounded_row(overall.unionByName(classes).unionByName(counts.select(F.lit("predictions").alias("file"), "name", "value")))

@query
def head_introspection(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads.score_vectors(split_embeddings(spark, sf), "embedding", dense_head(spark, sf))
    names = {c: f"class {c}" for c in EMB_CLASSES}
    return rounded_row(introspect.head_introspection(rows, "id", "embedding", dense_head(spark, sf), names))


@query
def text_model_bias(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(introspect.model_bias(spark, bayes_model(spark, sf)))


@query
def weight_preview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(introspect.weight_preview(spark, centroid_model(spark, sf)))


@query
def weight_preview_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_row(introspect.weight_preview_wide(spark, centroid_model(spark, sf)))


@query
def dense_weight_preview(spark: SparkSession, sf: str) -> DataFrame:
    preview = introspect.head_preview(dense_head(spark, sf))
    return rounded_row(preview.select("class_id", F.posexplode("w").alias("pos", "w")))


@query
def vector_preview(spark: SparkSession, sf: str) -> DataFrame:
    preview = introspect.vector_preview(embeddings(spark, sf), "id", "embedding")
    first = rounded(F.transform("first", lambda x: x.cast("double")), 6)
    return preview.select("id", "size", F.posexplode(first).alias("pos", "value")).withColumn("value", F.col("value") + 0.0)


@query
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.spread(split_texts(spark, sf), "id")
    return rounded_row(introspect.text_top_terms(rows, "id", "text", train_vocabulary(spark, sf), PROFILE))


@query
def top_terms_any_size(spark: SparkSession, sf: str) -> DataFrame:
    """``top_terms`` from the long table, as a vocabulary past the driver's bound needs."""
    return rounded_row(introspect.top_terms(_weights(spark, sf, split_texts(spark, sf), with_term=True), "id"))
