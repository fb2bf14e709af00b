"""TF-IDF over words and word pairs, as table jobs.

Fitting needs document frequencies only: one pass whose shuffle is combined on
the map side, so a word in every text costs no more than a rare one. The
vocabulary is written sorted, and a term's index is its place in those files.

Weights come in two forms. The long one, (id, term, weight), joins on terms and
has no bound. The vector one keeps every row where it is, and is open to
vocabularies that fit the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from classgauge.functions.text import terms
from classgauge.operators.termblocks import joined_blocks, joined_rows, row_weights, task_parts, unit_weights
from classgauge.session import work_path

MIN_DF = 2
MAX_DF = 0.95
BROADCAST_BYTES = 64 << 20
DRIVER_BYTES = 256 << 20
# A term in more than this share of the texts is joined apart. There are at most
# (mean terms per text) / HOT_SHARE of them.
HOT_SHARE = 0.01


def portions(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key to tasks of a bounded share of the input, for steps whose tasks hold all distinct terms of their texts."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, task_parts(df)), key)


def explode_terms(found: Column) -> Column:
    """One row per term, a null one for none. A plain explode would make Spark add a
    filter on the list's size, and cut every text into terms a second time for it."""
    return F.explode_outer(found).alias("term")


def term_counts(
    df: DataFrame, key: str, text: str, profile: str, carry: tuple[str, ...] = (), keep_empty: bool = False
) -> DataFrame:
    """(key, carry.., term, tf). With ``keep_empty`` a text without terms keeps a null row.

    The raw text is shuffled by key, once. Counting by (key, term) and whatever
    later groups by key then happen in place; shuffling the exploded terms
    instead would move several times the text. Tasks grow in number with the input, as a task holds all its terms.
    """
    rows = df.select(key, *carry, text).repartition(task_parts(df), key)
    rows = rows.select(key, *carry, explode_terms(terms(F.col(text), profile)))
    if not keep_empty:
        rows = rows.filter(F.col("term").isNotNull())
    return rows.groupBy(key, *carry, "term").agg(F.count("term").alias("tf"))


def document_frequency(df: DataFrame, text: str, profile: str) -> DataFrame:
    """(term, df): in how many texts a term occurs."""
    rows = df.select(explode_terms(F.array_distinct(terms(F.col(text), profile))))
    return rows.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def smooth_idf(df: Column, n_docs: int) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def sublinear_tf(tf: Column) -> Column:
    return F.log(tf.cast("double")) + 1.0


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: a sorted table on shared storage and its size."""

    path: str
    n_docs: int
    offsets: tuple[tuple[str, int], ...]
    n_terms: int
    n_bytes: int

    def table(self, spark: SparkSession) -> DataFrame:
        """(term_idx, term, df, idf), indexed in code-point order of the terms."""
        starts = F.broadcast(spark.createDataFrame(list(self.offsets), "file string, start long"))  # one row per file
        place = F.col("_metadata")
        rows = spark.read.parquet(self.path).select("term", "df", place["file_name"].alias("file"), place["row_index"].alias("row"))
        idx = (F.col("start") + F.col("row")).alias("term_idx")
        return rows.join(starts, "file").select(idx, "term", "df", smooth_idf(F.col("df"), self.n_docs).alias("idf"))

    def fits_driver(self) -> bool:
        return self.n_bytes <= DRIVER_BYTES


def fit_vocabulary(
    df: DataFrame, text: str, profile: str = "arabic", min_df: int = MIN_DF, max_df: float = MAX_DF, key: str = "id"
) -> Vocabulary:
    """Terms found in at least ``min_df`` texts and at most the share ``max_df`` of them.

    The share is of all rows of ``df``, also those without terms.
    """
    spark = df.sparkSession
    n_docs = df.count()
    path = work_path(spark, "vocabulary")
    counts = document_frequency(portions(df.select(key, text), key), text, profile)
    kept = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    kept.orderBy("term").write.parquet(path)
    files = (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes"))
        .orderBy("file")
        .collect()  # one row per file
    )
    if not files:
        raise ValueError("no term is left after pruning; lower min_df or raise max_df")
    offsets, n_terms = [], 0
    for f in files:
        offsets.append((f["file"], n_terms))
        n_terms += f["n"]
    n_bytes = sum(f["bytes"] for f in files) + 64 * n_terms
    return Vocabulary(path, n_docs, tuple(offsets), n_terms, n_bytes)


def join_terms(counts: DataFrame, key: str, table: DataFrame, n_bytes: int, n_docs: int, how: str = "inner") -> DataFrame:
    """Join counts with a term table that has ``term`` and ``df``.

    A table of checked size is broadcast. A larger one is joined by shuffle; then
    the terms of very many texts, of which there can be few only, are broadcast
    and their rows take a key of their own text, so that no task gets a hot term.
    """
    if n_bytes <= BROADCAST_BYTES:
        return counts.join(F.broadcast(table), "term", how)
    columns = [c for c in table.columns if c != "term"]
    is_hot = F.col("df") > HOT_SHARE * n_docs
    hot = table.filter(is_hot).select(F.col("term").alias("_hot"), F.struct(*columns).alias("_hot_row"))
    rest = table.filter(~is_hot).select(F.col("term").alias("_join"), F.struct(*columns).alias("_rest_row"))
    away = F.concat(F.lit("\0"), F.col(key).cast("string"))  # no term holds this character
    rows = counts.join(F.broadcast(hot), F.col("term") == F.col("_hot"), "left")
    rows = rows.withColumn("_join", F.when(F.col("_hot").isNotNull() | F.col("term").isNull(), away).otherwise(F.col("term")))
    rows = rows.join(rest, "_join", "left").withColumn("_row", F.coalesce("_hot_row", "_rest_row"))
    if how == "inner":
        rows = rows.filter(F.col("_row").isNotNull())
    return rows.select("term", *[c for c in counts.columns if c != "term"], *[F.col("_row")[c].alias(c) for c in columns])


def fits_broadcast(n_bytes: int) -> bool:
    return n_bytes <= BROADCAST_BYTES


def _keys_ddl(counts: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in counts.dtypes if n not in ("term", "tf"))


def tfidf_long(counts: DataFrame, key: str, vocabulary: Vocabulary, with_term: bool = True) -> DataFrame:
    """(key.., term_idx, term, df, idf, weight): sublinear tf times idf, each text of length 1.

    ``counts`` comes from ``term_counts``; terms outside the vocabulary fall away. A vocabulary of checked size is broadcast, a larger one
    joined by blocks of texts; then the terms themselves may be left out, which spares moving them.
    """
    table = vocabulary.table(counts.sparkSession)
    if not fits_broadcast(vocabulary.n_bytes):

        def rows_of(keys: pa.Table, text: np.ndarray, tf: np.ndarray, numbers: np.ndarray, found: pa.Array | None) -> pa.Table:
            weight = unit_weights(keys, key, text, tf, numbers[:, 2])
            cells = keys.take(pa.array(text)).columns + ([found] if with_term else [])
            cells += [pa.array(numbers[:, 0].astype(np.int64)), pa.array(numbers[:, 1].astype(np.int64)), pa.array(numbers[:, 2]), pa.array(weight)]
            return pa.table(cells, [*keys.column_names, *["term"] * with_term, "term_idx", "df", "idf", "weight"])

        ddl = f"{_keys_ddl(counts)}, " + "term string, " * with_term + "term_idx long, df long, idf double, weight double"
        return joined_blocks(counts, table, ["term_idx", "df", "idf"], 3, vocabulary.n_bytes, rows_of, ddl, with_term)
    rows = join_terms(counts, key, table, vocabulary.n_bytes, vocabulary.n_docs)
    rows = rows.withColumn("_raw", sublinear_tf(F.col("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy(key)))
    return rows.withColumn("weight", F.col("_raw") / length).drop("_raw", "tf")


def stored_vectors(rows: DataFrame, name: str, size: int, indices: Column, values: Column) -> DataFrame:
    """The rows with sparse ML vectors out of index and value arrays, under ``name``.

    No built-in function makes a vector of arrays. Files do not know the type, only its parts: rows written with the
    parts are read back under a schema that names it, with every double as it was.
    """
    spark = rows.sparkSession
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"))
    path = work_path(spark, "vectors")
    rows.withColumn(name, parts).write.parquet(path)
    fields = [f for f in rows.schema.fields if f.name != name]
    return spark.read.schema(T.StructType([*fields, T.StructField(name, VectorUDT())])).parquet(path)


def packed_weights(long: DataFrame, key: str) -> DataFrame:
    """(key, p): each text's long weights as an array of (i, w), by index."""
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("term_idx").cast("int").alias("i"), F.col("weight").alias("w")))).alias("p"))


def vectors_from_long(long: DataFrame, key: str, n_terms: int) -> DataFrame:
    """(key, features) from long weights; written."""
    packed = packed_weights(long, key)
    return stored_vectors(packed, "features", n_terms, F.col("p.i"), F.col("p.w")).drop("p")


def driver_terms(vocabulary: Vocabulary, spark: SparkSession) -> tuple[list[str], list[float]]:
    """Terms and IDFs in index order, on the driver; refused past DRIVER_BYTES."""
    if not vocabulary.fits_driver():
        raise ValueError(f"vocabulary of {vocabulary.n_bytes} bytes is too large for the driver; use the long form")
    rows = vocabulary.table(spark).orderBy("term_idx").select("term", "idf").toArrow()
    return rows["term"].to_pylist(), rows["idf"].to_pylist()


def _count_vectorizer(spark: SparkSession, known: list[str]) -> CountVectorizerModel:
    """``CountVectorizerModel.from_vocabulary``, with the terms handed over in one piece.

    That method passes them to the JVM one call each: minutes for a million.
    """
    sc = spark.sparkContext
    array = sc._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(known))  # no term holds a line break
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", array)
    return model.setInputCol("_terms").setOutputCol("_counts")


def with_count_arrays(df: DataFrame, text: str, profile: str, known: list[str]) -> DataFrame:
    """Add ``_idx`` and ``_tf``: the known terms of a text and their counts, by index."""
    counted = _count_vectorizer(df.sparkSession, known).transform(df.withColumn("_terms", terms(F.col(text), profile))).withColumn("_counts", F.unwrap_udt("_counts"))
    return counted.withColumn("_idx", F.col("_counts.indices")).withColumn("_tf", F.col("_counts.values")).drop("_terms", "_counts")


def weighed_rows(df: DataFrame, text: str, profile: str, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """(keep.., _i, _w): the indices and weights of each row's terms, by blocks of rows."""

    def rows_of(rows: pa.Table, text: np.ndarray, tf: np.ndarray, numbers: np.ndarray, _: np.ndarray) -> pa.Table:
        weight, idx = row_weights(text, len(rows), tf, numbers[:, 1]), numbers[:, 0].astype(np.int32)
        order = np.lexsort((idx, text))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(rows))))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (idx, weight)]
        return rows.append_column("_i", lists[0]).append_column("_w", lists[1])

    table = vocabulary.table(df.sparkSession).select("term", "term_idx", "idf")
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("_i", T.ArrayType(T.IntegerType())), T.StructField("_w", T.ArrayType(T.DoubleType()))])
    return joined_rows(df, terms(F.col(text), profile), table, ["term_idx", "idf"], 2, vocabulary.n_bytes, rows_of, schema, keep)


def tfidf_vectors(df: DataFrame, text: str, profile: str, vocabulary: Vocabulary, driver_bytes: int = DRIVER_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Add ``features``, the TF-IDF vector of a text; a null text has an empty one. The rows are written on the way, with ``keep`` only those columns.

    A vocabulary of up to ``driver_bytes`` is handed to every task: no shuffle and no Python. With a larger one
    the rows are weighed in blocks that keep all their columns.
    """
    keep = df.columns if keep is None else keep
    if vocabulary.n_bytes > driver_bytes:
        rows = weighed_rows(df, text, profile, vocabulary, keep)
        return stored_vectors(rows, "features", vocabulary.n_terms, F.col("_i"), F.col("_w")).drop("_i", "_w")
    known, idf = driver_terms(vocabulary, df.sparkSession)
    rows = with_count_arrays(df, text, profile, known).select(*keep, "_idx", "_tf")
    rows = stored_vectors(rows, "_raw", len(known), F.col("_idx"), F.transform("_tf", sublinear_tf))
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_raw", outputCol="_scaled").transform(rows)
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol="features").transform(scaled)
    return unit.drop("_idx", "_tf", "_raw", "_scaled")
