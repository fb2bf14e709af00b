"""Reading labelled tables, new texts and typed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from classgauge.functions.text import parse_token_list, strip_blanks
from classgauge.session import input_bytes

# The closed set of annotations.
LABEL_IDS = {"NEG": 0, "POS": 1, "NEU": 2}

# The column names of the labelled input.
TEXT_COLUMN = "Tweet"
ANNOTATION_COLUMN = "Final annotation"
TOKENS_COLUMN = "Tokens without stop words"

LABELLED_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField(TEXT_COLUMN, T.StringType()),
        T.StructField(ANNOTATION_COLUMN, T.StringType()),
        T.StructField(TOKENS_COLUMN, T.StringType()),
    ]
)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share out a small input by key so that all cores work on it.

    A file with one row group is one task however many cores there are. Inputs
    big enough to fill the cluster from their own splits come back untouched.
    """
    spark = df.sparkSession
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if input_bytes(df) < split_bytes * cores else df


def read_labelled(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """Read a labelled table with a fixed schema (parquet, csv or json). ``multi_line``
    takes quoted line breaks in CSV cells, and makes each file one task."""
    reader = spark.read.schema(LABELLED_SCHEMA)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, escape='"')
    return reader.format(fmt).load(path)


def require_column(df: DataFrame, name: str = "text") -> str:
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found; the table has {df.columns}")
    return name


def read_new_texts(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    text_column: str = "text",
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Read a CSV of new texts: (good rows, rows the reader could not parse).

    Unreadable rows are reported, not raised. Each reader parses whole rows: with column pruning
    on, one that asks for fewer columns would miss the breaks in the others. Without a schema the header names
    string columns. Quoted line breaks need ``multi_line``, which makes each
    file one task: write many files, or turn it off where no cell has a break.
    """
    options = {"header": True, "multiLine": multi_line, "escape": '"', "enforceSchema": False}
    if schema is None:
        names = spark.read.options(**options).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if text_column not in schema.names:
        raise ValueError(f"column {text_column!r} not found; the file has {schema.names}")
    bad = "_corrupt_record"
    rows = (
        spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, columnPruning=False)
        .schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())]))
        .csv(path)
    )
    whole = F.length(F.concat_ws("", *[F.col(n).cast("string") for n in schema.names])) >= 0  # Spark refuses to read the record column alone
    good = rows.filter(F.col(bad).isNull() & whole).select(*schema.names)
    return as_text(good, text_column), rows.filter(F.col(bad).isNotNull() & whole)


def as_text(df: DataFrame, column: str) -> DataFrame:
    """The column as strings; a missing value stays missing."""
    return df.withColumn(column, F.col(column).cast("string"))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows null in any of the columns; empty strings stay."""
    return df.na.drop(how="any", subset=columns)


def label_id(annotation):
    """Annotation name to class id; null outside the closed set."""
    pairs = [x for name, i in LABEL_IDS.items() for x in (F.lit(name), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), annotation)


def label_name(class_id):
    pairs = [x for name, i in LABEL_IDS.items() for x in (F.lit(i), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), class_id)


def prepare_labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows to (id, text, label), and the rows that could not be used.

    Rows without text or annotation are dropped. Rows whose token list does not
    parse or whose annotation is unknown go to the second table with a reason.
    """
    parsed = drop_incomplete(df, [TEXT_COLUMN, ANNOTATION_COLUMN]).select(
        "id",
        F.col(ANNOTATION_COLUMN).alias("annotation"),
        F.col(TOKENS_COLUMN).alias("tokens_raw"),
        parse_token_list(F.col(TOKENS_COLUMN)).alias("text"),
        label_id(F.col(ANNOTATION_COLUMN)).alias("label"),
    )
    reason = F.when(F.col("text").isNull(), "tokens").when(F.col("label").isNull(), "annotation")
    parsed = parsed.withColumn("reason", reason)
    good = parsed.filter(F.col("reason").isNull()).select("id", "text", "label")
    return good, parsed.filter(F.col("reason").isNotNull()).select("id", "annotation", "tokens_raw", "reason")


def lines_to_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per non-blank line, stripped, with its position in the text."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line", strip_blanks(F.col("line"))).filter(F.length("line") > 0)


def preview(df: DataFrame, columns: list[str], order: str, rows: int = 10) -> DataFrame:
    return df.orderBy(order).limit(rows).select(*columns)
