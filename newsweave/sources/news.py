"""Article sources: the JSON-lines reader and the stand-in built from `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import FIXTURE_CATEGORIES
from ..functions.ranking import positions
from ..session import table_path

# Declared, never inferred: `date` must be a DateType.
NEWS_SCHEMA = T.StructType([
    T.StructField("link", T.StringType(), True),
    T.StructField("headline", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("short_description", T.StringType(), True),
    T.StructField("authors", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
])
#: Articles that carry their own key.
KEYED_NEWS_SCHEMA = T.StructType([T.StructField("row_id", T.LongType(), True), *NEWS_SCHEMA.fields])


def read_news(spark: SparkSession, path: str, keyed: bool = False, require_all: bool = False) -> DataFrame:
    """Newline-delimited JSON articles.

    FAILFAST: a malformed line raises instead of becoming an all-null row that
    the null filter would silently drop.  ``require_all`` reads the input once
    more first and raises if a declared column is in no line.  Lines without a
    key of their own get one from their content (``numbered``).
    """
    schema = KEYED_NEWS_SCHEMA if keyed else NEWS_SCHEMA
    df = (spark.read.schema(schema).option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").json(path))
    if require_all:
        seen = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns]).first()
        absent = [c for c in df.columns if seen["rows"] and not seen[c]]
        if absent:
            raise ValueError(f"no article in {path} has {', '.join(absent)}")
    return df if keyed else numbered(df)


def numbered(df: DataFrame) -> DataFrame:
    """The rows with ``row_id``: their places from 0 in the order of a digest
    of all columns, so no two rows share one and the same rows get the same
    keys under any partitioning.

    Equal rows stand together, and which of them has which number makes no
    difference; they are spread over the ranges by where they were read, so a
    line that is repeated any number of times is no hot key.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]
    content = F.sha2(F.concat_ws("\x1f", *columns), 256)
    rows = df.withColumn("__content", content).withColumn("__read", F.monotonically_increasing_id())
    placed = positions(rows, [F.col("__content"), F.col("__read")], "row_id")
    return placed.select("row_id", *df.columns)


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _writer(x: Column) -> Column:
    return F.concat(F.lit("Writer "), (x % 37).cast("string"))


# Fixed value: a headline is the text's first sentence or line.
HEADLINE = r"^[^.!?\n]*[.!?]*"


def news_from_documents(documents: DataFrame) -> DataFrame:
    """The `news` stand-in (FIXTURES.md §2): one article per document.

    The headline is the text up to its first sentence or line end, the
    description all the rest, so that the two together hold every character;
    every 13th article is all headline.  Pure projection of `documents`, so it
    is a narrow, pipelined stage and its work grows with the table.
    """
    i = F.col("doc_id")
    cats = F.array(*[F.lit(c.upper()) for c in FIXTURE_CATEGORIES])
    w1, w2, w3 = _writer(i), _writer(i * 5 + 3), _writer(i * 3 + 1)
    r7 = i % 7
    authors = (F.when(r7 == 0, F.lit(""))
               .when(r7 == 1, w1)
               .when(r7 == 2, F.concat(w1, F.lit(", "), w2))
               .when(r7 == 3, F.concat(w1, F.lit(" and "), w2))
               .when(r7 == 4, F.concat(w1, F.lit(", "), w2, F.lit(" and "), w3))
               .when(r7 == 5, F.concat(w1, F.lit(", AP")))
               .otherwise(F.concat(w1, F.lit(", and "), w2)))
    headline = F.when(i % 13 == 0, F.col("text")).otherwise(F.regexp_extract("text", HEADLINE, 0))
    desc = (F.when(i % 101 == 7, F.lit(None).cast("string"))
            .otherwise(F.expr("substring(text, length(headline) + 1)")))
    return (documents.withColumn("headline", headline).select(
        i.alias("row_id"),
        F.when(i % 97 == 5, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("HTTPS://news.example.org/"), i.cast("string"))).alias("link"),
        "headline",
        F.element_at(cats, F.floor(F.sqrt(i % 1024)).cast("int") + 1).alias("category"),
        desc.alias("short_description"),
        authors.alias("authors"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 700).cast("int")).alias("date"),
    ))


def load_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in articles for a scale-factor folder (reads `documents`)."""
    return news_from_documents(load_table(spark, sf_dir, "documents"))


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")
