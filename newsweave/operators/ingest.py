"""Stage 1: lower-case, null filter, projections (S1 -> P1, F1, P2-P5, F5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lower_strings(df: DataFrame) -> DataFrame:
    """Lower-case every string column, leave the others as they are.

    The type test is done on the schema at plan time, so this is a single
    projection.
    """
    return df.select(*[
        F.lower(F.col(name)).alias(name) if dtype == "string" else F.col(name)
        for name, dtype in df.dtypes
    ])


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """drop rows with a null in any of ``cols`` (default: all columns).

    Written as a conjunction of IsNotNull so Catalyst pushes it into the
    scan (``na.drop`` is not pushed down).
    """
    cols = cols or df.columns
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return df.where(cond)


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Actually drop the columns (the reference discarded the result)."""
    return df.drop(*cols)


def combine_text(df: DataFrame, out: str = "combined_text") -> DataFrame:
    """``headline + ' ' + short_description``; null in, null out."""
    return df.withColumn(out, F.concat(F.col("headline"), F.lit(" "), F.col("short_description")))


def select_features(df: DataFrame, key: str = "row_id") -> DataFrame:
    """P5: keep the key, the model input and the label."""
    return df.select(key, "combined_text", "category")


def preview(df: DataFrame, n: int = 5, key: str = "row_id") -> DataFrame:
    """first ``n`` rows by key (a top-k, planned as TakeOrdered)."""
    return df.orderBy(key).limit(n)


def clean_news(news: DataFrame, key: str = "row_id") -> DataFrame:
    """P1 + F1: the cleaned articles every later stage starts from.

    The row key is no article column and takes no part in the null test, which runs on the raw columns (lower-casing does not change
    nullness), so the filter sits directly on the scan.
    """
    return lower_strings(drop_incomplete(news, [c for c in news.columns if c != key]))
