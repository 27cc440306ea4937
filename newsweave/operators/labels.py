"""Stage 3: label merge, class table, indices, one-hot, decode."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CATEGORY_MERGE


def merge_categories(df: DataFrame, mapping: dict[str, str] | DataFrame | None = None,
                     col: str = "category", keep_raw: str | None = "raw_category") -> DataFrame:
    """Simultaneous relabelling; unmatched labels are kept.

    A literal dict becomes a map literal looked up in the projection (no
    join at all).  A mapping table `(raw, merged)` is joined; the optimiser
    broadcasts it if its measured bytes allow.
    """
    mapping = CATEGORY_MERGE if mapping is None else mapping
    if keep_raw:
        df = df.withColumn(keep_raw, F.col(col))
    if isinstance(mapping, dict):
        m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
        return df.withColumn(col, F.coalesce(F.element_at(m, F.col(col)), F.col(col)))
    table = mapping.select(F.col("raw").alias("__raw"), F.col("merged").alias("__merged"))
    return (df.join(table, F.col(col) == F.col("__raw"), "left")
            .withColumn(col, F.coalesce("__merged", col)).drop("__raw", "__merged"))


def class_table(df: DataFrame, col: str = "category") -> DataFrame:
    """O6 + M3: (idx, category), idx = alphabetical rank from 0.

    `distinct` is a partial aggregate; the ranking window then runs on the
    distinct classes only.
    """
    d = df.select(col).distinct()
    return d.select((F.row_number().over(Window.orderBy(col)) - 1).cast("long").alias("idx"), col)


def sorted_labels(df: DataFrame, col: str = "category") -> Column:
    """The sorted distinct non-null labels as one array, a scalar subquery."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().agg(F.sort_array(F.collect_list(col))).scalar()


def one_hot(df: DataFrame, classes: DataFrame, col: str = "category",
            out: str = "one_hot") -> DataFrame:
    """M2: 0/1 vector over the sorted labels of ``classes``; a label outside
    of them gives all zeros."""
    return (df.withColumn("__labels", sorted_labels(classes, col))
            .withColumn(out, F.transform("__labels", lambda k: (k == F.col(col)).cast("int"))).drop("__labels"))


def index_labels(df: DataFrame, classes: DataFrame, col: str = "category",
                 out: str = "label") -> DataFrame:
    """M3: attach the class index (join on the class table)."""
    t = classes.select(F.col(col).alias("__c"), F.col("idx").alias(out))
    return df.join(t, F.col(col) == F.col("__c"), "left").drop("__c")


def decode_class(df: DataFrame, classes: DataFrame, idx_col: str = "pred_idx",
                 out: str = "prediction", col: str = "category") -> DataFrame:
    """Class index -> class name."""
    t = classes.select(F.col("idx").alias("__i"), F.col(col).alias(out))
    return df.join(t, F.col(idx_col) == F.col("__i"), "left").drop("__i")
