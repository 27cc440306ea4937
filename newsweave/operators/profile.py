"""Stage 2: profiling of raw categories and authors.

Every statistic is one hash aggregate (partial + final), so a category or an
author holding a third of the rows is combined map-side before the shuffle.
No operator here collects groups into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROUND = 9


def byline_authors(col: Column) -> Column:
    """B1: byline -> author list.

    Strip one trailing ', ap', split on ', ' or ' and ' (left-most
    alternative wins), drop empty names.
    """
    stripped = F.when(col.endswith(", ap"), col.substr(F.lit(1), F.length(col) - 4)).otherwise(col)
    return F.filter(F.split(stripped, ", | and "), lambda x: x != "")


def parse_byline(df: DataFrame, col: str = "authors") -> DataFrame:
    return df.withColumn(col, byline_authors(F.col(col)))


def explode_authors(df: DataFrame, col: str = "authors") -> DataFrame:
    """B2: one row per (article, author), with the author's position."""
    return df.select("*", F.posexplode(col).alias("author_pos", "author")).drop(col)


def category_profile(df: DataFrame, tie_break: str = "category", approx: bool = False,
                     key: str = "row_id") -> DataFrame:
    """A1-A5 + O1: per category articles, mean and median lengths.

    One aggregate.  The exact ``median`` keeps a value->count map per group;
    lengths are small integers, so the buffer stays small however many rows
    a group has.  ``approx=True`` uses ``percentile_approx`` instead.
    ``tie_break='first_seen'`` orders equal counts by first appearance (the
    reference's stable sort), taking ``min(key)`` in the same aggregate.
    """
    hl = F.length("headline")
    dl = F.length("short_description")
    med = (lambda c: F.percentile_approx(c, 0.5).cast("double")) if approx else F.median
    aggs = [F.count(F.lit(1)).alias("articles"),
            F.round(F.avg(hl), ROUND).alias("mean_headline_len"),
            med(hl).alias("median_headline_len"),
            F.round(F.avg(dl), ROUND).alias("mean_description_len"),
            med(dl).alias("median_description_len")]
    if tie_break == "first_seen":
        aggs.append(F.min(key).alias("first_row_id"))
        return df.groupBy("category").agg(*aggs).orderBy(F.desc("articles"), "first_row_id")
    return df.groupBy("category").agg(*aggs).orderBy(F.desc("articles"), "category")


def category_counts(df: DataFrame) -> DataFrame:
    """A1."""
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("articles"))


def top_categories(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest classes (TakeOrdered on the tiny count table)."""
    return category_counts(df).orderBy(F.desc("articles"), "category").limit(k)


def category_percent(df: DataFrame) -> DataFrame:
    """Percent share, one decimal.

    The window without partition runs on the per-category count table, whose
    size is the number of categories, never on article rows.
    """
    c = category_counts(df)
    return c.select("category", "articles",
                    F.round(F.col("articles") * 100.0 / F.sum("articles").over(Window.partitionBy()), 1)
                    .alias("percent"))


def distinct_categories_first_seen(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Distinct categories with their first-seen key and order."""
    first = df.groupBy("category").agg(F.min(key).alias("first_row_id"))
    return first.select("category", "first_row_id",
                        F.row_number().over(Window.orderBy("first_row_id", "category")).cast("long").alias("seen_order"))


def length_summary(df: DataFrame, col: str = "headline") -> DataFrame:
    """Box-plot numbers of ``length(col)`` per category.

    Quartiles are exact (interpolated); whiskers are the extreme lengths
    within 1.5 IQR of the box, outliers the count outside.  The rows are read
    once, into a (category, length) histogram that both steps use.
    """
    lengths = df.groupBy("category", F.length(col).alias("len")).agg(F.count(F.lit(1)).alias("times"))
    q = (lengths.groupBy("category")
         .agg(F.percentile("len", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("times")).alias("q"),
              F.sum("times").alias("n"))
         .select("category", "n",
                 F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3")))
    q = q.withColumn("lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = lengths.join(q, "category")
    inside = (F.col("len") >= F.col("lo")) & (F.col("len") <= F.col("hi"))
    return (j.groupBy("category", "n", "q1", "q2", "q3")
            .agg(F.min(F.when(inside, F.col("len"))).cast("long").alias("whisker_low"),
                 F.max(F.when(inside, F.col("len"))).cast("long").alias("whisker_high"),
                 F.sum(F.when(inside, 0).otherwise(F.col("times"))).cast("long").alias("outliers"))
            .select("category", F.col("n").alias("articles"),
                    F.round("q1", ROUND).alias("q1"), F.round("q2", ROUND).alias("median"),
                    F.round("q3", ROUND).alias("q3"), "whisker_low", "whisker_high", "outliers"))


LENGTH_STATISTICS = ("articles", "mean_headline_len", "median_headline_len", "mean_description_len", "median_description_len")


def category_orders(df: DataFrame) -> DataFrame:
    """O1: every category's place under each of the five statistics, largest
    first, ties by category (windows over one row per category)."""
    p = category_profile(df)
    return p.select("category", *[F.row_number().over(Window.orderBy(F.desc(s), "category")).cast("long").alias(f"by_{s}")
                                  for s in LENGTH_STATISTICS])


def author_counts(df: DataFrame) -> DataFrame:
    """A6 + O2: articles per author (a name twice in a byline counts twice)."""
    return (explode_authors(parse_byline(df)).groupBy("author")
            .agg(F.count(F.lit(1)).alias("articles"))
            .orderBy(F.desc("articles"), "author"))


def author_category_counts(df: DataFrame, drop_first_seen: bool = False,
                           key: str = "row_id") -> DataFrame:
    """(author, category, n).

    ``drop_first_seen=True`` reproduces the reference's counting, in which an
    author's first article (by key, then byline position) is not counted.
    Done with aggregates only: the first-seen cell per author is found with
    ``min`` over (key, pos, category) and subtracted, so no window is
    partitioned by author (a prolific author would be one task).
    """
    rows = explode_authors(parse_byline(df)).select("author", "category", key, "author_pos")
    counts = rows.groupBy("author", "category").agg(F.count(F.lit(1)).alias("n"))
    if not drop_first_seen:
        return counts
    first = (rows.groupBy("author")
             .agg(F.min(F.struct(key, "author_pos", "category")).alias("f"))
             .select("author", F.col("f.category").alias("category"), F.lit(1).alias("first")))
    return (counts.join(first, ["author", "category"], "left")
            .select("author", "category", (F.col("n") - F.coalesce("first", F.lit(0))).alias("n"))
            .where(F.col("n") > 0))


def author_lookup(df: DataFrame, name: str, drop_first_seen: bool = False) -> DataFrame:
    """one author's categories."""
    return author_category_counts(df.where(F.col("authors").contains(name)), drop_first_seen) \
        .where(F.col("author") == name)
