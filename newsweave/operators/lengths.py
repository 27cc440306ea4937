"""Length statistics as a state that grows by parts (A1-A5 and A22 at scale).

Each part of the input (a day, a delivery) is read once and leaves a small
table of counts beside the others; statistics come from the merged tables, so a
new part never makes an old one be read again.  A count stands for the lengths
that share their leading ``bits`` + 1 binary digits, with the smallest and the
largest of them: a quantile lies between two lengths that are less than a
2^-bits part of the smaller apart, and both are returned.  Short lengths
(below 2^(bits + 1)) are counted one by one and are exact.

The exact forms (``profile.category_profile``, ``length_summary``) stay the
default; this one is for inputs that grow.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7
ROUND = 9
QUARTILES = (0.25, 0.5, 0.75)
_STATE = "measure string, low long, bits int, times long, total long, shortest long, longest long"
_MERGED = ("times", "total", "shortest", "longest")


def leading(length: Column, bits: Column | int) -> Column:
    """The length with all but its leading ``bits`` + 1 binary digits set to 0."""
    kept = bits + 1 if isinstance(bits, Column) else F.lit(bits + 1)
    drop = F.greatest(F.length(F.bin(length)) - kept, F.lit(0))
    step = F.pow(F.lit(2.0), drop).cast("long")  # exact: a power of two
    return length - F.pmod(length, step)


def _merge(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.groupBy(*keys).agg(F.sum("times").alias("times"), F.sum("total").alias("total"),
                                    F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))


def length_state(df: DataFrame, measures: Sequence[str], by: str = "category", bits: int = BITS) -> DataFrame:
    """Rows -> (``by``, measure, low, bits, times, total, shortest, longest).

    One pass with map-side counts: a category with a third of all rows sends
    one row per task and count.  A null text is counted under a null ``low``.
    """
    if not 0 <= bits <= 30:
        raise ValueError(f"bits is 0 to 30, not {bits}")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.length(F.col(m)).cast("long").alias("len")) for m in measures]))
    rows = df.select(by, each.alias("m")).select(by, F.col("m.measure").alias("measure"), F.col("m.len").alias("len"))
    counted = (rows.withColumn("low", leading(F.col("len"), bits)).groupBy(by, "measure", "low")
               .agg(F.count(F.lit(1)).alias("times"), F.sum("len").alias("total"), F.min("len").alias("shortest"),
                    F.max("len").alias("longest")))
    return counted.select(by, "measure", "low", F.lit(bits).alias("bits"), *_MERGED)


def add_part(df: DataFrame, path: str, part: str, measures: Sequence[str], by: str = "category", bits: int = BITS) -> None:
    """Write one part's state into its own folder.

    A part of the same name is replaced, so a failed or repeated run counts no
    row twice; parts already there are neither read nor changed.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", part):
        raise ValueError(f"a part is named by letters, digits, '_', '.' and '-', not {part!r}")
    length_state(df, measures, by, bits).coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}")


def read_state(spark, path: str, by: str = "category") -> DataFrame:
    """All parts' states merged into one; parts of different ``bits`` meet at the least of them."""
    parts = spark.read.schema(f"`{by}` string, {_STATE}").parquet(path)
    least = parts.agg(F.min("bits")).scalar()
    at = parts.select(by, "measure", leading(F.col("low"), least).alias("low"), least.alias("bits"), *_MERGED)
    return _merge(at, [by, "measure", "low", "bits"])


def _ranked(state: DataFrame, by: str) -> DataFrame:
    """Counts with the rows up to them; the windows see counts, of which a key
    has at most some 2^bits for each doubling of the length, never rows."""
    w = Window.partitionBy(by, "measure")
    return (state.where(F.col("low").isNotNull())
            .withColumn("upto", F.sum("times").over(w.orderBy("low"))).withColumn("n", F.sum("times").over(w)))


def quantiles(state: DataFrame, qs: Sequence[float] = QUARTILES, by: str = "category") -> DataFrame:
    """(``by``, measure, rows, mean, q): q holds (q, at_least, at_most) per quantile.

    The exact quantile (interpolated between neighbouring ranks) lies between
    the two; rows and mean are exact.  A key without any length has none.
    """
    def at(i: Column, edge: str) -> Column:
        return F.min(F.when(F.col("upto") > i, F.col(edge)))

    cols = []
    for k, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("n") - 1)
        i = F.floor(place)
        for edge in ("shortest", "longest"):
            cols += [at(i, edge).alias(f"{edge}_{k}"), at(F.least(i + 1, F.col("n") - 1), edge).alias(f"{edge}_next_{k}")]
    g = _ranked(state, by).groupBy(by, "measure", "n").agg(F.sum("total").alias("total"), *cols)

    def between(k: int, q: float, edge: str) -> Column:
        place = F.lit(float(q)) * (F.col("n") - 1)
        a, b = F.col(f"{edge}_{k}"), F.col(f"{edge}_next_{k}")
        return a + (place - F.floor(place)) * (b - a)

    q = F.array(*[F.struct(F.lit(float(q)).alias("q"), between(k, q, "shortest").alias("at_least"), between(k, q, "longest").alias("at_most"))
                  for k, q in enumerate(qs)])
    return g.select(by, "measure", F.col("n").alias("rows"), (F.col("total") / F.col("n")).alias("mean"), q.alias("q"))


def length_profile(state: DataFrame, by: str = "category") -> DataFrame:
    """A1-A5 from the state: (``by``, measure, articles, mean_len, median_at_least, median_at_most).

    ``articles`` counts all rows, those with a null text too.
    """
    rows = state.groupBy(by, "measure").agg(F.sum("times").alias("articles"))
    q = quantiles(state, (0.5,), by).select(F.col(by).alias("__k"), F.col("measure").alias("__m"), "mean", F.col("q")[0].alias("m"))
    return (rows.join(q, rows[by].eqNullSafe(q["__k"]) & (rows["measure"] == q["__m"]), "left")
            .select(by, "measure", "articles", F.round("mean", ROUND).alias("mean_len"), F.col("m.at_least").alias("median_at_least"),
                    F.col("m.at_most").alias("median_at_most")))


def box_numbers(state: DataFrame, by: str = "category") -> DataFrame:
    """A22 from the state: quartiles, whiskers and outlier counts, each with the
    least and the largest value that the state allows.

    The exact quartiles, the fences 1.5 quartile distances away, the extreme
    lengths inside them and the number of lengths outside lie between the two.
    """
    q = quantiles(state, QUARTILES, by)
    named = [F.col("q")[k][edge].alias(f"{name}_{edge}") for k, name in enumerate(("q1", "median", "q3")) for edge in ("at_least", "at_most")]
    q = q.select(F.col(by).alias("__k"), F.col("measure").alias("__m"), "rows", *named)

    def fence(near: str, far: str) -> Column:  # near - 1.5 * (far - near), seen from the box's nearer side
        return 2.5 * F.col(near) - 1.5 * F.col(far)

    q = (q.withColumn("low_1", fence("q1_at_least", "q3_at_most")).withColumn("low_2", fence("q1_at_most", "q3_at_least"))
         .withColumn("high_1", fence("q3_at_least", "q1_at_most")).withColumn("high_2", fence("q3_at_most", "q1_at_least")))
    s = state.where(F.col("low").isNotNull())
    j = s.join(q, s[by].eqNullSafe(q["__k"]) & (s["measure"] == q["__m"]))
    a, b = F.col("shortest"), F.col("longest")
    surely = (b < F.col("low_1")) | (a > F.col("high_2"))
    perhaps = (a < F.col("low_2")) | (b > F.col("high_1"))
    kept = [F.col(f"{name}_{edge}") for name in ("q1", "median", "q3") for edge in ("at_least", "at_most")]

    def counted(outside: Column) -> Column:
        return F.sum(F.when(outside, F.col("times")).otherwise(0)).cast("long")

    return (j.groupBy(by, "measure", "rows", *kept)
            .agg(F.min(F.when(b >= F.col("low_1"), F.greatest(a, F.ceil("low_1")))).cast("long").alias("whisker_low_at_least"),
                 F.min(F.when(b >= F.col("low_2"), F.when(a >= F.col("low_2"), a).otherwise(b))).cast("long").alias("whisker_low_at_most"),
                 F.max(F.when(a <= F.col("high_1"), F.when(b <= F.col("high_1"), b).otherwise(a))).cast("long").alias("whisker_high_at_least"),
                 F.max(F.when(a <= F.col("high_2"), F.least(b, F.floor("high_2")))).cast("long").alias("whisker_high_at_most"),
                 counted(surely).alias("outliers_at_least"), counted(perhaps).alias("outliers_at_most")))
