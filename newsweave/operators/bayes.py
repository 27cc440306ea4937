"""A closed-form text classifier: multinomial naive Bayes (M6, M8 in SQL terms).

Training is one aggregate of (class, word) counts over all training rows;
scoring joins a row's word counts with them.  With add-one smoothing a word
that a class has not seen contributes -ln(words of the class + vocabulary)
only, so the score is a per-row base and a sum over the seen pairs: no
(row, class, vocabulary) product is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokenize as tk


def word_counts(df: DataFrame, col: str = "combined_text") -> DataFrame:
    """Rows -> the same columns without the text, word and its count."""
    keep = [c for c in df.columns if c != col]
    # the outer form: for the inner one Spark extracts the words a second time in a filter
    return (df.select(*keep, F.explode_outer(tk.word_tokens(F.lower(F.col(col)))).alias("word")).where(F.col("word").isNotNull())
            .groupBy(*keep, "word").agg(F.count(F.lit(1)).alias("times")))


def train(rows: DataFrame, label: str = "category", col: str = "combined_text") -> tuple[DataFrame, DataFrame]:
    """Training rows -> (class, word, n) and (class, rows, words, vocabulary)."""
    words = (rows.select(label, F.explode_outer(tk.word_tokens(F.lower(F.col(col)))).alias("word")).where(F.col("word").isNotNull())
             .groupBy(label, "word").agg(F.count(F.lit(1)).alias("n")))
    vocabulary = words.agg(F.count_distinct("word").alias("v")).scalar()
    totals = words.groupBy(label).agg(F.sum("n").alias("words"))
    classes = (rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).join(totals, label, "left")
               .withColumn("words", F.coalesce("words", F.lit(0))).withColumn("vocabulary", vocabulary))
    return words, classes


def predict(rows: DataFrame, words: DataFrame, classes: DataFrame, key: str = "row_id",
            label: str = "category", col: str = "combined_text") -> DataFrame:
    """(key, prediction): the class of the highest score, ties by name.  A row
    without words gets the largest class."""
    counts = word_counts(rows.select(key, col), col)
    seen = (counts.join(words.select(F.col(label).alias("class"), "word", "n"), "word")
            .groupBy(key, "class").agg(F.sum(F.col("times") * F.log(F.col("n") + 1)).alias("gain")))
    length = counts.groupBy(key).agg(F.sum("times").alias("length"))
    listed = classes.agg(F.collect_list(F.struct(F.col(label).alias("class"), "rows", "words", "vocabulary")).alias("c")).scalar()
    base = (rows.select(key).join(length, key, "left").withColumn("classes", listed)
            .select(key, F.coalesce("length", F.lit(0)).alias("length"), F.explode("classes").alias("c")).select(key, "length", "c.*"))
    score = (F.log("rows") - F.col("length") * F.log(F.col("words") + F.col("vocabulary")) + F.coalesce("gain", F.lit(0.0)))
    scored = base.join(seen, [key, "class"], "left").select(key, "class", F.round(score, 6).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("class").alias("class")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.class").alias("prediction"))
