"""Stage 6: confusion matrix and classification metrics.

Everything is derived from one aggregate, ``groupBy(actual, predicted)``,
whose size is at most (#labels)^2; the metrics are small aggregates over
that table, never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LANGUAGE_WORDS, PROB_CLIP
from ..functions.vectors import argmax, clipped_log_loss
from ..session import materialize
from .labels import sorted_labels

ROUND = 9


def _member_of(words: list[str]):
    return lambda w: w.isin(words)


def language_predictions(documents: DataFrame) -> DataFrame:
    """Stand-in predictor: the language whose function words occur most often.

    Whole texts, JVM expressions only: words are extracted once and counted
    per language with hash-set membership.
    """
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), 0)
    counts = F.array(*[F.size(F.filter("__w", _member_of(ws))) for _, ws in LANGUAGE_WORDS])
    langs = F.array(*[F.lit(code) for code, _ in LANGUAGE_WORDS])
    return (documents.select("doc_id", F.col("lang").alias("actual"), words.alias("__w"))
            .select("doc_id", "actual", F.element_at(langs, argmax(counts) + 1).alias("predicted")))


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """A10, long form: (actual, predicted, n) for the non-zero cells."""
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def label_union(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Distinct labels seen as actual or predicted."""
    return (df.select(F.col(actual).alias("label"))
            .union(df.select(F.col(predicted).alias("label"))).distinct())


def confusion_dense(conf: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Every (actual, predicted) cell over the sorted label union, zeros kept.

    Each label row is widened by the array of all labels, so the k^2 cells are
    made where the labels lie, and left-joined to the non-zero counts.  The
    counts are read three times here and are a small table, so they are
    checkpointed: the predictions behind them run once.
    """
    conf = materialize(conf)
    labels = label_union(conf, actual, predicted)
    cells = labels.select(F.col("label").alias(actual), F.explode(sorted_labels(labels, "label")).alias(predicted))
    return (cells.join(conf, [actual, predicted], "left")
            .select(actual, predicted, F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_wide(conf: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """A10, wide form: one row per actual label, counts in sorted label order."""
    row = F.sort_array(F.collect_list(F.struct(predicted, "n")))
    return (confusion_dense(conf, actual, predicted).groupBy(actual).agg(row.alias("__c"))
            .select(actual, F.transform("__c", lambda s: s["n"]).alias("counts"), F.transform("__c", lambda s: s[predicted]).alias("labels")))


def class_report(conf: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per label tp, support, predicted, precision, recall, F1.

    One union + one aggregate over the confusion table; precision is 0 for a
    never-predicted label, recall 0 for a label without support.
    """
    a = conf.select(F.col(actual).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("pred"),
                    F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"))
    p = conf.select(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("pred"), F.lit(0).cast("long").alias("tp"))
    r = (a.unionByName(p).groupBy("label")
         .agg(F.sum("tp").cast("long").alias("tp"), F.sum("support").cast("long").alias("support"),
              F.sum("pred").cast("long").alias("predicted")))
    return (r.withColumn("precision", F.when(F.col("predicted") == 0, 0.0).otherwise(F.col("tp") / F.col("predicted")))
             .withColumn("recall", F.when(F.col("support") == 0, 0.0).otherwise(F.col("tp") / F.col("support")))
             .withColumn("f1", F.when(F.col("support") + F.col("predicted") == 0, 0.0)
                         .otherwise(2 * F.col("tp") / (F.col("support") + F.col("predicted")))))


def evaluation_metrics(conf: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """A11-A14 (M9): accuracy and support-weighted precision, recall, F1 (one row)."""
    r = class_report(conf, actual, predicted)
    s = F.sum("support")
    m = r.agg((F.sum("tp") / s).alias("accuracy"),
              (F.sum(F.col("support") * F.col("precision")) / s).alias("weighted_precision"),
              (F.sum(F.col("support") * F.col("recall")) / s).alias("weighted_recall"),
              (F.sum(F.col("support") * F.col("f1")) / s).alias("weighted_f1"),
              s.cast("long").alias("rows"))
    out = [F.round(c, ROUND).alias(c) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")]
    text = [F.format_string("%.5f", c).alias(c + "_text") for c in ("accuracy", "weighted_f1", "weighted_precision", "weighted_recall")]
    return m.select(*out, *text, "rows")


def round_report(r: DataFrame) -> DataFrame:
    return r.select("label", "tp", "support", "predicted",
                    *[F.round(c, ROUND).alias(c) for c in ("precision", "recall", "f1")])


def cross_entropy(df: DataFrame, probs: str = "probs", label: str = "label",
                  eps: float = PROB_CLIP) -> DataFrame:
    """Mean clipped -ln p(true class)."""
    return df.agg(F.round(F.avg(clipped_log_loss(F.col(probs), F.col(label), eps)), ROUND).alias("cross_entropy"),
                  F.count(F.lit(1)).alias("rows"))


def categorical_accuracy(df: DataFrame, probs: str = "probs", label: str = "label") -> DataFrame:
    """Share of rows whose arg-max equals the true index."""
    hit = (argmax(F.col(probs)) == F.col(label)).cast("int")
    return df.agg(F.round(F.avg(hit), ROUND).alias("categorical_accuracy"), F.count(F.lit(1)).alias("rows"))
