"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted in order; each model sees the words of the text and
the probabilities of the categories before it.  In training those earlier
probabilities are out of fold: they come from models that did not see the
row, as at prediction they come from models that did not see the text.  Equal
texts are in one fold.

Features are the distinct words of the whole text, and beginnings of words for
inflected and compound forms, whose share of wanted rows stands out in the
training rows (a chi-square test on those rows alone), so a very long clean
text does not add up noise; L1 regularisation leaves those that tell.

Training takes at most ``TRAIN_ROWS`` labelled rows, in hash order: a bounded,
documented sample.  Spark counts its words; every word that stands out is a
feature, so their number is bounded by the sample and ``MIN_DOCS`` alone.  The
rows' features reach the driver as numbers and are fitted in NumPy.  Scoring
reads every whole text once, in the JVM, without a shuffle: the words that have
a weight are looked up in a literal hash table.
"""

from __future__ import annotations

import json
import warnings
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table

CATEGORIES = ("low_quality", "toxic")  # in the order of the chain
TRAIN_ROWS = 20_000
FOLDS = 3
MIN_DOCS = 5           # of the training rows must have a word for it to count
STANDS_OUT = 20.0      # chi-square of a word that is a feature
L1 = 0.00003
ITERATIONS = 200
POSITIVE_WEIGHT = 3.0  # of a labelled row of the rarer, wanted class
PRECISION = 0.9        # share of rejected rows that must be wanted, out of fold
NOISY_PRECISION = 0.5  # the same where the labels are too noisy for that
WORD = r"[\p{L}\p{M}]+"
STEMS = (4, 6)         # lengths of the beginnings of words that may be features


@dataclass
class Model:
    """log odds = bias + weights of the words present + chain weights times
    earlier probabilities."""
    bias: float
    words: dict[str, float] = field(default_factory=dict)
    chain: list[float] = field(default_factory=list)


@dataclass
class Chain:
    models: dict[str, Model] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)


def words(text: Column) -> Column:
    """Distinct words, and their beginnings marked with a hyphen."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0))
    return let(found, lambda f: F.concat(f, *[
        F.array_distinct(F.transform(F.filter(f, lambda x: F.length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("-"))))
        for n in STEMS]))


def _p(category: str) -> str:
    return f"_p_{category}"


def _looked_up(found: Column, values: dict[str, object], kind: str) -> Column:
    """The values of those words that have one, in the words' order.  The
    literal is an array of small maps, a word's map named by its CRC, since a
    map alone is searched from end to end."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    maps: list[dict[str, object]] = [{} for _ in values]
    for w, v in values.items():
        maps[zlib.crc32(w.encode()) % len(maps)][w] = v
    literal = F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), f"array<map<string,{kind}>>")
    each = F.transform(found, lambda w: F.element_at(F.get(literal, F.crc32(w.cast("binary")) % len(maps)), w))
    return F.filter(each, lambda x: x.isNotNull())


def _features(rows: DataFrame, categories: Sequence[str], folds: int, min_docs: int) -> list:
    """All telling words with, per category and fold, whether they stand out
    in the rows outside that fold (the last entry: in all rows)."""
    each = rows.select("_fold", *categories, F.explode("_tokens").alias("word"))

    def sums(c: str) -> list[Column]:
        here = [F.when(F.col("_fold") == k, F.col(c).cast("long")) for k in range(folds)]
        return [F.array(*[F.count(x) for x in here]).alias(f"n_{c}"), F.array(*[F.coalesce(F.sum(x), F.lit(0)) for x in here]).alias(f"bad_{c}")]

    columns = [x for c in categories for x in sums(c)]
    total = rows.agg(*columns).first()
    counts = each.groupBy("word").agg(*columns)
    tests = []
    for c in categories:
        for k in range(folds + 1):
            inside = [f for f in range(folds) if f != k]
            n, bad = (sum(total[f"{x}_{c}"][f] for f in inside) for x in ("n", "bad"))
            has, wanted = (sum((F.col(f"{x}_{c}")[f] for f in inside), F.lit(0)) for x in ("n", "bad"))
            p = bad / n if n else 0.0
            chi = (wanted - has * p) ** 2 / (has * (p * (1 - p))) if 0 < p < 1 else F.lit(0.0)
            tests.append(F.when(has >= min_docs, chi).otherwise(0.0))
    strongest = F.greatest(*tests)
    return (counts.select("word", F.array(*tests).alias("chi"), strongest.alias("best")).where(F.col("best") >= STANDS_OUT)
            .orderBy(F.desc("best"), "word").collect())


def fit_linear(rows: np.ndarray, features: np.ndarray, n_features: int, extra: np.ndarray, y: np.ndarray,
               l1: float = L1, iterations: int = ITERATIONS) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic regression with L1 on the words: (bias, words, chain).

    Row rows[i] has the feature features[i].  Accelerated proximal steps, each
    coordinate's length from a bound on its curvature.
    """
    n, e = len(y), extra.shape[1]
    w = np.where(y == 1, POSITIVE_WEIGHT, 1.0)
    w /= w.sum()
    per_row = np.bincount(rows, minlength=n) + 1.0 + e
    curve = 0.25 * w * per_row
    step_w = 1 / np.maximum(np.bincount(features, curve[rows], minlength=n_features), 1e-12)
    step_b = 1 / curve.sum()
    step_e = 1 / np.maximum(curve @ extra ** 2, 1e-12)
    at = prev = (0.0, np.zeros(n_features), np.zeros(e))
    t = 1.0
    for _ in range(iterations):
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        b, v, g = (a + (t - 1) / after * (a - o) for a, o in zip(at, prev))
        t = after
        z = b + np.bincount(rows, v[features], minlength=n) + extra @ g
        rest = w * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        moved = v - step_w * np.bincount(features, rest[rows], minlength=n_features)
        prev, at = at, (b - step_b * rest.sum(), np.sign(moved) * np.maximum(np.abs(moved) - l1 * step_w, 0), g - step_e * (rest @ extra))
    return at


def _threshold(scored: list[tuple[float, float]], category: str = "") -> float:
    """The cut between two probabilities with the best F1 on rows out of fold
    among those of ``PRECISION``.  Where that finds less than half the wanted
    rows that a cut of ``NOISY_PRECISION`` finds, or there is none, the latter
    is taken, with a warning; without either nothing is above the threshold."""
    scored = sorted(scored, reverse=True)
    total = sum(y for _, y in scored)
    strict = noisy = (0.0, 1.0 + 1e-9, 0.0, 0.0)  # F1, cut, wanted rows above it, precision
    hits = 0.0
    for i, (p, y) in enumerate(scored):
        hits += y
        after = scored[i + 1][0] if i + 1 < len(scored) else 0.0
        f1 = 2 * hits / (i + 1 + total)
        if after < p and total < len(scored):
            this = f1, (p + after) / 2, hits, hits / (i + 1)
            if hits >= PRECISION * (i + 1) and f1 > strict[0]:
                strict = this
            if hits >= NOISY_PRECISION * (i + 1) and f1 > noisy[0] and i + 1 < len(scored):
                noisy = this
    if strict[2] >= noisy[2] / 2 and strict[2]:
        return strict[1]
    if 0 < total < len(scored):
        warnings.warn(f"{category}: a precision of {PRECISION} out of fold finds {strict[2]:.0f} of {total:.0f} wanted rows; "
                      + (f"the cut taken finds {noisy[2]:.0f} with a precision of {noisy[3]:.2f}" if noisy[2] else "nothing is rejected"))
    return noisy[1]


def sample(labels: DataFrame, key: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled keys, in hash order, one row each.  Where
    labels of a key contradict each other, one that says yes wins; a null
    label says nothing."""
    said = [F.max(c).alias(c) for c in labels.columns if c != key]
    return (labels.where(F.col(key).isNotNull()).groupBy(key).agg(*said)
            .orderBy(F.xxhash64(F.lit("train"), key), key).limit(rows))


def train(labelled: DataFrame, categories: Sequence[str] = CATEGORIES, text: str = "text",
          folds: int = FOLDS, min_docs: int = MIN_DOCS) -> Chain:
    """Labelled rows (text, one 0/1/null column per category) -> a chain.  The
    caller bounds the rows (``sample``).  Without rows, or where a category has
    one class only, its probability is constant (0 without rows), and no text
    passes its threshold."""
    rows = cut(labelled.select(words(F.col(text)).alias("_tokens"), F.coalesce(F.pmod(F.xxhash64(text), folds), F.lit(0)).alias("_fold"),
                               *[F.col(c).cast("int").alias(c) for c in categories]))
    chosen = _features(rows, categories, folds, min_docs)
    number = {r.word: i for i, r in enumerate(chosen)}
    held = rows.select("_fold", _looked_up(F.col("_tokens"), number, "int").alias("words"), *categories).toArrow().combine_chunks()
    fold = held.column("_fold").to_numpy()
    lists = held.column("words").combine_chunks() if len(held) else pa.array([], pa.list_(pa.int32()))
    where = np.repeat(np.arange(len(held), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int))
    which = lists.flatten().to_numpy(zero_copy_only=False)
    chi = np.array([r.chi for r in chosen], float).reshape(len(chosen), len(categories) * (folds + 1))
    earlier = np.zeros((len(held), 0))
    chain = Chain()
    for i, category in enumerate(categories):
        y = held.column(category).cast(pa.float64()).to_numpy()

        def fit(k: int) -> tuple[float, np.ndarray, np.ndarray]:
            """On the rows outside of fold k, with the words that stand out there."""
            use = ~np.isnan(y) & (fold != k)
            share = y[use].mean() if use.any() else 0.0
            if share in (0.0, 1.0):
                return (20.0 if share else -20.0), np.zeros(len(chosen)), np.zeros(i)
            cells = use[where] & (chi[which, i * (folds + 1) + k] >= STANDS_OUT)
            place = np.cumsum(use) - 1
            return fit_linear(place[where[cells]], which[cells], len(chosen), earlier[use], y[use])

        def probability(model: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
            z = model[0] + np.bincount(where, model[1][which], minlength=len(held)) + earlier @ model[2]
            return 1 / (1 + np.exp(-z))

        out_of_fold = np.zeros(len(held))
        for k in range(folds):
            out_of_fold[fold == k] = probability(fit(k))[fold == k]
        bias, weights, on_earlier = fit(folds)
        chain.models[category] = Model(float(bias), {w: float(weights[j]) for w, j in number.items() if weights[j]}, [float(x) for x in on_earlier])
        chain.thresholds[category] = _threshold([(p, v) for p, v in zip(out_of_fold, y) if not np.isnan(v)], category)
        earlier = np.column_stack([earlier, out_of_fold])
    return chain


def _scored(docs: DataFrame, chain: Chain, text: str) -> DataFrame:
    """(_row, the whole row, and _p_<category> per category)."""
    telling = sorted({w for m in chain.models.values() for w in m.words})
    weights = {w: [m.words.get(w, 0.0) for m in chain.models.values()] for w in telling}
    found = _looked_up(words(F.col(f"`{text}`")), weights, "array<double>")
    models = range(len(chain.models))  # one sum for all of them: the words are read once
    total = F.aggregate(found, F.array(*[F.lit(0.0) for _ in models]), lambda a, v: F.array(*[a[i] + v[i] for i in models]))
    # a condition that always holds but is not known to is a barrier: a filter
    # on the column is not pushed below and does not take the words again
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.when(F.spark_partition_id() >= 0, total).alias("_total"))
    for i, (category, m) in enumerate(chain.models.items()):
        z = F.lit(m.bias) + F.col("_total")[i]
        for name, v in zip(list(chain.models)[:i], m.chain):
            z = z + F.col(_p(name)) * v
        out = out.withColumn(_p(category), 1 / (1 + F.exp(-z)))
    return out.drop("_total")


def score(docs: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, p_<category> per category and
    <category>, whether the probability reaches the threshold.

    A null or empty text has no words and gets each model's base rate.
    Repeated rows are scored each; a null doc_id is kept; further columns are
    ignored; an empty table gives no rows.
    """
    return _scored(docs, chain, text).select(
        F.col("_row")[id].alias(id), *[F.col(_p(c)).alias(f"p_{c}") for c in chain.models],
        *[(F.col(_p(c)) >= t).alias(c) for c, t in chain.thresholds.items()])


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled labels with their documents' texts, one row per label.  The
    sample is bounded, so it is the side that is broadcast.  Of several texts
    of one id the smallest is taken, so copies add no rows."""
    chosen = sample(labels.select("doc_id", F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int")).alias("low_quality"),
                                  F.col("toxic").cast("int").alias("toxic")), "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("low_quality").alias("low_quality"), F.max("toxic").alias("toxic"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, low_quality and toxic of every document."""
    return score(docs, train(labelled_documents(docs, labels)))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with their columns as they were."""
    chain = train(labelled_documents(docs, labels))
    return _scored(docs, chain, text).where(F.col("_p_toxic") < chain.thresholds["toxic"]).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "toxic")
