"""Array functions over score and embedding vectors.

All are built-in higher-order expressions (transform / aggregate / zip_with),
evaluated inside the JVM; no Python crosses the boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import PROB_CLIP

# Stand-in dense layer used by the scoring queries: k outputs over a
# d-dimensional input, weights given by a closed formula so that Spark,
# NumPy and SQL compute the same matrix.
DENSE_CLASSES = 10
DENSE_DIM = 64


def dense_weights_numpy(k: int = DENSE_CLASSES, d: int = DENSE_DIM):
    import numpy as np
    c = np.arange(k)[:, None]
    j = np.arange(d)[None, :]
    w = (((c * 7 + j * 13) % 17) - 8) / 8.0
    b = ((np.arange(k) % 3) - 1) / 10.0
    return w, b


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dense(vec: Column, weights: Sequence[Sequence[float]] | None = None, bias: Sequence[float] | None = None) -> Column:
    """W x + b, one output per row of ``weights`` (default: the stand-in
    matrix).  The weights are one literal, folded once per plan."""
    if weights is None:
        weights, bias = (a.tolist() for a in dense_weights_numpy())
    bias = [0.0] * len(weights) if bias is None else bias
    rows = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in w]).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, bias)])
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(vec, r["w"], lambda x, w: x.cast("double") * w), F.lit(0.0),
                                                   lambda acc, x: acc + x) + r["b"])


def softmax(scores: Column) -> Column:
    """exp(x - max) / sum(exp(x - max))."""
    powers = let(F.array_max(scores), lambda m: F.transform(scores, lambda x: F.exp(x - m)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(e, lambda x: x / s)))


def sigmoid(scores: Column) -> Column:
    """C14: element-wise logistic."""
    return F.transform(scores, lambda x: 1.0 / (1.0 + F.exp(-x)))


def argmax(scores: Column) -> Column:
    """0-based index of the maximum, first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def round_all(arr: Column, digits: int = 9) -> Column:
    return F.transform(arr, lambda x: F.round(x, digits))


def max_pool(df: DataFrame, group: str, vec: str, out: str = "pooled") -> DataFrame:
    """Element-wise maximum of the vectors of each group.

    posexplode -> max per (group, position) is a partial aggregate (a hot
    group is combined map-side); the regroup collects one value per
    position, so the collected list is bounded by the vector width.
    """
    e = df.select(group, F.posexplode(vec).alias("__pos", "__x"))
    m = e.groupBy(group, "__pos").agg(F.max("__x").alias("__m"))
    return (m.groupBy(group)
            .agg(F.sort_array(F.collect_list(F.struct("__pos", "__m"))).alias("__l"))
            .select(group, F.transform("__l", lambda s: s["__m"]).alias(out)))


def clipped_log_loss(probs: Column, label: Column, eps: float = PROB_CLIP) -> Column:
    """Per-row -ln p(true), p clipped to [eps, 1 - eps] (A16's summand)."""
    # a label without a class has probability 0, clipped like any other
    p = F.when((label >= 0) & (label < F.size(probs)), F.get(probs, label)).otherwise(0.0)
    return -F.log(F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))


def pool_sequence(vectors: Column) -> Column:
    """One vector per row from a sequence of token vectors (element-wise max)."""
    first = F.element_at(vectors, 1)
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), first,
                       lambda acc, v: F.zip_with(acc, v, lambda a, b: F.greatest(a, b)))
