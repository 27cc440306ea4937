"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers, floor(256 x).  With every candidate lengthened by one
component to the largest norm M, |q - x|^2 = |q|^2 + M - 2 q.x, so the highest
scores are the nearest vectors and distance bounds may prune exactly.

1. Equal vectors are one candidate with its k + 1 smallest ids (more of them
   can never be among the k best), taken with a partial limit before the
   shuffle; equal queries are solved once.
2. Pivots, a fixed small number of vectors in hash order, part the space into
   Voronoi cells.  Summaries are kept per cell: its candidates' count and the
   k + 1 distances nearest to the pivot.
3. Queries of a cell form groups.  From the range of a group's distances to
   every pivot and the cells' summaries follows a radius that holds k + 1
   candidates for each of its queries; the triangle inequality then tells which
   distances to a pivot a needed candidate can have.
4. Only such candidates are replicated to the group, dealt into units of
   bounded size, and solved unit by unit; the units' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SCALE = 256
TOP_K = 5
PIVOTS = 16          # per vector length: what is broadcast is this many vectors
GROUP_ROWS = 512     # queries solved together
UNIT_ROWS = 4096     # candidates solved at a time
QUERY_EVERY = 50
FLOAT_MAX = 3.4028234663852886e38  # the largest 32-bit float; beyond it a component counts as non-finite


def _floor(x: Column) -> Column:
    """The floor as a double (``floor`` gives a long, which may not hold it)."""
    whole = F.rint(x)
    return whole - F.when(whole > x, F.lit(1.0)).otherwise(F.lit(0.0)) + F.lit(0.0)


def quantised(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v array<double>): rows with an id and a vector of finite components,
    each a whole number that a double holds exactly."""
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= F.lit(FLOAT_MAX)))
    return (vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & whole)
            .select(F.col(id).cast("long").alias("id"),
                    F.transform(F.col(vector), lambda x: _floor(x.cast("double") * SCALE)).alias("v")).distinct())


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray, longest: float, candidate: bool) -> np.ndarray:
    """Distances of rows of x to the lengthened pivots."""
    own = (x * x).sum(axis=1, dtype=np.float64)
    more = np.sqrt(np.maximum(longest - own, 0)) if candidate else np.zeros(len(x))
    p_own = (pivots * pivots).sum(axis=1, dtype=np.float64)
    p_more = np.sqrt(np.maximum(longest - p_own, 0))
    square = (own + more ** 2)[:, None] + (p_own + p_more ** 2)[None, :] - 2 * (x @ pivots.T + more[:, None] * p_more[None, :])
    return np.sqrt(np.maximum(square, 0))


def _assign(model: Broadcast, candidate: bool):
    """(dim, v, tag) -> (dim, cell, dist, dists, v, tag): the nearest pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                pivots, longest = model.value[int(dim)]
                d = _distances(_lists(part.column("v")).reshape(part.num_rows, int(dim)), pivots, longest, candidate)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]),
                     pa.array([] if candidate else list(d), pa.list_(pa.float64())) if not candidate else pa.nulls(len(d), pa.list_(pa.float64())),
                     part.column("v"), part.column("tag")], names=["dim", "cell", "dist", "dists", "v", "tag"])
    return run


def _needs(summaries: Broadcast, k: int):
    """Groups (grp, dim, low, high), the ranges of distances to every pivot ->
    (grp, dim, cell, unit, near, far): candidates of the cell at such distances
    from its pivot are needed, dealt into the cell's units."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in batches:
            out = []
            for grp, dim, low, high in zip(groups["grp"], groups["dim"], groups["low"], groups["high"]):
                longest, cells = summaries.value.get(int(dim), (0.0, []))
                reach = np.sort(np.concatenate([[high[c] + x for x in nearest] for c, _, nearest in cells])) if cells else np.zeros(0)
                radius = reach[k] if len(reach) > k else np.inf
                # room for rounding: a distance is off by the root of what its squares lose
                length, far = np.sqrt(longest), max((high[c] for c, _, _ in cells), default=0.0)
                radius = radius * (1 + 1e-9) + 1e-3 + 1e-6 * (length + far)
                if (far + length) * length >= _TOP / 2:  # scores beyond a long are ties: all that reach it are needed
                    radius = max(radius, np.sqrt(max(0.0, (far + length) ** 2 + longest - 2 * _TOP)) * (1 + 1e-6))
                    if radius ** 2 >= (longest + 2 * _TOP) * (1 - 1e-6):
                        radius = np.inf
                for c, units, _ in cells:
                    out += [(grp, int(dim), c, u, low[c] - radius, high[c] + radius) for u in range(units)]
            yield pd.DataFrame(out, columns=["grp", "dim", "cell", "unit", "near", "far"])
    return run


def _solve(k: int):
    """Rows (unit, side, v, tag) sorted by unit and side, queries (side 0) before
    candidates (side 1) -> (qid, id, score): the best k + 1 of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, qids, q = None, [], []
        best: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            n = [len(s) for s, _ in best]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(qids, np.int64)[:len(best)], n)),
                pa.array(np.concatenate([i for _, i in best]) if best else np.zeros(0, np.int64)),
                pa.array(np.concatenate([s for s, _ in best]) if best else np.zeros(0, np.int64))], names=["qid", "id", "score"])

        for batch in batches:
            units, sides = batch.column("unit").to_numpy(), batch.column("side").to_numpy()
            edges = np.flatnonzero((np.diff(units) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(units)]))):
                if hi == lo:
                    continue
                if units[lo] != unit:
                    if best:
                        yield flush()
                    unit, qids, q, best = units[lo], [], [], []
                part = batch.slice(lo, hi - lo)
                x = _lists(part.column("v"))
                if sides[lo] == 0:
                    qids += [t[0] for t in part.column("tag").to_pylist()]
                    q.append(x)
                    continue
                tags = part.column("tag")
                which = np.repeat(np.arange(hi - lo), np.diff(tags.offsets.to_numpy()))
                ids = tags.flatten().to_numpy(zero_copy_only=False)
                queries = np.concatenate(q) if q else np.zeros((0, x.shape[1]))
                for r, scores in enumerate(_products(queries, x)):
                    s, i = scores[which], ids
                    if len(best) > r:
                        s, i = np.concatenate([best[r][0], s]), np.concatenate([best[r][1], i])
                    if len(s) > k + 1:
                        few = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                        s, i = s[few], i[few]
                    order = np.lexsort((i, ~s))[:k + 1]  # ~s: the negative of the least long is no long
                    if len(best) > r:
                        best[r] = (s[order], i[order])
                    else:
                        best.append((s[order], i[order]))
        if best:
            yield flush()
    return run


_TOP = 2.0 ** 63


def _wrapped(v: np.ndarray) -> np.ndarray:
    """Whole doubles modulo 2^64, as signed longs."""
    size = np.fmod(np.abs(v), 2.0 ** 64).astype(np.uint64)
    return np.where(v < 0, np.uint64(0) - size, size).view(np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; beyond a long the nearest long.

    Small ones are exact as floats.  Otherwise longs that wrap around are exact
    wherever the true product is a long, which floats with a bound on their
    error tell; the few products too near the border are summed one by one.
    """
    if q.size == 0 or x.size == 0:
        return np.zeros((len(q), len(x)), np.int64)
    rough = q @ x.T
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 53:
        return rough.astype(np.int64)
    error = (np.abs(q) @ np.abs(x).T) * (2.0 ** -52 * (q.shape[1] + 2))
    out = _wrapped(q) @ _wrapped(x).T
    out[rough - error >= _TOP] = np.iinfo(np.int64).max
    out[rough + error < -_TOP] = np.iinfo(np.int64).min
    near = (np.abs(rough) + error >= _TOP) & (rough - error < _TOP) & (rough + error >= -_TOP)
    for i, j in zip(*np.nonzero(near)):
        exact = sum(int(a) * int(b) for a, b in zip(q[i], x[j]))
        out[i, j] = min(max(exact, np.iinfo(np.int64).min), np.iinfo(np.int64).max)
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP_K, id: str = "vec_id", vector: str = "embedding",
          pivots: int = PIVOTS) -> DataFrame:
    """For every query vector the k candidates of the highest integer inner
    product, but for the candidate of the query's own id -> query_id, rank,
    vec_id, score; ties go to the smaller id.

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component (for doubles: beyond the range of a 32-bit float), take no part
    on either side.  A score beyond the range of a long is the nearest long,
    and such equal scores are ties like others.  Repeated rows count once.  Vectors
    are compared with vectors of their own length only.  With fewer candidates
    a query has fewer rows, with none it has no row; further columns are
    ignored; empty tables give no rows.
    """
    spark = queries.sparkSession
    asked = cut(quantised(queries, id, vector).withColumn("dim", F.size("v")))
    heads = asked.groupBy("v", "dim").agg(F.min("id").alias("qid"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    data = (quantised(candidates, id, vector).withColumn("nth", nth).where(F.col("nth") <= k + 1)
            .groupBy("v").agg(F.collect_list("id").alias("tag")))
    data = cut(data.withColumn("dim", F.size("v")).withColumn("own", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))

    longest = {r.dim: r.m for r in data.groupBy("dim").agg(F.max("own").alias("m")).collect()}
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("v"), "v"))
    chosen: dict[int, list] = {}
    for r in data.select("dim", "v").withColumn("place", place).where(F.col("place") <= pivots).select("dim", "v").collect():
        chosen.setdefault(r.dim, []).append(r.v)
    model = spark.sparkContext.broadcast({dim: (np.array(v, np.float64).reshape(len(v), dim), longest[dim]) for dim, v in chosen.items()})
    dims = list(chosen) or [-1]

    located = "dim int, cell int, dist double, dists array<double>, v array<double>, tag array<long>"
    placed = cut(data.select("dim", "v", "tag").mapInArrow(_assign(model, True), located).drop("dists"))
    near = F.row_number().over(Window.partitionBy("dim", "cell").orderBy("dist"))
    nearest: dict[tuple[int, int], list[float]] = {}
    for r in placed.select("dim", "cell", "dist").withColumn("n", near).where(F.col("n") <= k + 1).collect():
        nearest.setdefault((r.dim, r.cell), []).append(r.dist)
    summaries: dict[int, tuple[float, list]] = {}
    units: dict[tuple[int, int], int] = {}
    for r in placed.groupBy("dim", "cell").count().collect():
        units[r.dim, r.cell] = -(-r["count"] // UNIT_ROWS)
        summaries.setdefault(r.dim, (longest[r.dim], []))[1].append((r.cell, units[r.dim, r.cell], sorted(nearest[r.dim, r.cell])))

    # groups of queries: a cell's, in hash order, as many as its size asks for
    q = (heads.where(F.col("dim").isin(dims)).select("dim", "v", F.array("qid").alias("tag"))
         .mapInArrow(_assign(model, False), located))
    q = cut(q)
    sizes = q.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("groups"))
    q = (q.join(sizes, ["dim", "cell"])
         .withColumn("grp", F.xxhash64("dim", "cell", F.pmod(F.xxhash64("tag"), F.col("groups")))))
    ranges = q.groupBy("grp", "dim").agg(*[F.min(F.get("dists", F.lit(c))).alias(f"low{c}") for c in range(pivots)],
                                         *[F.max(F.get("dists", F.lit(c))).alias(f"high{c}") for c in range(pivots)])
    ranges = ranges.select("grp", "dim", F.array(*[f"low{c}" for c in range(pivots)]).alias("low"),
                           F.array(*[f"high{c}" for c in range(pivots)]).alias("high"))
    needs = cut(ranges.mapInPandas(_needs(spark.sparkContext.broadcast(summaries), k),
                                   "grp long, dim int, cell int, unit int, near double, far double"))

    unit_of = F.create_map(*[x for key, n in units.items() for x in (F.lit(f"{key[0]}:{key[1]}"), F.lit(n))]) if units else F.create_map(F.lit(""), F.lit(1))
    count = F.element_at(unit_of, F.concat_ws(":", F.col("dim").cast("string"), F.col("cell").cast("string")))
    dealt = placed.withColumn("unit", F.pmod(F.xxhash64("v"), count).cast("int"))
    one = F.xxhash64("grp", "dim", "cell", "unit").alias("unit")
    copies = (dealt.join(needs, ["dim", "cell", "unit"]).where("dist BETWEEN near AND far")
              .select(one, F.lit(1).alias("side"), "v", "tag"))
    askers = (q.drop("cell", "dim").join(needs, "grp").select(one, F.lit(0).alias("side"), "v", "tag"))
    rows = askers.union(copies).repartition("unit").sortWithinPartitions("unit", "side")
    found = rows.mapInArrow(_solve(k), "qid long, id long, score long")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = (found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
            .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), F.col("id").alias("id")))).alias("best")))
    answered = (asked.join(heads, ["v", "dim"]).select(F.col("id").alias("query_id"), "qid").join(best, "qid"))
    own_out = answered.withColumn("best", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k))
    return (own_out.select("query_id", F.posexplode("best").alias("at", "b"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.bitwise_not("b.less").alias("score")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), vectors)


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP_K}
"""
