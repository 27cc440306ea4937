"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words.  A document's expected number of
copies is its source's target divided by its source's size; the expected
copies are prefix-summed within the source, one fixed random offset per source
is added, and a document is emitted once for each whole number its step
crosses.  Documents are ordered by size within the source, so the words taken
differ from the target by less than the size of the source's largest document.

The rank inside a source comes from one range partitioning of narrow rows
(source, size, doc_id): a source with any share of the rows is spread over all
partitions, and only one row per (partition, source) is gathered for the
offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, unit_fraction

WEIGHTS = (5, 2, 1)      # by rank of the source, repeating
MAX_REPEATS = 3          # a source's target over its size, at most
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources by code point, null last, take the weights in turn and share the
    total of all sizes; a target stops at ``max_repeats`` times its source's
    size and the excess goes to the others by weight.  Filling by weight is a
    water level: a source is full if level * weight reaches its bound, so the
    sources fill in the order of bound / weight.  One row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * max_repeats
    by_level = Window.orderBy((F.col("bound") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # level if this source and all after it stay open; the first that holds is the level
    s = (sizes.withColumn("w", w.cast("long")).withColumn("bound", bound)
         .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
         .withColumn("fits", F.col("left") * F.col("w") <= F.col("bound") * F.col("open_w")))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("bound") / F.col("w"), F.col("left") / F.col("open_w")))).over(everything)
    return (s.withColumn("level", level["col2"])
            .select("source", "source_size",
                    F.least(F.col("bound").cast("double"), F.col("level") * F.col("w")).alias("target")))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size) -> the rows in the order (source, size, doc_id)
    with ``at``, their place in ``part``; and one row per (part, source):
    first, its lowest ``at``, before, the source's rows in earlier parts, and
    part_size.  Ties are equal rows, so any order of them is the same result."""
    rows = (docs.select("doc_id", "source", "size")
            .repartitionByRange(F.col("source").asc_nulls_last(), "size", "doc_id")
            .sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "doc_id")
            .withColumn("at", F.monotonically_increasing_id()))
    rows = cut(rows.withColumn("part", F.shiftright("at", 33)))
    firsts = (rows.groupBy("part", "source")
              .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("part_size")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, firsts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        seed: int = SEED) -> DataFrame:
    """Documents (doc_id, source, text) -> doc_id, source, size, source_size,
    target, copies, taken; one row per input row.

    A null text has size 0.  A null source is a source of its own.  A source
    without words has target 0 and none of its documents is taken.  Repeated
    rows count as often as they stand; columns beyond the three are ignored;
    an empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows, firsts = placed(sized)
    goal = targets(firsts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_repeats)
    # targets travel with the small rows, so no row is dealt by its source alone
    f, g = firsts.alias("f"), goal.alias("g")
    per_part = (f.join(g, F.col("f.source").eqNullSafe(F.col("g.source")))
                .select("f.part", "f.source", (F.col("f.before") - F.col("f.first")).alias("shift"), "g.source_size", "g.target"))
    p, f = rows.alias("p"), per_part.alias("f")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_fraction(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("p.source"), F.lit("\x00null"))))
    out = (p.join(f, (F.col("p.part") == F.col("f.part")) & F.col("p.source").eqNullSafe(F.col("f.source")))
           .select("p.doc_id", "p.source", "p.size", (F.col("p.at") + F.col("f.shift")).alias("pos"), "f.source_size", "f.target",
                   rate.alias("rate"), offset.alias("u")))
    crossed = lambda k: F.floor((F.col("pos") + k) * F.col("rate") + F.col("u"))
    copies = F.least(crossed(1) - crossed(0), F.lit(max_repeats).cast("long"))
    return (out.withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as ``mix`` says, all columns
    kept.  Rows with one doc_id and source cannot be told apart; their copies
    are dealt evenly over them."""
    keys = {"_k1": F.coalesce("doc_id", F.lit(-1)), "_k2": F.col("doc_id").isNull(),
            "_k3": F.coalesce("source", F.lit("")), "_k4": F.col("source").isNull()}
    plan = (mix(docs, **options).groupBy(*[c.alias(k) for k, c in keys.items()])
            .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
            .where("_copies > 0"))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("_copies"))
    times = F.floor(k * F.col("_copies") / F.col("_rows")) - F.floor((k - 1) * F.col("_copies") / F.col("_rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in keys.items()])
    return (rows.join(plan, list(keys)).withColumn("_times", times)
            .where("_times > 0")
            .withColumn("_copy", F.explode(F.expr("sequence(1L, _times)")))
            .select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# The same water level in SQL; the plain rule, filling source by source, is
# restated by the tests.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS bound FROM s),
o AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER lv, 0) AS open_w, sum(source_size) OVER () - coalesce(sum(bound) OVER lv, 0) AS rest FROM w
      WINDOW lv AS (ORDER BY bound / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT rest::DOUBLE / open_w::DOUBLE AS level FROM o WHERE rest * w <= bound * open_w ORDER BY bound / w, 1 LIMIT 1),
t AS (SELECT source, source_size, least(bound::DOUBLE, level * w) AS target FROM o, lev),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS pos,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('42:' || coalesce(d.source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor((pos + 1) * rate + u) - floor(pos * rate + u), 3) * size)::BIGINT AS taken FROM r
"""
