"""Stage 5: exact stratified split, class shares, seeded shuffle, batches.

Rows are ordered inside a class by ``md5('<seed>:' || key)``, then key: a
function of the key alone, so the split is the same in every process, under
any partitioning, and before or after text normalisation.

Skew: a class may hold a third of all rows, so no window is partitioned by
class over the rows: ranks are taken inside (class, hash prefix) buckets of
keys, and rows are then compared with two thresholds per class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import (EPOCHS, SPLIT_SEED, SPLIT_WEIGHTS, TRAIN_BATCH,
                               WARMUP_FRACTION_PERCENT)
from ..functions.ranking import positions

SPLIT_BUCKET_HEX = 4     # 65,536 buckets per class
BLOCK_BATCHES = 8192     # batches of a file of written batches
SPLITS = ("train", "validation", "test")


def order_key(key: str = "row_id", seed: int | str = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _largest_remainder(df: DataFrame, label: str, n: str, target: str, total: str, out: str) -> DataFrame:
    """Integer quotas: n*target div total, plus one for the largest remainders
    (ties by label) until the quotas sum to target.  Runs on the per-class
    table (one row per class); decimal arithmetic keeps n*target exact."""
    prod = f"(cast({n} as decimal(38,0)) * cast({target} as decimal(38,0)))"
    tot = f"cast({total} as decimal(38,0))"
    df = (df.withColumn("__base", F.expr(f"if({total} = 0, 0L, cast({prod} div {tot} as bigint))"))
            .withColumn("__rem", F.expr(f"if({total} = 0, cast(0 as decimal(38,0)), {prod} % {tot})")))
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.desc("__rem"), F.col(label))
    df = (df.withColumn("__short", F.col(target) - F.sum("__base").over(everything))
            .withColumn("__rk", F.row_number().over(ranked)))
    return (df.withColumn(out, F.col("__base") + F.when(F.col("__rk") <= F.col("__short"), 1).otherwise(0))
              .drop("__base", "__rem", "__short", "__rk"))


def quotas_from_counts(counts: DataFrame, label: str = "category",
                       weights: tuple[int, int, int] = SPLIT_WEIGHTS) -> DataFrame:
    """Per-class quotas (label, n, train, validation, test) from (label, n).

    ``weights`` are whole numbers for train, validation and test.  Totals are
    exact: held out = the validation and test share, rounded up, the rest
    trains; of the held-out part validation gets its share, rounded down.
    """
    a, b, c_ = weights
    if min(weights) < 0 or a + b + c_ <= 0 or any(w != int(w) for w in weights):
        raise ValueError(f"weights must be whole, not negative and not all 0: {weights}")
    everything = Window.partitionBy()
    c = (counts.withColumn("__all", F.sum("n").over(everything))
               .withColumn("__keep", F.col("__all") - F.expr(f"(__all * {b + c_} + {a + b + c_ - 1}) div {a + b + c_}")))
    c = _largest_remainder(c, label, "n", "__keep", "__all", "train")
    c = (c.withColumn("__m", F.col("n") - F.col("train"))
          .withColumn("__held", F.sum("__m").over(everything))
          .withColumn("__half", F.expr(f"__held * {b} div {max(1, b + c_)}")))
    c = _largest_remainder(c, label, "__m", "__half", "__held", "validation")
    return c.select(label, "n", "train", "validation", (F.col("__m") - F.col("validation")).alias("test"))


def split_quotas(df: DataFrame, label: str = "category", weights: tuple[int, int, int] = SPLIT_WEIGHTS) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return quotas_from_counts(counts, label, weights)


def split_thresholds(df: DataFrame, label: str = "category", key: str = "row_id",
                     seed: int = SPLIT_SEED, weights: tuple[int, int, int] = SPLIT_WEIGHTS) -> DataFrame:
    """(label, t1, t2): the order key (hash, key) of the last train row and of
    the last validation row of each class; null where there is none.

    Only (label, hash, key) is shuffled, once: ranks inside (class, hash
    prefix) buckets give both the bucket counts and, in the at most two buckets
    per class that a cut falls into, the rows at the cuts.
    """
    rows = df.select(label, F.struct(order_key(key, seed).alias("h"), F.col(key).alias("k")).alias("__at"))
    # the null tests that the joins below imply, stated here so that both sides share one exchange
    rows = (rows.withColumn("__b", F.substring("__at.h", 1, SPLIT_BUCKET_HEX))
            .where(F.col(label).isNotNull() & F.col("__b").isNotNull()))
    bucket = Window.partitionBy(label, "__b")
    ranked = (rows.withColumn("__rank", F.row_number().over(bucket.orderBy("__at")))
              .withColumn("__cnt", F.count(F.lit(1)).over(bucket)))
    buckets = ranked.where("__rank = 1").select(label, "__b", "__cnt")
    quotas = quotas_from_counts(buckets.groupBy(label).agg(F.sum("__cnt").alias("n")), label,
                                weights).select(
        label, F.col("train").alias("__c1"), (F.col("train") + F.col("validation")).alias("__c2"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda c: (F.col("__lo") < F.col(c)) & (F.col(c) <= F.col("__lo") + F.col("__cnt"))
    cut = (buckets.withColumn("__lo", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))
           .join(quotas, label).where(inside("__c1") | inside("__c2")).drop("__cnt"))
    place = F.col("__lo") + F.col("__rank")
    return (ranked.drop("__cnt").join(cut, [label, "__b"]).groupBy(label)
            .agg(F.max(F.when(place == F.col("__c1"), F.col("__at"))).alias("t1"),
                 F.max(F.when(place == F.col("__c2"), F.col("__at"))).alias("t2")))


def stratified_split(df: DataFrame, label: str = "category", key: str = "row_id",
                     seed: int = SPLIT_SEED, weights: tuple[int, int, int] = SPLIT_WEIGHTS,
                     out: str = "split", on_small_class: str = "quota") -> DataFrame:
    """M1: add ``split`` in {train, validation, test} with exact per-class quotas.

    A class with fewer rows than parts of positive weight gets what the
    largest remainders leave it (``on_small_class='quota'``), or raises
    (``'error'``: a class of one row cannot be stratified), which counts the
    classes first.
    The wide rows are read once and compared with their class's two
    thresholds, a map with one entry per class from a scalar subquery; they are
    neither sorted, joined nor shuffled for it.
    """
    if on_small_class not in ("quota", "error"):
        raise ValueError(f"on_small_class is 'quota' or 'error', not {on_small_class!r}")
    if on_small_class == "error":
        small = df.where(F.col(label).isNotNull()).groupBy(label).count().where("count < 2").orderBy(label).limit(5).collect()
        if small:
            raise ValueError(f"classes of one row cannot be stratified: {', '.join(str(r[label]) for r in small)}")
    cuts = split_thresholds(df, label, key, seed, weights)
    of_class = cuts.agg(F.map_from_entries(F.collect_list(F.struct(label, F.struct("t1", "t2"))))).scalar()
    at = F.struct(order_key(key, seed).alias("h"), F.col(key).alias("k"))
    # a class without any threshold has no row in train or validation
    return (df.withColumn("__t", F.element_at(of_class, F.col(label))).withColumn("__at", at)
            .withColumn(out, F.when(F.col("__at") <= F.col("__t.t1"), "train")
                        .when(F.col("__at") <= F.col("__t.t2"), "validation").otherwise("test"))
            .select(*df.columns, out))


def class_distribution(split_df: DataFrame, label: str = "category", split: str = "split") -> DataFrame:
    """Share of each class within each split (window over the small count table)."""
    c = split_df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(split)), 9))


def global_rank(df: DataFrame, key: str = "row_id", seed: int | str = SPLIT_SEED,
                out: str = "position") -> DataFrame:
    """Exact 0-based position in the seeded order, without a single-partition window."""
    return positions(df.withColumn("__h", order_key(key, seed)), [F.col("__h"), F.col(key)], out).drop("__h")


def assign_batches(df: DataFrame, batch_size: int = TRAIN_BATCH, key: str = "row_id",
                   seed: int | str = f"shuffle:{SPLIT_SEED}") -> DataFrame:
    """M4: seeded full shuffle cut into batches of ``batch_size`` (last one short)."""
    r = global_rank(df, key, seed)
    return r.withColumn("batch", F.floor(F.col("position") / batch_size).cast("long"))


def write_batches(df: DataFrame, path: str, batch_size: int = TRAIN_BATCH, key: str = "row_id",
                  seed: int | str = f"shuffle:{SPLIT_SEED}", block_batches: int = BLOCK_BATCHES) -> None:
    """M4 / J5 on disk: the rows with position and batch, a folder per block of
    ``block_batches`` consecutive batches, sorted inside.

    A batch is read from its block's folder alone, and there from the row
    groups that may hold it.  A block is one task's file, whose size the
    caller sets.  Beside the rows stands the manifest: block, first_batch,
    last_batch, first_position, rows.
    """
    placed = assign_batches(df, batch_size, key, seed).withColumn("block", F.floor(F.col("batch") / block_batches).cast("long"))
    (placed.repartition("block").sortWithinPartitions("block", "position")
     .write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows"))
    kept = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    (kept.groupBy("block").agg(F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"),
                               F.min("position").alias("first_position"), F.count(F.lit(1)).alias("rows"))
     .withColumn("block_batches", F.lit(block_batches).cast("long"))
     .coalesce(1).sortWithinPartitions("block").write.mode("overwrite").parquet(f"{path}/manifest"))


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_batches(spark, path: str, first: int, last: int | None = None) -> DataFrame:
    """The rows of batches ``first`` to ``last`` (to the end if None), to go on
    from a batch or to take one: only their blocks' folders are listed as
    input.  Batches beyond the end have no rows."""
    size = read_manifest(spark, path).agg(F.max("block_batches")).first()[0] or 1
    wanted = (F.col("batch") >= first) & (F.col("block") >= first // size)
    if last is not None:
        wanted = wanted & (F.col("batch") <= last) & (F.col("block") <= last // size)
    return spark.read.parquet(f"{path}/rows").where(wanted)


def batch_plan(df: DataFrame, batch_size: int = TRAIN_BATCH, epochs: int = EPOCHS,
               warmup_percent: int = WARMUP_FRACTION_PERCENT) -> DataFrame:
    """Batches per epoch, total steps and warm-up steps (one-row aggregate)."""
    n = F.count(F.lit(1))
    return (df.agg(n.alias("rows"))
            .withColumn("batches_per_epoch", F.expr(f"cast((rows + {batch_size - 1}) div {batch_size} as bigint)"))
            .withColumn("total_steps", F.col("batches_per_epoch") * epochs)
            .withColumn("warmup_steps", F.expr(f"cast(total_steps * {warmup_percent} div 100 as bigint)")))


def persist_splits(split_df: DataFrame, path: str, split: str = "split") -> None:
    """Write the split partitioned by `split` (readers prune partitions)."""
    split_df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark, path: str, which: str, split: str = "split") -> DataFrame:
    return spark.read.parquet(path).where(F.col(split) == which)
