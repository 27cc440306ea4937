"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.

    Where the session names none, a plain local run (one JVM: ``local[n]``)
    gets a temporary folder; a cluster run raises, since its executors share
    no local disk.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get(CHECKPOINT_CONF, None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="newsweave-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` with ``value`` bound once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unit_fraction(c: Column) -> Column:
    """A text's fixed pseudo-random number in [0, 1): 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
