"""Every query of the catalog against its DuckDB statement (sf0.001; the
driver's gate runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from conftest import SF001
from newsweave.plans.catalog import QUERIES
from newsweave.plans.oracle import ORACLE
from verify import compare


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    rows_only = {"train_and_score", "validation_report", "model_evaluation", "minibatch_training",  # trained model
                 "encode_subwords"}  # byte-level merges: tested against the public library
    assert set(QUERIES) - set(ORACLE) == rows_only
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["category", "articles"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    rec = compare(spark, SF001, [name], verbose=False)[name]
    assert rec["ok"], rec
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held  # nothing stays cached
