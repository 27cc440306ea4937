"""Plan shape of every registered query: no cross products, no row-at-a-time
Python, pruned scans, and no window over all rows of one class."""

import re

import pytest

from conftest import SF001
from newsweave.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_product_or_row_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (name, bad)


def test_article_scans_read_two_columns(spark):
    plan = _plan(QUERIES["category_profile"](spark, SF001))
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert scans and all(s == "struct<doc_id:bigint,text:string>" for s in scans), scans


def test_split_reads_wide_rows_once(spark):
    """One narrow scan for the thresholds, its exchange shared, and one wide."""
    df = QUERIES["stratified_split"](spark, SF001)
    df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    # the main plan is one stage: the wide rows meet no exchange and no join
    main = re.findall(r"^[\s:+*()\-\d]*([A-Z]\w+)", plan, re.M)
    assert main[:3] == ["AdaptiveSparkPlan", "ResultQueryStage", "Project"] or "Exchange" not in main[:main.index("FileScan")]
    assert len(re.findall(r"FileScan parquet", _plan(df).split("== Initial Plan ==")[0])) <= 2
    windows = re.findall(r"Window \[row_number\(\) windowspecdefinition\(([^)]*)\)", plan)
    assert all("__b" in w for w in windows if "__at" in w)


def test_text_rules_run_on_materialised_columns(spark):
    """N-grams zip shifted slices: the words are extracted once per text."""
    assert _plan(QUERIES["top_trigrams"](spark, SF001)).count("regexp_extract_all") == 1


def test_tokeniser_rules_run_once(spark):
    """Vocabulary and lemma lookup read checkpointed tokens, not the texts."""
    plan = _plan(QUERIES["normalize_text"](spark, SF001))
    assert "FileScan" not in plan and "RDDScan" in plan.replace("Scan ExistingRDD", "RDDScan")


def test_encoding_explodes_at_most_the_kept_tokens(spark):
    assert "254" in _plan(QUERIES["encode_sequences"](spark, SF001))


def test_batched_inference_uses_arrow(spark):
    plan = _plan(QUERIES["batched_inference"](spark, SF001))
    assert "ArrowEvalPython" in plan
