"""Length state: bounds hold the exact numbers, parts add up, nothing is read again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from newsweave.operators import lengths, profile
from newsweave.plans import catalog

BOTH = ["headline", "short_description"]


def articles(spark, rows):
    return spark.createDataFrame([(c, None if n is None else "x" * n) for c, n in rows], "category string, headline string")


def test_leading_digits(spark):
    rows = spark.range(0, 5000).select("id", lengths.leading(F.col("id"), 3).alias("low")).collect()
    for r in rows:
        drop = max(0, r.id.bit_length() - 4)
        assert r.low == (r.id >> drop) << drop
        assert r.id - r.low <= r.low / 8


@pytest.mark.parametrize("bits", [0, 2, 7])
def test_bounds_hold_the_exact_numbers(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(c, int(n)) for c in ("hot", "small", "one") for n in rng.lognormal(6, 1.5, {"hot": 900, "small": 41, "one": 1}[c])]
    state = lengths.length_state(articles(spark, rows), ["headline"], bits=bits)
    exact = {r.category: r for r in profile.length_summary(articles(spark, rows), "headline").collect()}
    for r in lengths.box_numbers(state).collect():
        e = exact[r.category]
        for name in ("q1", "median", "q3", "whisker_low", "whisker_high", "outliers"):
            assert r[f"{name}_at_least"] <= e[name] <= r[f"{name}_at_most"], (name, r, e)
        for name in ("q1", "median", "q3"):
            assert r[f"{name}_at_most"] - r[f"{name}_at_least"] <= r[f"{name}_at_least"] * 2.0 ** -bits
    for r in lengths.length_profile(state).collect():
        held = [n for c, n in rows if c == r.category]
        assert r.articles == len(held) and abs(r.mean_len - np.mean(held)) < 1e-6
        assert r.median_at_least <= np.median(held) <= r.median_at_most


def test_short_lengths_are_exact(spark):
    rows = [("a", n) for n in (0, 1, 2, 3, 10, 255)]
    r = lengths.length_profile(lengths.length_state(articles(spark, rows), ["headline"])).first()
    assert r.median_at_least == r.median_at_most == 2.5


def test_whole_tables(spark):
    c = catalog.clean(spark, SF01)
    exact = {r.category: r for r in profile.category_profile(c).collect()}
    got = lengths.length_profile(lengths.length_state(c, BOTH)).collect()
    assert len(got) == 2 * len(exact)
    for r in got:
        e = exact[r.category]
        name = "headline" if r.measure == "headline" else "description"
        assert r.articles == e.articles and abs(r.mean_len - e[f"mean_{name}_len"]) < 1e-6
        assert r.median_at_least <= e[f"median_{name}_len"] <= r.median_at_most


def test_parts_add_up_and_stay_as_they_are(spark, tmp_out):
    rows = [("a", n) for n in range(0, 4000, 7)] + [("b", 5), (None, 9), ("a", None)]
    path = f"{tmp_out}/state"
    lengths.add_part(articles(spark, rows[:100]), path, "1", ["headline"])
    files = {f: os.stat(f"{path}/part=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/part=1")}
    lengths.add_part(articles(spark, rows[100:]), path, "2", ["headline"])
    lengths.add_part(articles(spark, rows[100:]), path, "2", ["headline"])  # a repeated run counts nothing twice
    assert files == {f: os.stat(f"{path}/part=1/{f}").st_mtime_ns for f in os.listdir(f"{path}/part=1")}
    whole = lengths.length_state(articles(spark, rows), ["headline"])
    key = lambda r: tuple((x is not None, x) for x in r)
    merged = lengths.read_state(spark, path).select(*whole.columns)
    assert sorted(map(tuple, merged.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)
    out = {r.category: r for r in lengths.length_profile(merged).collect()}
    assert out["a"].articles == len(rows) - 2 and out[None].median_at_least == 9.0


def test_parts_of_different_precision_meet_at_the_least(spark, tmp_out):
    path = f"{tmp_out}/state"
    one, two = [("a", n) for n in range(300, 900, 3)], [("a", n) for n in range(301, 2000, 11)]
    lengths.add_part(articles(spark, one), path, "1", ["headline"], bits=9)
    lengths.add_part(articles(spark, two), path, "2", ["headline"], bits=4)
    r = lengths.box_numbers(lengths.read_state(spark, path)).first()
    q = np.percentile([n for _, n in one + two], [25, 50, 75])
    for name, x in zip(("q1", "median", "q3"), q):
        assert r[f"{name}_at_least"] <= x + 1e-9 and x - 1e-9 <= r[f"{name}_at_most"]
    assert {x.bits for x in lengths.read_state(spark, path).collect()} == {4}


def test_empty_null_and_odd_names(spark, tmp_out):
    path = f"{tmp_out}/state"
    lengths.add_part(articles(spark, []), path, "none", ["headline"])
    assert lengths.length_profile(lengths.read_state(spark, path)).count() == 0
    only_null = lengths.length_state(articles(spark, [("a", None)]), ["headline"])
    r = lengths.length_profile(only_null).first()
    assert (r.articles, r.mean_len, r.median_at_least) == (1, None, None)
    assert lengths.box_numbers(only_null).count() == 0
    with pytest.raises(ValueError):
        lengths.add_part(articles(spark, []), path, "../x", ["headline"])
    with pytest.raises(ValueError):
        lengths.length_state(articles(spark, []), ["headline"], bits=31)


def test_rows_meet_no_window(spark):
    """Rows are counted before the only exchange they cause."""
    state = lengths.length_state(catalog.clean(spark, SF01), BOTH)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1 and "partial_count" in plan
