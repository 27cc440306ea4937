"""Sentence ends learned from counts."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsweave.operators import sentences


def corpus(n=400):
    """Sentences of common words, with two abbreviations that always have their dot."""
    r = random.Random(6)
    words = "said went house river green table under over market paper while north south letter people water".split()
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(2, 6)):
            body = r.choices(words, k=r.randint(3, 9))
            if r.random() < 0.5:
                body.insert(r.randint(0, len(body) - 1), r.choice(["dr.", "approx.", "e.g."]))
            parts.append(" ".join([r.choice(["the", "it", "we"]), *body]) + r.choice([".", ".", "!", "?"]))
        rows.append((i, " ".join(parts)))
    return rows


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(corpus() + [(1000, None), (1001, ""), (1002, "  "), (1003, "alone.")], "row_id long, combined_text string")


@pytest.fixture(scope="module")
def learned(texts):
    return sentences.learn(texts)


def ratio(k, n, p):
    return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)


def test_learned_words_equal_a_plain_count(texts, learned):
    got = {r.form: (r.kind, r.score, r.start_score) for r in learned.collect()}
    dot, plain, after, seen = Counter(), Counter(), Counter(), Counter()
    pairs = [p for _, t in corpus() for p in zip(t.split(), t.split()[1:])]
    every = [w for _, t in corpus() for w in t.split()] + ["alone."]
    for w in every:
        (dot if w.endswith(".") else plain)[w.rstrip("!?").removesuffix(".")] += 1
    n_dot, n = sum(dot.values()), len(every)
    abbr = {}
    for w in dot:
        k, m, letters = dot[w], dot[w] + plain[w], len(w.replace(".", ""))
        ll = 2 * (ratio(k, m, 0.99) - ratio(k, m, n_dot / n))
        score = ll * math.exp(-letters) * (len(w) - letters + 1) * letters ** -plain[w]
        if round(score, 3) >= 0.3:
            abbr[w] = round(score, 3)
    assert set(abbr) >= {"dr", "e.g"} and "house" not in abbr
    n = len(pairs)
    for w, x in pairs:
        b = w.removesuffix(".")
        ends = w[-1] in "!?" or (w.endswith(".") and b not in abbr and b != "e.g")
        x = x.rstrip("!?").removesuffix(".")
        after[x] += ends
        seen[x] += 1
    na, starts = sum(after.values()), {}
    for x in seen:
        k, m = after[x], seen[x]
        ll = 2 * (ratio(k, na, k / na) + ratio(m - k, n - na, (m - k) / (n - na)) - ratio(k, na, m / n) - ratio(m - k, n - na, m / n))
        if k / na > m / n and round(ll, 3) >= 30:
            starts[x] = round(ll, 3)
    assert set(starts) == {"the", "it", "we"}
    want = {w: ((w in abbr) + 2 * (w in starts), abbr.get(w), starts.get(w)) for w in {*abbr, *starts}}
    assert got.keys() == want.keys()
    for w, (kind, a, b) in want.items():
        assert got[w][0] == kind and got[w][1] == pytest.approx(a, abs=2e-3) and got[w][2] == pytest.approx(b, abs=2e-3)


@pytest.mark.parametrize("text, want", [
    ("dr. x went home. we stayed", ["dr. x went home.", "we stayed"]),
    ("it is 3.5 m. away", ["it is 3.5 m. away"]),
    ("with dr. we went", ["with dr.", "we went"]),                   # a starter ends even that sentence
    ("in the u.s. people said", ["in the u.s. people said"]),
    ("j. r. smith said no! yes? ok.", ["j. r. smith said no!", "yes?", "ok."]),
    ("the house. green", ["the house.", "green"]),
    ("  a \n\t b.  c ", ["a b. c"]),                                  # a lone letter with a dot is an initial
    ("", []), (None, None)])
def test_literals(spark, learned, text, want):
    df = spark.createDataFrame([(1, text)], "row_id long, combined_text string")
    assert sentences.split_sentences(df, learned).collect()[0].sentences == want


def test_tokens_keep_the_dot_of_an_abbreviation(spark, learned):
    df = spark.createDataFrame([(1, "dr. x came. it rained, e.g. water."), (2, None), (3, "")], "row_id long, combined_text string")
    got = {r.row_id: r.tokens for r in sentences.tokenize(df, learned).collect()}
    assert got[1] == ["dr.", "x", "came", ".", "it", "rained", ",", "e.g.", "water", "."]
    assert got[2] is None and got[3] == []


def test_every_known_end_is_found(spark, texts, learned):
    """The corpus was put together from sentences, so their number is known."""
    out = sentences.split_sentences(texts, learned).where("row_id < 1000").collect()
    wrong = sum(len(r.sentences) != sum(len(s) > 0 for s in r.combined_text.replace("! ", ".\n").replace("? ", ".\n").replace(". the ", ".\nthe ").replace(". it ", ".\nit ").replace(". we ", ".\nwe ").split("\n")) for r in out)
    assert wrong == 0


def test_small_corpora_teach_nothing(spark):
    for rows in ([], [(1, None)], [(1, "one")], [(1, "a. b. c. d.")]):
        df = spark.createDataFrame(rows, "row_id long, combined_text string")
        table = sentences.learn(df)
        assert table.collect() == []
        assert sentences.tokenize(df, table).count() == len(rows)


def test_texts_are_marked_in_one_projection(spark, texts, learned):
    made = texts.withColumn("combined_text", F.concat("combined_text", F.lit(" "), F.lower("combined_text")))  # read twice, and not cheap
    plan = sentences.mark(made, learned)._jdf.queryExecution().optimizedPlan().toString()
    main = "\n".join(x for x in plan.split("\n") if not x.lstrip("+- ").startswith(":"))  # without the subquery's plan
    assert "Aggregate" not in main and "Generate" not in main and "AS __value" not in main and "scalar-subquery" in main
