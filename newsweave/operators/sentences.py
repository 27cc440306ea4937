"""Sentence ends learned from the corpus, without a list of abbreviations.

A dot ends a sentence unless it belongs to its word.  Which words are
abbreviations is learned from counts by Dunning's log-likelihood ratio, as
published for unsupervised sentence splitting: an abbreviation nearly always
has its dot, is short, and may hold dots inside.  Words that follow sentence
ends far more often than chance (the same ratio) are sentence starters; before
one of them even an abbreviation, an initial or an acronym ends its sentence.

Learning reads the texts once: it counts each word with what stands before it,
told apart only where that may end a sentence, with map-side partials.  All else
(edges, dots, scores) is worked out on those distinct rows, not on every word.
Applying is a lookup in the words that were learned, in one projection over the
texts, once per place where a sentence may end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokenize as tk
from ..functions.fixed import (ABBREVIATION_SCORE, DOT_PROBABILITY, INITIALS, PLAIN_WORD, STARTER_SCORE,
                               WORD_EDGES)
from ..session import materialize
from . import lookup

ABBREVIATION, STARTER = 1, 2  # flags of a learned word
DIGITS = 3                    # decimals of the scores
MAY_END = r" (?<=[.!?] )"     # the blank behind a word that may end a sentence


def bare(word: Column) -> Column:
    """The word without what surrounds it, lower-cased, its last dot kept."""
    return F.regexp_replace(F.lower(word), WORD_EDGES, "")


def undotted(word: Column) -> Column:
    return F.regexp_replace(word, r"\.$", "")


def counted_words(df: DataFrame, col: str) -> DataFrame:
    """Texts -> lead, form, dot, n: how often each word's form stands behind
    each lead, with or without a dot of its own.

    ``lead`` is the word before, if it has a dot at its end; `!` for one that
    ends with ! or ?; empty for any other, which ends no sentence; null before
    a text's first word.
    """
    words = df.select(F.split(tk.collapse_blanks(F.col(col)), " ").alias("__w"))
    both = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "__w").alias("before"), F.col("__w").alias("word"))
    each = words.select(F.explode_outer(both).alias("p")).where(F.col("p.word").isNotNull()).select("p.*")
    before = F.col("before")
    lead = (F.when(before.endswith("."), before).when(before.endswith("!") | before.endswith("?"), "!")
            .when(before.isNotNull(), ""))
    counts = each.groupBy(lead.alias("lead"), "word").agg(F.count(F.lit(1)).alias("n"))
    bared = counts.select("lead", bare(F.col("word")).alias("b"), "n")
    return (bared.select("lead", undotted(F.col("b")).alias("form"), F.endswith("b", F.lit(".")).alias("dot"), "n")
            .where(F.col("form").rlike(PLAIN_WORD)))


def likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at probability p; 0 * log 0 is 0."""
    part = lambda x, y: F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))
    return part(k, p) + part(n - k, F.lit(1.0) - p)


def _times(n: Column, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, n)), F.lit(0).cast("long"))


def word_counts(counted: DataFrame) -> DataFrame:
    """counted_words -> form, n_dot, n_plain: how often each word has a dot behind it."""
    return counted.groupBy("form").agg(_times(F.col("n"), F.col("dot")).alias("n_dot"), _times(F.col("n"), ~F.col("dot")).alias("n_plain"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """word_counts -> form, n_dot, n_plain, score of the abbreviations."""
    total = counts.agg(F.struct(F.sum("n_dot").alias("dot"), F.sum(F.col("n_dot") + F.col("n_plain")).alias("all"))).scalar()
    n = F.col("n_dot") + F.col("n_plain")
    p = F.col("t.dot") / F.col("t.all")
    ratio = 2 * (likelihood(F.col("n_dot"), n, F.lit(DOT_PROBABILITY)) - likelihood(F.col("n_dot"), n, p))
    letters = F.length(F.replace("form", F.lit("."), F.lit("")))
    dots = F.length("form") - letters + 1
    # always dotted, short, dotted inside; each time without its dot counts against a longer word
    score = ratio * F.exp(-letters) * dots * F.pow(letters.cast("double"), -F.col("n_plain"))
    return (counts.withColumn("t", total).where((F.col("n_dot") > 0) & (F.col("t.dot") < F.col("t.all")))
            .select("form", "n_dot", "n_plain", F.round(score, DIGITS).alias("score")).where(F.col("score") >= ABBREVIATION_SCORE))


def starters(ends: DataFrame) -> DataFrame:
    """(form, after, n): each word, whether a sentence ended before it, and how
    often -> form, n_after, n, start_score of the sentence starters."""
    counts = materialize(ends.groupBy("form").agg(_times(F.col("n"), F.col("after")).alias("n_after"), F.sum("n").alias("n")))
    total = counts.agg(F.struct(F.sum("n_after").alias("after"), F.sum("n").alias("all"))).scalar()
    k1, n1 = F.col("n_after"), F.col("t.after")
    k2, n2 = F.col("n") - k1, F.col("t.all") - n1
    p, p1, p2 = F.col("n") / F.col("t.all"), k1 / n1, k2 / n2
    ratio = 2 * (likelihood(k1, n1, p1) + likelihood(k2, n2, p2) - likelihood(k1, n1, p) - likelihood(k2, n2, p))
    known = counts.withColumn("t", total).where((F.col("t.after") > 0) & (F.col("t.after") < F.col("t.all")))
    return (known.where(p1 > p).select("form", "n_after", "n", F.round(ratio, DIGITS).alias("start_score"))
            .where(F.col("start_score") >= STARTER_SCORE))


def learn(df: DataFrame, col: str = "combined_text") -> DataFrame:
    """Texts -> the words that decide: form, kind (1 abbreviation, 2 sentence
    starter, 3 both), score, start_score.

    Null and empty texts teach nothing; the table is empty where no word
    passes.  It is checkpointed, since both learning and applying read it.
    """
    counted = materialize(counted_words(df, col))
    abbr = materialize(abbreviations(materialize(word_counts(counted))))
    known = abbr.select("form", F.lit(ABBREVIATION).alias("kind"))
    follow = counted.where(F.col("lead").isNotNull()).groupBy("lead", "form").agg(F.sum("n").alias("n"))
    start = starters(lookup.with_value(follow, "after", _flags(known), lambda m, r: _ends(r["lead"], None, m)))
    out = abbr.select("form", "score").join(start.select("form", "start_score"), "form", "full")
    kind = F.when(F.col("score").isNotNull(), ABBREVIATION).otherwise(0) + F.when(F.col("start_score").isNotNull(), STARTER).otherwise(0)
    return materialize(out.select("form", kind.cast("int").alias("kind"), "score", "start_score"))


def _flags(learned: DataFrame) -> Column:
    """The learned words as a value for every task; their number is checked."""
    words = lookup.fits(learned, "form")
    if words is None:
        raise ValueError(f"more than {lookup.MAX_WORDS} words were learned: raise the least scores")
    return lookup.hashed_map(learned, "form", "kind", words)


def _ends(word: Column, following: Column | None, flags: Column) -> Column:
    """Whether a sentence ends after the word."""
    form = undotted(bare(word))
    keeps = form.rlike(INITIALS) | (F.coalesce(lookup.looked_up(flags, form), F.lit(0)).bitwiseAND(ABBREVIATION) != 0)
    if following is not None:
        start = F.coalesce(lookup.looked_up(flags, undotted(bare(following))), F.lit(0)).bitwiseAND(STARTER) != 0
        keeps = keeps & ~start
    return F.when(word.endswith("!") | word.endswith("?"), True).when(word.endswith("."), ~keeps).otherwise(False)


def mark(df: DataFrame, learned: DataFrame, col: str = "combined_text", out: str = "marked") -> DataFrame:
    """Texts with blanks collapsed and a line break at each sentence end, for
    ``tokenize(..., marked=True)``; null stays null.

    ``learned`` has form and kind (of ``learn``, or a table of one's own)."""
    def joined(flags: Column, row: Column) -> Column:
        # a sentence may end only after . ! or ?: the parts between such places stay whole
        def of(parts: Column) -> Column:
            return F.array_join(F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.concat(
                a, F.when(b.isNull(), "").when(_ends(F.substring_index(a, " ", -1), F.substring_index(b, " ", 1), flags), "\n").otherwise(" "))), "")
        return F.element_at(F.transform(F.array(F.split(tk.collapse_blanks(row[col]), MAY_END)), of), 1)
    return lookup.with_value(df, out, _flags(learned), joined)


def split_sentences(df: DataFrame, learned: DataFrame, col: str = "combined_text", out: str = "sentences",
                    marked: str | None = None) -> DataFrame:
    """The text's sentences as an array; a text without words has none.
    ``marked`` names a column of ``mark``, if the rows have one."""
    whole = df if marked else mark(df, learned, col, "__marked")
    sentences = whole.withColumn(out, F.filter(F.split(marked or "__marked", "\n"), lambda s: s != ""))
    return sentences if marked else sentences.drop("__marked")


def tokenize(df: DataFrame, learned: DataFrame, col: str = "combined_text", out: str = "tokens",
             marked: str | None = None) -> DataFrame:
    """T1 with learned sentence ends (``marked`` as in ``split_sentences``)."""
    whole = df if marked else mark(df, learned, col, "__marked")
    tokens = whole.withColumn(out, tk.tokenize(F.col(marked or "__marked"), marked=True))
    return tokens if marked else tokens.drop("__marked")
