"""Stage 4: text normalisation, lemma table, word and n-gram tables.

Per-row steps are array expressions in one projection.  The only step that
needs another table is the lemma lookup: the (form, lemma) table is built by
a Spark job over the *distinct* vocabulary and looked up where the tokens lie
(``lookup``), so token rows are neither made nor regrouped.

Exploded expressions use the outer form: for the inner one Spark infers a
filter on the array and evaluates the whole expression for it a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokenize as tk
from ..functions.fixed import NOUN_SUFFIX_RULES, STOPWORDS_EN
from ..session import materialize
from . import lookup


def load_lexicon(spark, path: str | None = None, kind: str = "stopwords", fmt: str = "csv"):
    """Stopword list or lemma dictionary (column `word`), or the lemma
    exceptions (columns `form`, `lemma`; kind "exceptions").

    Without a path the built-in English stopword list is returned as a
    DataFrame; dictionaries and exceptions are user-supplied tables.
    """
    if path is None:
        if kind != "stopwords":
            raise ValueError("a dictionary table must be supplied")
        return spark.createDataFrame([(w,) for w in STOPWORDS_EN], "word string")
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    columns = ("form", "lemma") if kind == "exceptions" else ("word",)
    return reader.format(fmt).load(path).select(*[F.col(c).cast("string") for c in columns])


def cleaned_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """T1 -> T2 -> T3 (still containing the empties of stripped punctuation)."""
    return tk.strip_punctuation(tk.remove_stopwords(tk.tokenize(text), stopwords))


def materialize_tokens(df: DataFrame, tokens: str) -> DataFrame:
    """``materialize`` with the tokens joined by blanks, which none of them
    holds: an array in the checkpoint takes three times the bytes of its text.
    Empty tokens stay; an empty array stays one, a null null."""
    size, joined = F.size(tokens).alias("__size"), F.array_join(tokens, " ").alias(tokens)
    kept = materialize(df.select(*[joined if c == tokens else F.col(f"`{c}`") for c in df.columns], size))
    back = F.when(F.col("__size") == 0, F.array().cast("array<string>")).otherwise(F.split(tokens, " "))
    return kept.withColumn(tokens, back).drop("__size")


def vocabulary(tokens_df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct non-empty tokens (a partial-aggregate distinct)."""
    return (tokens_df.select(F.explode_outer(tokens).alias("word"))
            .where(F.col("word") != "").distinct())


def lemma_table(vocab: DataFrame, dictionary: DataFrame | None = None,
                exceptions: DataFrame | None = None) -> DataFrame:
    """T4's lexicon: (form, lemma) for the forms whose lemma differs.

    Candidates come from the noun suffix rules; a candidate counts only if
    it is in the dictionary (default: the vocabulary itself); the shortest
    wins, the form itself before others of its length, then by text.  A form in
    ``exceptions`` (form, lemma) takes its lemma from there.  Dictionary words and candidates are unioned and
    grouped by the candidate text, so membership is one aggregate over
    vocabulary-sized input (no self join); a text is the candidate of at
    most one form per rule, so no group grows with the data.
    """
    f = F.col("word")
    cands = F.array(*[
        F.when(f.endswith(suf) & (F.length(f) > len(suf)) if suf == "s" else f.endswith(suf),
               F.concat(f.substr(F.lit(1), F.length(f) - len(suf)), F.lit(rep)))
        for suf, rep in NOUN_SUFFIX_RULES])
    c = (vocab.select(F.explode(cands).alias("lemma"), f.alias("form"))
         .where(F.col("lemma").isNotNull() & (F.col("lemma") != F.col("form"))))
    words = (vocab if dictionary is None else dictionary).select(
        F.col("word").alias("lemma"), F.lit(None).cast("string").alias("form"))
    by_text = (c.unionByName(words).groupBy("lemma")
               .agg(F.max(F.col("form").isNull()).alias("known"),
                    F.collect_set("form").alias("forms")))
    hit = by_text.where("known").select("lemma", F.explode("forms").alias("form"))
    shorter = F.length("lemma") < F.length("form")
    if dictionary is None:  # every form is a word
        hit = hit.where(shorter)
    else:
        known = dictionary.select(F.col("word").alias("form")).distinct().withColumn("__word", F.lit(True))
        hit = hit.join(known, "form", "left").where(shorter | F.col("__word").isNull()).drop("__word")
    found = (hit.groupBy("form")
             .agg(F.min(F.struct(F.length("lemma").alias("l"), F.col("lemma").alias("x"))).alias("m"))
             .select("form", F.col("m.x").alias("lemma")))
    if exceptions is None:
        return found
    listed = (exceptions.select("form", "lemma").join(vocab.select(F.col("word").alias("form")), "form", "left_semi")
              .groupBy("form").agg(F.min("lemma").alias("lemma")))
    return found.join(listed, "form", "left_anti").unionByName(listed.where("lemma <> form"))


def apply_lemmas(df: DataFrame, tokens: str, lemmas: DataFrame, key: str = "row_id",
                 out: str | None = None) -> DataFrame:
    """Replace every token by its lemma, keeping order and empty arrays."""
    return lookup.replace_tokens(df, tokens, lemmas, "form", "lemma", key, out)


def remove_stopwords(df: DataFrame, tokens: str, words: list[str] | DataFrame | None = None,
                     key: str = "row_id", out: str | None = None) -> DataFrame:
    """T2 / J2 over a column of tokens: a literal list, or a table (column
    ``word``) of any size."""
    if isinstance(words, DataFrame):
        return lookup.drop_tokens(df, tokens, words, "word", key, out)
    return df.withColumn(out or tokens, tk.remove_stopwords(F.col(tokens), words))


def clean_tokens(df: DataFrame, col: str, out: str, stopwords: list[str] | DataFrame | None = None,
                 key: str = "row_id") -> DataFrame:
    """T1 -> T2 -> T3 as a column; the rules run once, also before a table of
    stopwords, whose size decides how it is looked up."""
    if not isinstance(stopwords, DataFrame):
        return df.withColumn(out, cleaned_tokens(F.col(col), stopwords))
    tokens = materialize(df.withColumn(out, tk.tokenize(F.col(col))))
    return remove_stopwords(tokens, out, stopwords, key).withColumn(out, tk.strip_punctuation(F.col(out)))


def normalize_text(df: DataFrame, col: str = "combined_text", key: str = "row_id",
                   dictionary: DataFrame | None = None, stopwords: list[str] | DataFrame | None = None,
                   squeeze: bool = False, exceptions: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """Tokenise, stopwords, punctuation, lemma, drop empties, digits, join.

    The result replaces ``col``.  ``stopwords`` is a list or a table (column
    ``word``).  ``squeeze=True`` also drops the empties left by the digit step
    (the reference keeps them as double blanks).  ``first`` gives the first
    rows by key only (F5): the lemma table still comes from all rows, the
    lookup and all after it take those few.
    """
    # the rules run once: the vocabulary and the lookup both read the checkpointed tokens
    toks = materialize_tokens(clean_tokens(df, col, "__tok", stopwords, key).drop(col), "__tok")
    vocab = vocabulary(toks, "__tok")
    lem = lemma_table(vocab, dictionary, exceptions)
    if first is not None:
        toks = toks.orderBy(key).limit(first)
    withl = apply_lemmas(toks, "__tok", lem, key)
    if squeeze:
        final = tk.join_tokens(tk.drop_empty(tk.strip_digits(tk.drop_empty(F.col("__tok")))))
    else:
        final = tk.strip_digits_joined(tk.drop_empty(F.col("__tok")))
    return withl.withColumn(col, final).drop("__tok")


# --- word and n-gram tables (per raw category, over whole texts) -----------------

def word_frequencies(df: DataFrame, col: str = "combined_text", label: str = "category",
                     stopwords: list[str] | DataFrame | None = None) -> DataFrame:
    """Word counts per class minus stopwords (partial aggregate).  A table
    of stopwords (column ``word``) of any size meets the counts, not the words:
    one row per class and word."""
    w = df.select(label, F.explode_outer(tk.word_tokens(F.col(col))).alias("word")).where(F.col("word").isNotNull())
    counted = lambda rows: rows.groupBy(label, "word").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(stopwords, DataFrame):
        return counted(w).join(stopwords.select("word"), "word", "left_anti").select(label, "word", "n")
    stop = STOPWORDS_EN if stopwords is None else stopwords
    return counted(w.where(~F.col("word").isin(stop)))


def top_by_count(df: DataFrame, k: int, label: str = "category", item: str = "word") -> DataFrame:
    """O3 / top-k per class: the window runs on the aggregated table, whose
    size is bounded by the distinct items per class, not by rows."""
    w = Window.partitionBy(label).orderBy(F.desc("n"), F.col(item))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def word_weights(df: DataFrame, top: int = 200, col: str = "combined_text", label: str = "category") -> DataFrame:
    """Top words per class with weight = count / max count in the class."""
    t = top_by_count(word_frequencies(df, col, label), top, label, "word")
    return t.withColumn("weight", F.round(F.col("n") / F.max("n").over(Window.partitionBy(label)), 9))


def ngram_rows(df: DataFrame, n: int, col: str = "combined_text", label: str = "category") -> DataFrame:
    """(label, gram): every in-document n-gram.  The shifted words are zipped and
    exploded, then joined row by row in generated code, without lambdas."""
    words = df.select(label, tk.word_tokens(F.col(col)).alias("__w"))
    k = F.greatest(F.size("__w") - n + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice("__w", F.lit(i + 1), k).alias(f"w{i}") for i in range(n)])
    g = words.select(label, F.explode_outer(shifted).alias("g")).where(F.col("g").isNotNull())
    return g.select(label, F.concat_ws(" ", *[F.col(f"g.w{i}") for i in range(n)]).alias("gram"))


def ngram_counts(df: DataFrame, n: int, col: str = "combined_text", label: str = "category") -> DataFrame:
    """In-document n-gram counts per class (stopwords kept)."""
    return ngram_rows(df, n, col, label).groupBy(label, "gram").agg(F.count(F.lit(1)).alias("n"))


def top_ngrams(df: DataFrame, n: int, k: int = 10, col: str = "combined_text", label: str = "category") -> DataFrame:
    """O3: the k most common n-grams per class, ties by text."""
    return top_by_count(ngram_counts(df, n, col, label), k, label, "gram")


def ngram_counts_straddling(df: DataFrame, n: int = 2, col: str = "combined_text", label: str = "category",
                            key: str = "row_id") -> DataFrame:
    """N-gram counts over the concatenation of a class's texts in key order.

    In-document n-grams are counted where the rows lie.  The n-grams that cross
    a document boundary start in the last n-1 words of a document and continue
    into the heads (first n-1 words) of the next n-1 non-empty documents of the
    class; only (label, key, head, tail) is shuffled for them, range-partitioned
    so that a large class is spread over many parts.  A window inside each part
    finds the successors there, a window over one row per (class, part) those
    in later parts.
    """
    m = n - 1
    ends = (df.select(label, key, tk.word_tokens(F.col(col)).alias("__w"))
            .select(label, key, F.slice("__w", 1, m).alias("head"),
                    F.slice("__w", F.greatest(F.size("__w") - m, F.lit(0)) + 1, F.lit(m)).alias("tail"))
            .where(F.size("head") > 0))
    ends = materialize(ends.repartitionByRange(label, key).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(label, "__part").orderBy(key)
    docs = (ends.withColumn("__next", F.collect_list("head").over(inside.rowsBetween(1, m)))
            .withColumn("__rn", F.row_number().over(inside)))
    heads = (docs.where(F.col("__rn") <= m)
             .groupBy(label, "__part")
             .agg(F.sort_array(F.collect_list(F.struct("__rn", "head"))).alias("__h"))
             .select(label, "__part", F.transform("__h", lambda s: s["head"]).alias("__bh")))
    later = Window.partitionBy(label).orderBy("__part").rowsBetween(1, m)
    parts = heads.select(label, "__part", F.flatten(F.collect_list("__bh").over(later)).alias("__after"))
    # only a part's last n-1 documents look into later parts
    last = F.col("__next")
    j = docs.join(parts, [label, "__part"], "left")
    follow = F.slice(F.flatten(F.concat(last, F.coalesce("__after", F.array().cast("array<array<string>>")))), 1, m)
    stream = j.select(label, F.size("tail").alias("__t"), F.concat(F.col("tail"), follow).alias("__s"))
    # grams of the stream that start in the tail; a tail has at most m words, so all of them cross
    cross = stream.select(label, F.explode(F.slice(tk.ngrams(F.col("__s"), n), F.lit(1), F.col("__t"))).alias("gram"))
    # one aggregate over both: the distinct n-grams are shuffled, held and spilled once
    return ngram_rows(df, n, col, label).unionByName(cross).groupBy(label, "gram").agg(F.count(F.lit(1)).alias("n"))
