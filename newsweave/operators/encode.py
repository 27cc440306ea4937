"""Fixed-length token-id encoding.

Ids: 0 start, 1 pad, 2 end, 3 unknown, words from 4 in vocabulary order.
Each row becomes ``[start] + ids[:max_len-2] + [end] + pads`` with a mask of
ones over the real positions; both arrays are exactly ``max_len`` long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import END_ID, FIRST_WORD_ID, MAX_LEN, PAD_ID, START_ID, UNKNOWN_ID
from ..functions.ranking import positions

def build_vocab(tokens_df: DataFrame, tokens: str = "tokens", size: int | None = None) -> DataFrame:
    """Tokens -> ids (count desc, token asc).

    All tokens by default; ``size`` keeps the most frequent ones.  Ids come
    from exact global positions, so no task sorts the whole vocabulary.
    """
    counts = (tokens_df.select(F.explode_outer(tokens).alias("word"))
              .where(F.col("word") != "")
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    placed = positions(counts, [F.desc("n"), F.col("word")], "__place")
    if size is not None:
        placed = placed.where(F.col("__place") < size)
    return placed.select("word", "n", (F.col("__place") + FIRST_WORD_ID).cast("long").alias("id"))


def encode_sequences(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", key: str = "row_id",
                     max_len: int = MAX_LEN, type_ids: bool = False) -> DataFrame:
    """M5: (key, input_word_ids, input_mask), both ``max_len`` long; with
    ``type_ids=True`` also ``input_type_ids`` (all zeros: one segment).

    A row's first ``max_len - 2`` tokens are exploded with their position,
    joined to the vocabulary and regrouped per key, so the feature's own limit
    bounds the shuffle; token-less rows survive through ``posexplode_outer``.
    """
    ex = df.select(key, F.posexplode_outer(F.slice(tokens, 1, max_len - 2)).alias("__pos", "word"))
    j = ex.join(vocab.select("word", "id"), "word", "left")
    ids = (j.groupBy(key)
           .agg(F.sort_array(F.collect_list(
               F.when(F.col("__pos").isNotNull(),
                      F.struct("__pos", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id"))))).alias("__l"))
           .select(key, F.transform("__l", lambda s: s["id"].cast("int")).alias("__ids")))
    real = F.size("__ids") + 2
    extra = [F.array_repeat(F.lit(0), max_len).alias("input_type_ids")] if type_ids else []
    return ids.select(
        key,
        F.concat(F.array(F.lit(START_ID)), F.col("__ids"), F.array(F.lit(END_ID)),
                 F.array_repeat(F.lit(PAD_ID), max_len - real)).alias("input_word_ids"),
        F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), max_len - real)).alias("input_mask"),
        *extra)
