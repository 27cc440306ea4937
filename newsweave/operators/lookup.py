"""Looking tokens up in a table without exploding the rows.

A table of words (stopwords, a dictionary, forms and their lemmas) is turned
into one hashed value: an array of small maps, a word's map named by its CRC.
It is made by one aggregate and read as a scalar subquery, so token arrays are
rewritten where they lie: no token row is made, shuffled or regrouped.

That value travels to every task, so it is made only of a table whose words
are counted and measured first.  Beyond the bound the table is first cut down
to the words that occur in the rows: a Bloom filter of the table, bits made by
Spark, passes the few candidates, whose distinct words are joined exactly.  If
even those are too many, the tokens are joined row by row (``apply_by_join``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_WORDS = 500_000      # words of a table that may travel to every task
MAX_BYTES = 32 << 20     # and their bytes, values included
WORDS_A_MAP = 4          # words in one of the small maps, about
BLOOM_BITS = 1 << 26     # 8 MB: at most 2 % of other words pass with 8 million words, more beyond
BLOOM_HASHES = 4
_LONG = 64


def measured(table: DataFrame, *columns: str) -> tuple[int, int]:
    """(rows, bytes) of a table's string columns: one aggregate."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    r = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return r["rows"], r["bytes"]


def fits(table: DataFrame, *columns: str, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES) -> int | None:
    """The number of words if the table may travel to every task, else None."""
    rows, size = measured(table, *columns)
    return rows if rows <= max_words and size <= max_bytes else None


def hashed_map(table: DataFrame, key: str, value: str, words: int) -> Column:
    """The table (each key once) as a scalar subquery: array<map<key, value>>,
    one map per slot, empty ones too."""
    maps = max(1, -(-words // WORDS_A_MAP))
    slot = (F.crc32(F.col(key).cast("binary")) % maps).alias("slot")
    per_slot = table.select(slot, F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("e")).groupBy("slot").agg(F.collect_list("e").alias("e"))
    slots = table.sparkSession.range(maps).withColumnRenamed("id", "slot")
    kind = per_slot.schema["e"].dataType.simpleString()
    every = slots.join(per_slot, "slot", "left").agg(F.sort_array(F.collect_list(F.struct("slot", "e"))).alias("listed"))
    return every.select(F.transform("listed", lambda x: F.map_from_entries(F.coalesce(x["e"], F.array().cast(kind))))).scalar()


def with_value(df: DataFrame, out: str, value: Column, use: Callable[[Column, Column], Column]) -> DataFrame:
    """Column ``out`` by ``use(value, row)`` of a subquery's value.

    The analyser allows no subquery inside a function of lambdas, so the value
    is a column first.  The whole row is then rewritten by one lambda that
    reads every column once, so the optimiser puts the subquery and all that
    the columns are made of into that one expression, and no row ever holds
    the value (plan tests check this).
    """
    columns = df.columns
    after = columns + [out] * (out not in columns)
    row = F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns], F.col("__value")))
    new = F.transform(row, lambda r: F.struct(*[(use(r["__value"], r) if c == out else r[c]).alias(c) for c in after]))
    return df.withColumn("__value", value).select(F.element_at(new, 1).alias("__row")).select("__row.*")


def looked_up(maps: Column, word: Column) -> Column:
    """The word's value in a ``hashed_map``, null if it has none."""
    return F.element_at(F.get(maps, (F.crc32(word.cast("binary")) % F.size(maps)).cast("int")), word)


def bloom(table: DataFrame, key: str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """A Bloom filter of the table's words as a scalar subquery: array<long> of
    a fixed length, its words ORed together by Spark."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(hashes)]))
    words = (table.select(at.alias("at")).groupBy(F.expr(f"at div {_LONG}").alias("id"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(at % {_LONG} as int))")).alias("v")))
    every = table.sparkSession.range(-(-bits // _LONG)).join(words, "id", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("l")).select(
        F.transform("l", lambda x: x["v"])).scalar()


def may_contain(filter_: Column, word: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """Whether the word may be in the filter's table; true for all that are."""
    found = F.lit(True)
    for i in range(hashes):
        at = F.pmod(F.xxhash64(word, F.lit(i)), F.lit(bits))
        found = found & (F.bit_get(F.get(filter_, F.floor(at / _LONG).cast("int")), (at % _LONG).cast("int")) == 1)
    return found


def occurring(df: DataFrame, tokens: str, table: DataFrame, key: str) -> DataFrame:
    """The rows of the table whose word occurs in the tokens.  The filter lets
    few other words through, so what is shuffled is the table and its hits."""
    passed = with_value(df.select(tokens), "__hits", bloom(table, key), lambda b, r: F.array_distinct(
        F.filter(r[tokens], lambda t: may_contain(b, t))))
    hits = passed.select(F.explode_outer("__hits").alias(key)).where(F.col(key).isNotNull()).distinct()
    return table.join(hits, key, "left_semi")


def small_enough(df: DataFrame, tokens: str, table: DataFrame, key: str, value: str, max_words: int, max_bytes: int) -> Column | None:
    """The hashed map of the table, or of its words that occur in the rows;
    None if both are beyond the bound."""
    table = materialize(table)
    sized = [c for c, kind in table.dtypes if kind == "string"]
    words = fits(table, *sized, max_words=max_words, max_bytes=max_bytes)
    if words is None:
        table = materialize(occurring(df, tokens, table, key))
        words = fits(table, *sized, max_words=max_words, max_bytes=max_bytes)
    return None if words is None else hashed_map(table, key, value, words)


def replace_tokens(df: DataFrame, tokens: str, table: DataFrame, key: str = "form", value: str = "lemma",
                   row_key: str = "row_id", out: str | None = None,
                   max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every token that the table has (each key once, not null) becomes its
    value; order, empty arrays, null arrays and other columns stay."""
    out = out or tokens
    maps = small_enough(df, tokens, table.select(key, value), key, value, max_words, max_bytes)
    if maps is None:
        return replace_by_join(df, tokens, table, key, value, row_key, out)
    return with_value(df, out, maps, lambda m, r: F.transform(r[tokens], lambda t: F.coalesce(looked_up(m, t), t)))


def drop_tokens(df: DataFrame, tokens: str, table: DataFrame, key: str = "word", row_key: str = "row_id",
                out: str | None = None, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Tokens that the table has are taken out; the table may repeat words and
    hold nulls."""
    out = out or tokens
    words = table.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__in", F.lit(True))
    maps = small_enough(df, tokens, words, key, "__in", max_words, max_bytes)
    if maps is None:
        marked = replace_by_join(df.withColumn("__kept", F.col(tokens)), "__kept", words.withColumn("__none", F.lit(None).cast("string")),
                                 key, "__none", row_key, "__kept", matched="__in")
        return marked.withColumn(out, F.col("__kept")).drop("__kept").select(*df.columns, *([out] if out not in df.columns else []))
    return with_value(df, out, maps, lambda m, r: F.filter(r[tokens], lambda t: looked_up(m, t).isNull()))


def replace_by_join(df: DataFrame, tokens: str, table: DataFrame, key: str, value: str, row_key: str, out: str,
                    matched: str | None = None) -> DataFrame:
    """The same by a join of exploded tokens, for tables of any size; with
    ``matched``, tokens whose row has it are dropped instead.

    Only the row key and the tokens are exploded; the other columns come back
    by the key, which must name one row.  A hot word's rows are split by the
    adaptive join.
    """
    narrow = df.select(row_key, F.posexplode_outer(tokens).alias("__pos", "__word"))
    j = narrow.join(table.withColumnRenamed(key, "__word"), "__word", "left")
    kept = F.col("__pos").isNotNull() & (F.lit(True) if matched is None else F.col(matched).isNull())
    entry = F.when(kept, F.struct("__pos", F.coalesce(value, "__word").alias("t")))
    back = (j.groupBy(row_key).agg(F.sort_array(F.collect_list(entry)).alias("__l"))
            .select(F.col(row_key).alias("__key"), F.transform("__l", lambda s: s["t"]).alias("__new")))
    rest = df.join(back, df[row_key].eqNullSafe(F.col("__key"))).drop("__key")
    same = F.when(F.col(tokens).isNotNull(), F.col("__new"))
    return rest.withColumn(out, same).drop("__new")
