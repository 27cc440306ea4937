"""Sub-word encoding against the public library and plain merges (M5)."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from conftest import SF001
from newsweave.functions.fixed import END_ID, FIRST_WORD_ID, PAD_ID, START_ID, VOCABULARY_FILE
from newsweave.operators import subword
from newsweave.plans import catalog

# Fixed value: the same pattern in the library's dialect, where classes are Unicode anyway.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = ["", "a", "don't stop, it's 10:30!", "  two  blanks\n\n\tand breaks ", "naïve façade — über straße ½ ² ١٢", "𝄞 music 🎉🎉 emoji", " nbsp em　wide",
         "x" * 3000, "ab" * 2000, "漢字仮名交じり文", "'S 'RE they'll", "\x1c\x1f\x85 controls", "é combining"]


@pytest.fixture(scope="module")
def ranks(spark):
    return subword.read_vocabulary(spark, VOCABULARY_FILE)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_merges_equal_plain_merges():
    """Small vocabularies of random merges, with many ties and repeats."""
    for seed in range(30):
        r = random.Random(seed)
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 290:
            known = [t for t in ranks if set(t) <= set(b"abc")]
            ranks.setdefault(r.choice(known) + r.choice(known), len(ranks))
        for _ in range(60):
            piece = bytes(r.choices(b"abc", k=r.randint(1, 25)))
            assert subword.merge(piece, ranks) == plain_merge(piece, ranks)


def test_encoding_equals_the_library(spark, ranks, library):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None)]
    df = spark.createDataFrame(docs, "row_id long, combined_text string").repartition(3)
    for max_len in (256, 8, 4096):
        rows = {r.row_id: r for r in subword.encode_subwords(df, ranks, max_len=max_len).collect()}
        assert sorted(rows) == sorted(i for i, _ in docs)
        for i, text in docs:
            ids = [FIRST_WORD_ID + x for x in library.encode_ordinary(text or "")][:max_len - 2]
            assert rows[i].input_word_ids == [START_ID, *ids, END_ID] + [PAD_ID] * (max_len - 2 - len(ids)), text
            assert rows[i].input_mask == [1] * (len(ids) + 2) + [0] * (max_len - 2 - len(ids))


def test_round_trip(spark, ranks):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, combined_text string").withColumn("text", F.lit("clash"))
    out = subword.decode_subwords(subword.encode_subwords(df, ranks, max_len=4096), ranks).collect()
    assert {r.row_id: r.text for r in out} == dict(enumerate(TEXTS))


def test_whole_articles_equal_the_library(spark, library):
    text = {r.row_id: r.combined_text for r in catalog.merged(spark, SF001).select("row_id", "combined_text").collect()}
    rows = catalog.QUERIES["encode_subwords"](spark, SF001).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = [FIRST_WORD_ID + x for x in library.encode_ordinary(text[r.row_id])][:254]
        assert r.input_word_ids[1:1 + len(ids)] == ids and sum(r.input_mask) == len(ids) + 2 and len(r.input_word_ids) == 256


def test_no_row_is_shuffled_and_empty_tables_work(spark, ranks):
    none = spark.createDataFrame([], "row_id long, combined_text string")
    out = subword.encode_subwords(none, ranks)
    assert out.collect() == [] and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lines", [["YQ== 0"], [f"{base64.b64encode(bytes([b])).decode()} 7" for b in range(256)]])
def test_bad_vocabularies_are_refused(spark, tmp_out, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_out}/v")
    with pytest.raises(ValueError):
        subword.read_vocabulary(spark, f"{tmp_out}/v")
