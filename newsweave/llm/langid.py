"""Language identification by compression.

For every language a raw-content zstandard dictionary is made of short
excerpts of labelled documents.  A text is compressed with each dictionary, in
blocks, so that the dictionary counts all the way through a long text; the
smallest total names the language, and the lead over the second smallest is
the score.  Predictions with a narrow lead are marked as rejected.

The model is bounded: at most ``EXCERPTS`` excerpts per language, fewer if
there are very many languages, so that all dictionaries together stay within
``MODEL_BYTES``.  Every whole text is scored, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

EXCERPTS = 1000             # per language: a bounded, documented sample; up to this many Spark limits before it shuffles
BUCKETS = 64                # a language's texts are limited in so many parts by hash before they meet
EXCERPT_CHARS = 128
MODEL_BYTES = 32 << 20      # all dictionaries together
BLOCK = 2048                # bytes compressed at a time
LEVEL = 3
MARGIN = 0.01               # a lead below this is rejected
FOLDS = 5
UNKNOWN = "und"

#: ASCII letters lower-cased, bytes beyond ASCII kept, every other byte a blank.
_LETTERS = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.encode().translate(_LETTERS).split())


def held_out(doc_id: Column) -> Column:
    """Whether a document stays out of training; a null id does."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def first_of(excerpts: DataFrame, limit: int) -> DataFrame:
    """(lang, h, excerpt), all different -> (lang, nth, excerpt): the first
    ``limit`` of a language by hash.  Each task keeps the first of every
    (language, bucket), each bucket its first, and only those of all buckets
    meet in one task per language, a bounded number of rows."""
    bucket = F.pmod(F.col("h"), F.lit(BUCKETS))
    order = ("h", "excerpt")
    inner = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))
    outer = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (excerpts.withColumn("bucket", bucket).withColumn("nth", inner).where(F.col("nth") <= limit)
            .withColumn("nth", outer).where(F.col("nth") <= limit).select("lang", "nth", "excerpt"))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """docs (text, lang) -> language -> dictionary bytes, from excerpts of
    different documents in hash order, at hashed places of their texts."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("lang", "text")
    n_langs = known.select(F.approx_count_distinct("lang")).first()[0]
    per_lang = max(1, min(EXCERPTS, MODEL_BYTES // (4 * EXCERPT_CHARS * max(1, 2 * n_langs))))
    h = F.xxhash64("text")
    place = F.pmod(h, F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(1))) + 1
    each = known.select("lang", h.alias("h"), F.substring("text", place.cast("int"), F.lit(EXCERPT_CHARS)).alias("excerpt")).distinct()
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in first_of(each, per_lang).toLocalIterator():
        parts.setdefault(r.lang, []).append((r.nth, r.excerpt))
    return {lang: b" ".join(letters(x) for _, x in sorted(v)) for lang, v in sorted(parts.items())}


def _compressors(model: dict[str, bytes]) -> dict:
    import zstandard as z
    out = {}
    for lang, content in model.items():
        p = z.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), write_content_size=0, write_dict_id=0, write_checksum=0)
        # a dictionary needs eight bytes at least
        out[lang] = z.ZstdCompressor(compression_params=p, dict_data=z.ZstdCompressionDict(content.ljust(8), dict_type=z.DICT_TYPE_RAWCONTENT))
    return out


def classify(compressors: dict, text: str | None) -> tuple[str, float, bool]:
    """(language, score, rejected).  A text that is null or has no letter, or
    any text without a model, is unknown with score 0; ties go to the language
    first in order."""
    if not text or not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    plain = letters(text)
    blocks = [plain[i:i + BLOCK] for i in range(0, len(plain), BLOCK)] or [b""]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors.items())
    best, second = sizes[0], sizes[min(1, len(sizes) - 1)]
    score = 1.0 if len(sizes) == 1 else (second[0] - best[0]) / max(second[0], 1)
    return best[1], score, score < MARGIN


def _classifier(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model.value)
        for batch in batches:
            texts = batch.column("t")
            rows = [classify(compressors, texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.bool_())], names=["d", "lang_pred", "score", "rejected"])
    return run


def predict(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, rejected; one row per
    row of the input.

    A text that is null or has no letter gets ``und``, score 0 and is
    rejected; so does every text if no labelled text was there to learn from.
    With one language the score is 1.  Repeated rows are judged each; a null
    doc_id is kept; further columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).mapInArrow(
        _classifier(docs.sparkSession.sparkContext.broadcast(model)), f"d {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("d", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
