"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words and cut into windows of ten consecutive
words (a shorter item is one window).  All windows form one automaton; every
document is normalised the same way and scanned once.  Hits are word spans;
for documents that have any, they are mapped back to code-point offsets in the
original text.

The automaton is broadcast, and its size is checked: items are dealt into
parts of at most ``PART_WORDS`` window words, each part is an automaton, and a
benchmark beyond one part is scanned part by part, the hits so far travelling with the
text through the shared checkpoint folder.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table
from .words import ALNUM, LOWER

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PART_WORDS = 2_000_000  # words in the windows of one automaton: about 200 MB of memory at most

#: A-Z lower-cased, word bytes kept, every other byte a blank.
_PLAIN = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def windows(words: list[str], width: int = WINDOW) -> list[str]:
    n = max(1, len(words) - width + 1) if words else 0
    return [" ".join(words[i:i + width]) for i in range(n)]


def parts_of(items: DataFrame, part_words: int = PART_WORDS) -> Iterator[list[tuple[str | None, str]]]:
    """Items (item_id, text) -> parts of (item_id, normalised words).

    The driver holds one part at a time; an item longer than a part is a part
    of its own.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), 0)
    rows = (items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
            .select("item", F.concat_ws(" ", "w").alias("words"), (F.size("w") * WINDOW).alias("need")).distinct())
    part, room = [], part_words
    for r in rows.toLocalIterator():
        if part and r.need > room:
            yield part
            part, room = [], part_words
        part.append((r.item, r.words))
        room -= r.need
    yield part


def automaton(items: list[tuple[str | None, str]]):
    """Automaton over the items' windows with blanks around; a window leads to
    (words, items that have it).  Characters are UTF-8 bytes.  None if empty."""
    import ahocorasick
    owners: dict[str, set] = {}
    for item, words in items:
        for w in windows(words.encode().decode("latin-1").split(" ")):
            owners.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, who in owners.items():
        a.add_word(f" {w} ", (w.count(" ") + 1, tuple(x for x in who if x is not None)))
    if owners:
        a.make_automaton()
    return a if owners else None


def scan_text(a, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, disjoint [start, end) runs of hit words, items that occur)."""
    words = plain_words(text)
    if a is None or not words:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(a.iter(line))
    if not found:
        return len(words), [], set()
    # a match ends at the blank after its last word, which is blank number words-so-far + 1
    blanks = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    who: set[str] = set()
    spans = []
    for end, (n, items) in found:
        last = int(blanks[end]) - 1
        spans.append((last - n, last))
        who.update(items)
    return len(words), united(spans), who


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as [start, end) code points of the original text."""
    if not runs:
        return []
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SO_FAR = [("_hits", _SPANS), ("_items", pa.list_(pa.string()))]
_FOUND = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
          ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("hits", _SPANS)]
_DDL = {"_hits": "array<struct<start:int,end:int>>", "_items": "array<string>",
        "_found": "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                  "items array<string>, hits array<struct<start:int,end:int>>"}


def _pairs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans]


def _scanner(part: Broadcast, text_column: str, last: bool):
    """Columns k0.., perhaps t and, after the first part, _hits and _items ->
    the same with this part's hits, or k0.. and the findings after the last
    part.  The text is one of k0.. if it is kept, else t."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(part.value)
        for batch in batches:
            texts = batch.column(text_column)
            keys = [n for n in batch.schema.names if n not in ("t", "_hits", "_items")]
            before = batch.column("_hits").to_pylist() if "_hits" in batch.schema.names else None
            names = batch.column("_items").to_pylist() if before is not None else None
            rows = []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                n, spans, who = scan_text(a, text)
                if before is not None:
                    spans = united(spans + [(x["start"], x["end"]) for x in before[i]])
                    who |= set(names[i])
                items = sorted(who)
                if last:
                    rows.append((n, sum(e - s for s, e in spans), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(),
                                 bool(spans), items, _pairs(original_spans(text, spans))))
                else:
                    rows.append((_pairs(spans), items))
            schema = _FOUND if last else _SO_FAR
            new = [pa.array([r[k] for r in rows], type=t) for k, (_, t) in enumerate(schema)]
            held = keys if last or text_column != "t" else [*keys, "t"]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in held] + new, names=held + [n for n, _ in schema])
    return run


def scan(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
         part_words: int = PART_WORDS) -> DataFrame:
    """docs and items (item_id, text) -> ``keep``'s columns, n_words, n_hit,
    n_items, items_sha256, contaminated, items, hits; one row per document.

    ``hits`` are [start, end) code points of the original text.  A null text
    has no words; an item without words has no windows; without items nothing
    is hit.  Equal item rows count once; an item with a null id hits words but
    is not named or counted.  Documents' columns beyond ``keep`` are ignored.
    """
    spark = docs.sparkSession
    text_column = f"k{list(keep).index(text)}" if text in keep else "t"
    apart = [F.col(f"`{text}`").alias("t")] if text_column == "t" else []
    df = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *apart)
    keys = ", ".join(f"k{i} {df.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    carried = f"{keys}, t string" if apart else keys
    parts = parts_of(items, part_words)
    part = next(parts)
    while part is not None:
        after = next(parts, None)
        run = _scanner(spark.sparkContext.broadcast(part), text_column, after is None)
        schema = f"{keys}, {_DDL['_found']}" if after is None else f"{carried}, _hits {_DDL['_hits']}, _items {_DDL['_items']}"
        df = df.mapInArrow(run, schema)
        if after is not None:
            df = cut(df)
        part = after
    found = [n for n, _ in _FOUND]
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *found)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no window of an item occurs in."""
    out = scan(docs, items, docs.columns, text)
    n = len(docs.columns)
    named = out.toDF(*[f"c{i}" for i in range(n)], *[f"f{i}" for i in range(len(out.columns) - n)])
    at = [name for name, _ in _FOUND].index("contaminated")
    return named.where(~F.col(f"f{at}")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    return (scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '{WORD}')"
ORACLE = rf"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT rid, k, dw.n, item_id FROM dw JOIN iw USING (win, n)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
