"""Grouping spelling variants: words one edit apart, found by letter counts.

A word is a point: how often it holds each letter.  One replaced code point
takes one from one letter and gives one to another (L1 distance at most two,
between words of equal length); one inserted code point adds one to one letter
(distance one, to the next length).  Per length the points lie in a k-d tree.

The top of each tree, down to cells of about ``CELL`` words, is made on the
driver from a bounded sample of the vocabulary; where it cuts is a matter of
balance only.  Every word goes to its own cell, and as a query to all other
cells whose box its ball of allowed changes meets: the search goes down both
sides of a split only while a change is left to pay for the crossing.  Inside
a cell the tree is carried on to leaves of ``LEAF`` words, and what meets there
is compared letter by letter.  Pairs of one length are tried once, in the cell
of the higher number; a cell reports counts and its best word per word, never
the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table
from .merkle import crc32_sql

MIN_CHARS = 6       # shorter words are not grouped
MIN_COUNT = 5       # nor are rarer ones
DOMINANCE = 5       # a form is at least so many times as frequent as its variant
CELL = 1024         # words in a cell, about
MAX_CELLS = 8192    # cells in all; a larger vocabulary has larger cells
SAMPLE = 65536      # words that the upper splits are made from, about
LEAF = 64           # words compared letter by letter
BLOCK = 1 << 22     # comparisons held at a time
TYPO = 199          # the query deletes a letter where this divides the checksum
RUN = "[A-Za-zÀ-ÿ]"
DIMS = 26 + 64      # a-z; every other code point by its last six bits


# -- points ---------------------------------------------------------------

def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    wide = flat.reshape(len(words), length)
    return wide.astype(np.uint8) if not len(flat) or flat.max() < 256 else wide


def points(code: np.ndarray) -> np.ndarray:
    """Letter counts of rows of code points.  Letters that share a dimension
    only bring points nearer, so a bound on the distance still holds."""
    c = code.astype(np.int64)
    dim = np.where((c >= 97) & (c < 123), c - 97, 26 + (c & 63))
    out = np.bincount((np.arange(len(c))[:, None] * DIMS + dim).ravel(), minlength=len(c) * DIMS)
    return out.reshape(len(c), DIMS).astype(np.int32)


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Length -> places of the words of that length."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    return {int(sizes[g[0]]): g for g in np.split(order, cuts) if len(g)}


# -- trees ----------------------------------------------------------------

def split(p: np.ndarray) -> tuple[int, int] | None:
    """(dimension, threshold): at most the threshold goes left.  The split that
    halves the points best; none if all are equal."""
    best = None
    for d in np.argsort(-p.var(axis=0), kind="stable")[:6]:
        values, n = np.unique(p[:, d], return_counts=True)
        if len(values) > 1:
            left = np.cumsum(n)[:-1]
            k = int(np.argmin(np.abs(2 * left - len(p))))
            worth = abs(2 * int(left[k]) - len(p))
            if best is None or worth < best[0]:
                best = (worth, int(d), int(values[k]))
    return best and best[1:]


def grow(p: np.ndarray, size: float, first: int):
    """Tree over sample points: a cell's number, or (dimension, threshold,
    left, right); and the next free number.  ``size`` is how many points of
    the sample make a cell."""
    cutting = split(p) if len(p) > size else None
    if cutting is None:
        return first, first + 1
    d, t = cutting
    left, n = grow(p[p[:, d] <= t], size, first)
    right, n = grow(p[p[:, d] > t], size, n)
    return (d, t, left, right), n


NONE = -1  # no change made yet


class Ball:
    """Points on their way down a tree, each with the changes it may still
    make: one letter more (``up``), one less (``down``)."""

    def __init__(self, at: np.ndarray, up: np.ndarray, down: np.ndarray, may_down: bool):
        self.at, self.up, self.down, self.may_down = at, up, down, may_down

    @classmethod
    def of(cls, at: np.ndarray, may_down: bool) -> Ball:
        none = np.full(len(at), NONE, dtype=np.int16)
        return cls(at, none, none, may_down)

    def sides(self, p: np.ndarray, d: int, t: int) -> tuple[Ball, Ball]:
        """What goes left and right; a crossing is paid with a change of ``d``."""
        v = p[self.at, d] + (self.up == d) - (self.down == d)
        left, right = v <= t, v > t
        lower = (right & (v == t + 1) & (self.down == NONE)) if self.may_down else np.zeros(len(v), bool)
        higher = left & (v == t) & (self.up == NONE)
        go_left, go_right = left | lower, right | higher
        return (Ball(self.at[go_left], self.up[go_left], np.where(lower, np.int16(d), self.down)[go_left], self.may_down),
                Ball(self.at[go_right], np.where(higher, np.int16(d), self.up)[go_right], self.down[go_right], self.may_down))


def homes(tree, p: np.ndarray) -> np.ndarray:
    """The cell each point lies in."""
    out = np.zeros(len(p), dtype=np.int64)
    stack = [(tree, np.arange(len(p)))]
    while stack:
        node, at = stack.pop()
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            left = p[at, node[0]] <= node[1]
            stack += [(node[2], at[left]), (node[3], at[~left])]
    return out


def reached(tree, p: np.ndarray, may_down: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, places of the points whose ball meets its box)."""
    stack = [(tree, Ball.of(np.arange(len(p)), may_down))]
    while stack:
        node, ball = stack.pop()
        if not len(ball.at):
            continue
        if isinstance(node, int):
            yield node, ball.at
        else:
            left, right = ball.sides(p, node[0], node[1])
            stack += [(node[2], left), (node[3], right)]


# -- letters --------------------------------------------------------------

def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a x rows of b, equal lengths: differ in one place exactly?"""
    away = np.zeros((len(a), len(b)), dtype=np.uint8)
    for j in range(a.shape[1]):
        away += (a[:, None, j] != b[None, :, j]) & (away < 2)
    return away == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a x rows of b, one longer: is a row of b one of a with one code
    point more?  The common beginning and end must cover a."""
    n = a.shape[1]
    head, tail = (np.zeros((len(a), len(b)), dtype=np.int32) for _ in range(2))
    same_head, same_tail = (np.ones((len(a), len(b)), dtype=bool) for _ in range(2))
    for j in range(n):
        same_head &= a[:, None, j] == b[None, :, j]
        head += same_head
        same_tail &= a[:, None, n - 1 - j] == b[None, :, n - j]
        tail += same_tail
    return head + tail >= n


def matches(data: np.ndarray, asked: np.ndarray, pd: np.ndarray, pq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of asked, rows of data) one edit apart; asked words are of data's
    length or one shorter.  The k-d tree is built and searched in one descent."""
    inserted = data.shape[1] != asked.shape[1]
    near = one_inserted if inserted else one_replaced
    stack = [(np.arange(len(data)), Ball.of(np.arange(len(asked)), not inserted))]
    while stack:
        mine, ball = stack.pop()
        if not len(ball.at) or not len(mine):
            continue
        cutting = split(pd[mine]) if len(mine) > LEAF else None
        if cutting:
            d, t = cutting
            left = pd[mine, d] <= t
            a, b = ball.sides(pq, d, t)
            stack += [(mine[left], a), (mine[~left], b)]
            continue
        for i in range(0, len(mine), BLOCK >> 10):
            some = mine[i:i + (BLOCK >> 10)]
            step = max(1, BLOCK // len(some))
            for k in range(0, len(ball.at), step):
                q, w = np.nonzero(near(asked[ball.at[k:k + step]], data[some]))
                if len(q):
                    yield ball.at[k:k + step][q], some[w]


# -- Spark ----------------------------------------------------------------

def _trees(words: DataFrame) -> dict[int, object]:
    """Length -> the top of its tree.  Two bounded things come to the driver:
    one count per length and the letter counts of about ``SAMPLE`` words."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    buckets = 1 << 24
    share = min(buckets, -(-SAMPLE * buckets // total))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = b.column(0).to_pylist()
            for length, at in by_length(ws).items():
                p = np.minimum(points(codes([ws[i] for i in at], length)), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(at), pa.int32()), pa.array([r.tobytes() for r in p], pa.binary())], ["length", "p"])

    sample = (words.where(F.expr(f"pmod(xxhash64(word), {buckets}) < {share}")).select("word")
              .mapInArrow(counted, "length int, p binary").toArrow())
    lengths = np.asarray(sample.column("length"))
    seen = sample.column("p").to_pylist()
    cell = max(CELL, total / MAX_CELLS) * share / buckets  # in words of the sample
    trees, free = {}, 0
    for length in sorted(sizes):
        rows = [seen[i] for i in np.flatnonzero(lengths == length)]
        p = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), DIMS)
        trees[length], free = grow(p, cell, free)
    return trees


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), each word once -> word, n_near, best struct<n, word>:
    how many words are one edit away, and the one of largest n (ties: the
    smallest in code-point order).  Words without any have no row."""
    trees = _trees(words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, counts = b.column(0), b.column(1)
            texts = ws.to_pylist()
            for length, at in by_length(texts).items():
                p = points(codes([texts[i] for i in at], length))
                home = homes(trees[length], p)
                sent = [(home, np.arange(len(at)))]
                for cell, who in reached(trees[length], p, True):
                    who = who[home[who] < cell]
                    sent.append((np.full(len(who), cell), who))
                if length + 1 in trees:
                    sent += [(np.full(len(who), cell), who) for cell, who in reached(trees[length + 1], p, False)]
                cells = np.concatenate([c for c, _ in sent]).astype(np.int64)
                take = pa.array(at[np.concatenate([w for _, w in sent])])
                own = np.zeros(len(cells), bool)
                own[:len(at)] = True
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(own), ws.take(take), counts.take(take)], ["cell", "own", "word", "n"])

    def search(group: pa.Table) -> pa.Table:
        texts, n = group.column("word").to_pylist(), np.asarray(group.column("n"))
        own = np.asarray(group.column("own"))
        mine = np.flatnonzero(own)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(mine):
            length = len(texts[mine[0]])
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            data = codes([texts[i] for i in mine], length)
            pd = points(data)
            for size, may in ((length, own), (length, ~own), (length - 1, ~own)):
                who = np.flatnonzero(may & (sizes == size))
                if not len(who):
                    continue
                asked = codes([texts[i] for i in who], size)
                if asked.dtype != data.dtype:
                    asked, to = asked.astype(np.uint32), data.astype(np.uint32)
                else:
                    to = data
                for q, w in matches(to, asked, pd, points(asked)):
                    q, w = who[q], mine[w]
                    found.append((q, w))
                    if may is not own:  # both ways; own words meet each other twice anyway
                        found.append((w, q))
        a, b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
        rank = np.empty(len(texts), dtype=np.int64)
        rank[np.array(sorted(range(len(texts)), key=texts.__getitem__), dtype=np.int64)] = np.arange(len(texts))
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        firsts = np.flatnonzero(np.diff(a, prepend=-1))
        who, best = a[firsts], b[firsts]
        return pa.table({"word": [texts[i] for i in who], "n_near": np.diff(np.append(firsts, len(a))),
                         "best_n": n[best], "best_word": [texts[i] for i in best]},
                        schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best_word", pa.string())]))

    dealt = words.select("word", "n").mapInArrow(deal, "cell long, own boolean, word string, n long")
    per_cell = dealt.groupBy("cell").applyInArrow(search, "word string, n_near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    return (per_cell.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form), each word once and without cycles -> word, root: the
    last word of each chain.  Every round doubles the way, so their number is
    the logarithm of the longest chain."""
    r = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        a, b = r.alias("a"), r.alias("b")
        r = cut(a.join(b, F.col("a.root") == F.col("b.word"), "left")
                .select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")))
        if r.where("moved").isEmpty():
            return r.drop("moved")
        r = r.drop("moved")


def variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """words (word, n) -> word, form, root, n, n_near, form_n; one row per word.

    A word's form is its near word of largest n, if that is at least
    ``dominance`` times the word's own; dominance must be above 1, so that
    chains of forms end.  Words must be distinct and not null (rows with a
    null word or n are left out); an empty word is near the words of one code
    point; further columns are ignored; an empty table gives no rows.
    """
    if dominance <= 1:
        raise ValueError("dominance must be above 1")
    words = cut(words.where("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words)
    w, x = words.alias("w"), near.alias("x")
    strong = F.col("x.best.n") >= dominance * F.col("w.n")
    judged = cut(w.join(x, F.col("w.word") == F.col("x.word"), "left").select(
        "w.word", F.when(strong, F.col("x.best.word")).alias("form"), "w.n", F.coalesce("x.n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("x.best.n")).alias("form_n")))
    last = roots(judged.where("form IS NOT NULL"))
    j, r = judged.alias("j"), last.alias("r")
    return j.join(r, F.col("j.word") == F.col("r.word"), "left").select(
        "j.word", "j.form", F.coalesce("r.root", "j.word").alias("root"), "j.n", "j.n_near", "j.form_n")


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """documents (doc_id, text) -> word, n: lower-cased runs of letters, with
    one letter deleted where ``typo`` divides the checksum of id and run.

    Null texts have no words; a null doc_id stands as nothing before the colon.
    Shorter runs cannot give a word, so they are never taken out of the text.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{min_chars},}}"), 0)).alias("run"))
    low = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % typo == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return (low.select("run", h.alias("h")).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where((F.col("n") >= min_count) & (F.length("word") >= min_chars)))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))


# Near words by keys: words that agree but for one place have the same word
# with a gap; a longer word without one of its letters is the shorter one.
ORACLE = f"""
WITH runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
once AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY ALL),
hashed AS (SELECT *, {crc32_sql("id || ':' || run")} AS h FROM once),
v AS MATERIALIZED (SELECT CASE WHEN h % {TYPO} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
  sum(times)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(times) >= {MIN_COUNT} AND length(word) >= {MIN_CHARS}),
gaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT g.word AS long, g.n AS long_n, v.word AS short, v.n AS short_n FROM gaps g JOIN v ON v.word = g.a || g.b),
near AS (SELECT g.word, o.word AS other, o.n AS other_n FROM gaps g JOIN gaps o ON g.i = o.i AND g.a = o.a AND g.b = o.b AND g.word <> o.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {DOMINANCE} * n THEN other END AS form,
  CASE WHEN other_n >= {DOMINANCE} * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
  SELECT word, first(root ORDER BY depth DESC) AS root FROM c GROUP BY word)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word)
"""
