"""Near-duplicate detection: MinHash with banding, signature verification,
confirmation on full shingle sets, and connected components.

1. One pass over the texts gives every document's shingle-set digest, band
   keys and a small signature; documents with equal sets are one class, and one
   representative stands for it from there on.
2. Band keys that several representatives share are buckets (counted with
   map-side partials, so a hot bucket is a few rows per task).  In every bucket
   each member is paired with the smallest only: a star, not all pairs.
3. Pairs pass the signature test and are then confirmed on full sets.
4. Components of the confirmed links join most buckets' members.  Only buckets
   that still hold several components are compared further, block by block of
   bounded size: members of different components, signatures first, full sets
   after, and a block gives only links that join what it held apart.  So every
   pair that shares a bucket is in one component or has been compared, no
   bucket is gathered in one task, and no task emits all pairs.

Universal hashing is a * x + b mod 2^32 over mixed 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components
from .words import NOT_BLANK, mix, shingles, word_hashes

WIDTH = 5               # words of a shingle
SIMILARITY = (75, 100)  # linked if 100 * intersection >= 75 * union
BANDS, ROWS = 45, 5     # a pair at the threshold shares a band but for 5 in a million cases
SKETCH = 128            # bytes of the signature that pairs are tested on
#: A pair is confirmed on full sets if this share of signature bytes agrees:
#: five standard deviations below the threshold.
AGREE = 0.55
BLOCK = 1024            # members of a bucket in one block, and their shingles
BLOCK_SHINGLES = 2_000_000
_RNG = np.random.default_rng(75)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_C = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def minima(x: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set's members."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (_A[:, None] * x[None, i:i + 1024] + _C[:, None]).min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * _MIX).sum(axis=1, dtype=np.uint64) + _SALT).astype(np.int64)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, t) -> (d, n, digest, bands, sketch); a document without words has
    n = 0 and no bands."""
    import hashlib
    for batch in batches:
        n, digest, bands, sketch = [], [], [], []
        for _, words, bounds in word_hashes(batch.column("t"), NOT_BLANK):
            for a, b in zip(bounds[:-1], bounds[1:]):
                x = shingles(words[a:b], WIDTH)
                n.append(len(x))
                digest.append(hashlib.md5(x.tobytes()).digest())
                if len(x):
                    s = minima(x)
                    bands.append(band_keys(s))
                    sketch.append(s[:SKETCH].astype(np.uint8).tobytes())
                else:
                    bands.append(np.zeros(0, np.int64))
                    sketch.append(b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("d"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
             pa.array(sketch, pa.binary())], names=["d", "n", "digest", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, t) -> (d, members): the sorted full set, 48 bits a member."""
    for batch in batches:
        out = []
        for _, words, bounds in word_hashes(batch.column("t"), NOT_BLANK):
            out += [_packed(shingles(words[a:b], WIDTH)) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(out, pa.binary())], names=["d", "members"])


def _packed(x: np.ndarray) -> bytes:
    x = np.unique(x >> np.uint64(16))
    return x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, np.uint32, n).astype(np.uint64) | np.frombuffer(b, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    over, under = SIMILARITY
    if len(x) > len(y):
        x, y = y, x
    if under * len(x) < over * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return under * common >= over * (len(x) + len(y) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) -> (a, b) where the full sets x and y are similar enough."""
    for batch in batches:
        xs, ys = batch.column("x"), batch.column("y")
        keep = [_similar(_unpacked(xs[i].as_py()), _unpacked(ys[i].as_py())) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, p, q) -> (a, b) where the signatures p and q agree enough."""
    for batch in batches:
        p = np.frombuffer(b"".join(batch.column("p").to_pylist()), np.uint8).reshape(-1, SKETCH)
        q = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.uint8).reshape(-1, SKETCH)
        keep = (p == q).sum(axis=1) >= AGREE * SKETCH
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (unit, side, d, comp, sketch, members) sorted by unit -> links
    (a, b) that join components of one unit.  A unit is one block of a bucket
    with itself (side 0) or with another (sides 1 and 2)."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = rows["unit"].iloc[-1] if len(rows) else None
        rest = rows[rows["unit"] == last]
        yield _compare(rows[rows["unit"] != last])
    if rest is not None:
        yield _compare(rest)


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    a, b = [], []
    if len(rows):
        unit, side = rows["unit"].to_numpy(), rows["side"].to_numpy()
        d, comp, members = rows["d"].to_numpy(), rows["comp"].to_numpy().copy(), rows["members"].to_list()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, SKETCH)
        edges = np.flatnonzero(np.diff(unit)) + 1
        for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(rows)]))):
            here = np.arange(lo, hi)
            right = here[side[lo:hi] != 1]
            sets = {}
            for i in here[side[lo:hi] != 2]:
                others = right[comp[right] != comp[i]]
                agree = (sketch[others] == sketch[i]).sum(axis=1)
                close = agree >= AGREE * SKETCH
                for j in others[close][np.argsort(-agree[close], kind="stable")]:
                    if comp[j] == comp[i]:
                        continue  # joined meanwhile
                    for k in (i, j):
                        if k not in sets:
                            sets[k] = _unpacked(members[k])
                    if _similar(sets[i], sets[j]):
                        a.append(d[i])
                        b.append(d[j])
                        same = here[comp[lo:hi] == comp[j]]
                        comp[same] = comp[i]
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _confirmed(pairs: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) -> those whose full sets are similar."""
    p = sketches.select(F.col("d").alias("a"), F.col("sketch").alias("p"))
    q = sketches.select(F.col("d").alias("b"), F.col("sketch").alias("q"))
    close = cut(pairs.join(p, "a").join(q, "b").select("a", "b", "p", "q").mapInArrow(_agreeing, "a long, b long"))
    both = (close.join(sets.select(F.col("d").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("d").alias("b"), F.col("members").alias("y")), "b"))
    return cut(both.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long").distinct())


def _star_pairs(members: DataFrame) -> DataFrame:
    first = members.groupBy("band").agg(F.min("d").alias("first"))
    return (members.join(first, "band").where("d <> first")
            .select(F.col("first").alias("a"), F.col("d").alias("b")).distinct())


def _block_links(members: DataFrame, comps: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components that share a bucket."""
    labelled = members.join(comps, "d", "left").withColumn("comp", F.coalesce("comp", "d"))
    # bands often hold the same members: one bucket of each kind is enough
    mixed = (labelled.join(reps.select("d", "n"), "d").groupBy("band")
             .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"),
                  F.sum(F.xxhash64("d").cast("decimal(38,0)")).alias("who"))
             .where("low <> high").groupBy("m", "who").agg(F.min("band").alias("band"), F.min("n").alias("n")))
    mixed = mixed.select("band", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = labelled.join(mixed, "band")
    mine = F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")
    # block k meets itself and every other block: unit (low, high) of the bucket
    rows = (rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("unit", F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")))
            .withColumn("side", F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2))
            .select("unit", "side", "d", "comp"))
    rows = rows.join(reps.select("d", "sketch"), "d").join(sets, "d")
    units = rows.select("unit", "side", "d", "comp", "sketch", "members").repartition("unit").sortWithinPartitions("unit")
    return units.mapInPandas(_blocks, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (doc_id long, text) -> doc_id, n_shingles, component_id, kept; one
    row per row of the input.

    A document's set is its distinct 5-word shingles, the whole sequence if it
    has fewer words; a text that is null, empty or without words has an empty
    set and is linked with nothing, so it is its own component.  A doc_id names
    one text; repeated rows of it get equal results.  A row with a null doc_id cannot be named:
    it is linked with nothing, its component is null, and it is kept.  Further
    columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id).cast("long").alias("d"), F.col(text).alias("t"))
    rows = cut(narrow.mapInArrow(_summaries, "d long, n long, digest binary, bands array<long>, sketch binary"))
    named = rows.where("d IS NOT NULL AND n > 0")
    classes = cut(named.groupBy("digest").agg(F.min("d").alias("rep")))
    reps = named.join(classes, F.col("d") == F.col("rep"), "left_semi").select("d", "n", "bands", "sketch").distinct()
    bands = reps.select("d", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high").select("band")
    members = cut(bands.join(shared, "band"))
    reps = cut(reps.drop("bands").join(members.select("d").distinct(), "d", "left_semi"))
    sets = cut(narrow.join(reps.select("d"), "d", "left_semi").mapInArrow(_sets, "d long, members binary").distinct())
    links = _confirmed(_star_pairs(members), sets, reps)
    comps = components(links)
    more = cut(_block_links(members, comps, reps, sets))
    if not more.isEmpty():
        comps = components(links.union(more))
    return (rows.join(classes, "digest", "left")
            .join(comps.select(F.col("d").alias("rep"), "comp"), "rep", "left")
            .select(F.col("d").alias(id), F.col("n").alias("n_shingles"),
                    F.when(F.col("d").isNull() | (F.col("n") == 0), F.col("d")).otherwise(F.coalesce("comp", "rep")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: the one that names the
    component, once if its id and text are repeated.  Different texts of one id
    are different documents.  Rows with a null id, and texts without words of
    different ids, stay."""
    repeated = cut(docs.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).count().where("count > 1").select("_id"))
    if repeated.isEmpty():
        return _kept(docs, id, text)
    # every text of an id gets a number of its own, in the order of the ids
    whole = F.coalesce(F.sha2(F.col(text), 256), F.lit(""))
    numbers = cut(docs.where(F.col(id).isNotNull()).select(F.col(id).alias("_id"), whole.alias("_sha")).distinct()
                  .orderBy("_id", "_sha").withColumn("_number", F.monotonically_increasing_id()))
    named = docs.join(numbers, (docs[id] == F.col("_id")) & (whole == F.col("_sha")), "left").select(*docs.columns, "_number")
    rest = _kept(named, "_number", text)
    several = rest[id] == F.col("_id")
    return (rest.join(repeated, several, "left_anti").union(rest.join(repeated, several, "left_semi").dropDuplicates(["_number"]))
            .drop("_number"))


def _kept(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The rows whose id names a component, where an id names one text."""
    found = cut(near_duplicates(docs, id, text).select(F.col(id).alias("_dropped"), "kept"))
    dropped = found.where(~F.col("kept")).select("_dropped").distinct()
    return docs.join(dropped, docs[id] == F.col("_dropped"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS u, a AS v FROM e UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v),
m AS (SELECT u, min(v) AS comp FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp, d.doc_id) AS component_id, coalesce(comp, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON u = d.doc_id
"""
