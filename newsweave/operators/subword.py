"""Sub-word ids and masks with the vocabulary of a public byte-level BPE (M5).

The vocabulary is a file of the user's (base64 token and rank a line, as
published); nothing is trained here.  Spark reads it, its size is checked, and
it travels to the tasks once.  Texts are cut into pieces by the vocabulary's
pattern in the JVM; a row needs at most as many pieces as it has ids, so only
those leave it.  Each Arrow batch is dictionary-encoded: every distinct piece
of a batch is merged once (and remembered by its worker), ids come back through
the dictionary's codes, and no row is shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import END_ID, FIRST_WORD_ID, MAX_LEN, PAD_ID, PIECES, START_ID

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

MAX_TOKENS = 1_000_000  # a vocabulary beyond this is refused
REMEMBERED = 200_000    # pieces a worker remembers, of at most PIECE_BYTES each
PIECE_BYTES = 64


def read_vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """(token, rank) lines -> token bytes -> rank.  Every byte must be a token,
    so that every text can be encoded."""
    lines = spark.read.text(path).where("length(value) > 0")
    rows = lines.select(F.unbase64(F.split("value", " ")[0]).alias("token"), F.split("value", " ")[1].cast("int").alias("rank"))
    if (n := rows.count()) > MAX_TOKENS:
        raise ValueError(f"{path} has {n} tokens, more than {MAX_TOKENS}")
    ranks = {bytes(r.token): r["rank"] for r in rows.collect()}
    if len(ranks) != n or len(set(ranks.values())) != n or any(v is None for v in ranks.values()):
        raise ValueError(f"{path}: tokens and ranks must be different and not null")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: a byte is no token")
    return ranks


def pieces(text: Column) -> Column:
    """The text in the pieces that merges never cross, blanks before words
    included; together they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECES), 0)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a piece's tokens: the neighbours whose union ranks first are
    joined until none is a token.  A heap holds the candidate pairs, so a very
    long piece costs n log n."""
    from heapq import heapify, heappop, heappush
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))    # where the token that starts here ends
    left = list(range(-1, n - 1))  # start of the token before it
    live = [True] * n

    def pair(i: int) -> tuple[int, int, int, int] | None:
        if end[i] >= n:
            return None
        stop = end[end[i]]
        rank = ranks.get(piece[i:stop])
        return None if rank is None else (rank, i, end[i], stop)

    heap = [p for p in map(pair, range(n)) if p]
    heapify(heap)
    while heap:
        _, i, middle, stop = heappop(heap)
        if not (live[i] and end[i] == middle and middle < n and live[middle] and end[middle] == stop):
            continue  # one of the two was joined meanwhile
        live[middle], end[i] = False, stop
        if stop < n:
            left[stop] = i
        for j in (left[i], i):
            if j >= 0 and (p := pair(j)):
                heappush(heap, p)
    return [ranks[piece[i:end[i]]] for i in range(n) if live[i]]


def _encoder(ranks, max_ids: int):
    """(key, pieces) -> (key, ids): at most ``max_ids`` ids a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("pieces")
            flat = lists.flatten().dictionary_encode()
            ids = []
            for piece in flat.dictionary.to_pylist():
                found = known.get(piece)
                if found is None:
                    found = np.array(merge(piece.encode(), ranks.value), np.int32)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(piece) <= PIECE_BYTES:
                        known[piece] = found
                ids.append(found)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
            every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = bounds[codes + 1] - bounds[codes] if len(codes) else np.zeros(0, np.int64)
            after = np.cumsum(sizes)
            out = every[np.repeat(bounds[codes] - (after - sizes), sizes) + np.arange(int(sizes.sum()))] if len(codes) else every
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            edges = np.concatenate(([0], after))[np.concatenate(([0], np.cumsum(counts)))]
            rows = [out[a:min(b, a + max_ids)] for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.list_(pa.int32()))], names=["key", "ids"])
    return run


def encode_subwords(df: DataFrame, ranks: dict[bytes, int], col: str = "combined_text", key: str = "row_id",
                    max_len: int = MAX_LEN) -> DataFrame:
    """(key, input_word_ids, input_mask), both ``max_len`` long: start, the
    text's first ids, end, pads.

    An id is the token's rank behind the special ids.  A null text is an empty
    one; repeated keys are rows of their own.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    narrow = df.select(F.col(key).alias("key"), F.slice(pieces(F.coalesce(F.col(col), F.lit(""))), 1, max_len - 2).alias("pieces"))
    ids = narrow.mapInArrow(_encoder(shared, max_len - 2), f"key {kind}, ids array<int>").withColumn(
        "ids", F.transform("ids", lambda x: x + FIRST_WORD_ID))
    real = F.size("ids") + 2
    return ids.select(
        F.col("key").alias(key),
        F.concat(F.array(F.lit(START_ID)), F.col("ids"), F.array(F.lit(END_ID)), F.array_repeat(F.lit(PAD_ID), max_len - real)).alias("input_word_ids"),
        F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), max_len - real)).alias("input_mask"))


def decode_subwords(df: DataFrame, ranks: dict[bytes, int], ids: str = "input_word_ids", out: str = "text") -> DataFrame:
    """Ids back to text: special ids are left out; a character that the length
    limit cut is replaced."""
    tokens = df.sparkSession.sparkContext.broadcast({r + FIRST_WORD_ID: t for t, r in ranks.items()})
    columns = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if row is None else b"".join(tokens.value.get(i, b"") for i in row).decode(errors="replace")
                     for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(texts, pa.string())], names=[*columns, out])
    return df.select(*columns).mapInArrow(run, f"{schema}, `{out}` string")
