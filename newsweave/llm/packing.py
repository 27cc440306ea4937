"""Token ids packed into fixed-length rows, best fit decreasing.

Texts become ids with a public byte-level BPE vocabulary (its path is a
parameter; the driver reads it once and broadcasts the ranks, whose number is
checked).  Documents longer than a row are split losslessly into pieces.  The
pieces of a block, longest first, go each into the row with the least room
that still holds it; a segment tree over capacities finds that row in
O(log length).

A block is a run of documents of one input partition of about ``BLOCK_TOKENS``
ids, so packing needs no shuffle, its memory is bounded, and a lost task is
packed again alike from the same partition.

A packed row holds the ids and positions as little-endian binary, and the
cumulative segment lengths, from which ids, positions and documents can be
restored exactly (``unpack``).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import buffers, hashes, same_bytes, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits a text before the merges of
# this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_RANKS = 1_000_000     # a vocabulary beyond this is refused, not broadcast
LENGTH = 2048             # ids of a packed row
BLOCK_TOKENS = 4_000_000  # ids packed together
CACHED_WORDS = 1_000_000   # a task's word -> ids cache, emptied when full


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path} has {len(ranks)} entries, more than {MAX_RANKS}")
    return ranks


class Tokenizer:
    """Byte-level BPE that encodes each distinct chunk of a buffer once.

    A text may be cut before any single blank that a visible character
    follows: every alternative of the pattern starts there anew.  Chunks are
    found and hashed in bulk; only those not seen yet are encoded.  A hash only
    finds a chunk: its bytes are compared before it counts as the same.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.token_bytes[list(ranks.values())] = [len(t) for t in ranks]
        self._clear()

    def _clear(self) -> None:
        self.seen = np.zeros(0, np.uint64)   # sorted hashes of chunks
        self.place = np.zeros(0, np.int64)   # their index in bounds
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.kept = np.zeros(0, np.uint8)    # the chunks' own bytes, by place
        self.kept_at = np.zeros(1, np.int64)

    def _learn(self, new: np.ndarray, chunks: list[bytes]) -> None:
        # chunks that begin at a cut are encoded in one call: no token crosses a
        # cut, so the tokens' byte lengths tell where each chunk ends
        joined = np.fromiter((len(c) > 1 and c[0] == 32 and _VISIBLE[c[1]] for c in chunks), bool, len(chunks))
        alone = [self._ids(chunks[k]) for k in np.flatnonzero(~joined)]
        together = [chunks[k] for k in np.flatnonzero(joined)]
        ids = self._ids(b"".join(together))
        ends = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1 if len(together) else ends
        sizes = np.zeros(len(chunks), np.int64)
        sizes[joined] = np.diff(ends, prepend=0)
        sizes[~joined] = [len(x) for x in alone]
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        self.ids = np.concatenate([self.ids, ids, *alone])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes[order])])
        places = np.empty(len(chunks), np.int64)
        places[order] = np.arange(len(chunks)) + len(self.place)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))[order]
        self.kept = np.concatenate([self.kept, np.frombuffer(b"".join(chunks[k] for k in order), np.uint8)])
        self.kept_at = np.concatenate([self.kept_at, self.kept_at[-1] + np.cumsum(lengths)])
        seen, place = np.concatenate([self.seen, new]), np.concatenate([self.place, places])
        merged = np.argsort(seen, kind="stable")
        self.seen, self.place = seen[merged], place[merged]

    def _ids(self, chunk: bytes) -> np.ndarray:
        return self.encoding.encode_to_numpy(chunk.decode()).astype(np.int32) if chunk else np.zeros(0, np.int32)

    def _found(self, uniq: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands among those seen, and whether its chunk is
        known.  A known hash of other bytes empties the cache."""
        at = np.searchsorted(self.seen, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.seen)
        known[inside] = self.seen[at[inside]] == uniq[inside]
        place = self.place[at[known]]
        kept, size = self.kept_at[place], self.kept_at[place + 1] - self.kept_at[place]
        if (size == sizes[known]).all() and same_bytes(buf, starts[known], self.kept, kept, size).all():
            return at, known
        self._clear()
        return np.zeros(len(uniq), np.int64), np.zeros(len(uniq), bool)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and each text's bounds in it."""
        n = len(buf)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n, bool)
        cut[:-1] = (buf[:-1] == 32) & _VISIBLE[buf[1:]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        sizes = ends - starts
        uniq, first, which = np.unique(hashes(buf, starts, ends), return_index=True, return_inverse=True)
        shared = (sizes == sizes[first][which]).all() and same_bytes(buf, starts, buf, starts[first][which], sizes).all()
        if not shared:  # two chunks of one hash: these texts are told apart by the chunks themselves
            raw = buf.tobytes()
            numbers: dict[bytes, int] = {}
            which = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts, ends)), np.int64, len(starts))
            first = np.unique(which, return_index=True)[1]
            uniq = np.arange(len(numbers), dtype=np.uint64)
        if len(self.seen) > CACHED_WORDS or not shared:
            self._clear()
        at, known = self._found(uniq, buf, starts[first], sizes[first])
        if not known.all():
            raw = buf.tobytes()
            missing = np.flatnonzero(~known)
            self._learn(uniq[missing], [raw[starts[first[m]]:ends[first[m]]] for m in missing])
            at = np.searchsorted(self.seen, uniq)
        place = self.place[at][which]
        lo, sizes = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        after = np.cumsum(sizes)
        total = int(after[-1])
        ids = self.ids[np.repeat(lo - (after - sizes), sizes) + np.arange(total)]
        if not shared:
            self._clear()
        return ids, np.concatenate(([0], after))[np.searchsorted(starts, offsets)]


#: Bytes that surely start a visible character: printable ASCII, and lead bytes
#: of blocks that hold no white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = _VISIBLE[0xC3:0xE1] = _VISIBLE[0xE4:0xF5] = True


class Bins:
    """Open rows by remaining room: a segment tree over capacities."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()  # a power of two above length
        self.tree = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i and not self.tree[i]:
            self.tree[i] = True
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least ``need``."""
        i, tree = need + self.size, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1  # up, until a right neighbour has a row
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            while i and not (tree[2 * i] or tree[2 * i + 1] if i < self.size else False):
                tree[i] = False
                i >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Pieces' numbers by row; every size is between 1 and ``length``."""
    rows: list[list[int]] = []
    open_rows = Bins(length)
    for k in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[k])
        found = open_rows.take(need)
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > need:
            open_rows.add(room - need, row)
    return rows


_SCHEMA = pa.schema([("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
                     ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())),
                     ("doc_tokens", pa.list_(pa.int32()))])
_DDL = ("pack_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, "
        "doc_starts array<int>, doc_tokens array<int>")


def _pack(ids: np.ndarray, bounds: np.ndarray, docs: list[int | None], first: int, length: int, pad: int, kind: str) -> pa.RecordBatch:
    """One block: document k has the ids bounds[k]:bounds[k + 1]."""
    tokens = np.diff(bounds)
    pieces = -(-tokens // length)                       # per document, 0 without ids
    doc = np.repeat(np.arange(len(tokens)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = nth * length                                # place of the piece in its document
    size = np.minimum(tokens[doc] - start, length)
    rows = best_fit_decreasing(size, length)
    counted = np.arange(length)
    out: dict[str, list] = {n: [] for n in _SCHEMA.names}
    for r, row in enumerate(rows):
        row_ids, places = np.full(length, pad, kind), np.zeros(length, kind)
        cu = [0]
        for k in row:
            a, n = cu[-1], int(size[k])
            lo = int(bounds[doc[k]] + start[k])
            row_ids[a:a + n] = ids[lo:lo + n]
            places[a:a + n] = counted[:n]
            cu.append(a + n)
        for name, value in zip(_SCHEMA.names, (first + r, cu[-1], row_ids.tobytes(), places.tobytes(), cu, [docs[doc[k]] for k in row],
                                               start[row].tolist(), tokens[doc[row]].tolist())):
            out[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in _SCHEMA], schema=_SCHEMA)


def _packer(ranks: Broadcast, length: int, pad: int, kind: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        context = TaskContext.get()
        next_row = (context.partitionId() if context else 0) << 33
        tokenizer = Tokenizer(ranks.value)
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs: list[int | None] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_row, count
            out = _pack(np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), docs.copy(), next_row, length, pad, kind)
            next_row += out.num_rows
            held.clear(), sizes.clear(), docs.clear()
            count = 0
            return out

        for batch in batches:
            buf, offsets = buffers(batch.column("t"))
            names = batch.column("d").to_pylist()
            for i, j in slices(offsets):
                ids, bounds = tokenizer.encode(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                held.append(ids)
                sizes.append(np.diff(bounds))
                docs.extend(names[i:j])
                count += len(ids)
                if count >= block:
                    for part in _small(flush()):
                        yield part
        if count:
            for part in _small(flush()):
                yield part
    return run


def _small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def pack(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> packed rows: pack_id, n_tokens, input_ids,
    position_ids, cu_seqlens, doc_ids, doc_starts, doc_tokens.

    Ids and positions are little-endian, two bytes each if the vocabulary and
    the length allow, else four; the padding id is the first free one and
    stands behind ``n_tokens``.  Segment k of a row is cu_seqlens[k] to
    cu_seqlens[k + 1], from token doc_starts[k] of document doc_ids[k], which
    has doc_tokens[k] ids in all; positions start at 0 in every segment.

    A null or empty text has no ids and is in no row.  Repeated rows are packed
    each; a null doc_id is kept as null; further columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ranks = read_ranks(path)
    pad = max(ranks.values()) + 1
    kind = "<u2" if max(pad, length - 1) < 1 << 16 else "<u4"
    run = _packer(spark.sparkContext.broadcast(ranks), length, pad, kind, block_tokens)
    narrow = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("t"))
    return narrow.mapInArrow(run, _DDL)


def unpack(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packed rows -> (doc_id, start, ids array<int>): every segment again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = f"<u{len(r['input_ids']) // length}"
                ids = np.frombuffer(r["input_ids"], kind)
                cu = r["cu_seqlens"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["doc_starts"], pa.int32()),
                    pa.array([ids[a:b].astype(np.int32) for a, b in zip(cu, cu[1:])], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])
    return packed.mapInArrow(run, "doc_id long, start int, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
