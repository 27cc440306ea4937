"""Hashing of words and what depends on it: equal hashes never make equal texts."""

import numpy as np
import pytest
import tiktoken

from newsweave.llm import neardup, packing, words


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_word_hash_has_no_linear_collisions():
    """Thue-Morse words and their complements collide under any polynomial
    modulo a power of two."""
    for n in (1024, 2048, 4096, 1 << 16):
        for letters in ("ab", "xq", "09"):
            a, b = thue_morse(n, letters).encode(), thue_morse(n, letters[::-1]).encode()
            buf = np.frombuffer(b"  " + a + b" " + b, np.uint8)
            h = words.hashes(buf, np.array([2, 3 + n]), np.array([2 + n, 3 + 2 * n]))
            assert h[0] != h[1]


def test_word_hash_depends_on_the_bytes_alone():
    rng = np.random.default_rng(4)
    some = sorted({bytes(rng.integers(97, 100, rng.integers(1, 30)).astype(np.uint8)) for _ in range(3000)})
    seen = {}
    for before in (b"", b"zz ", b"1234567"):
        buf = np.frombuffer(before + b" ".join(some), np.uint8)
        sizes = np.array([len(x) for x in some])
        starts = len(before) + np.cumsum(sizes + 1) - sizes - 1
        h = words.hashes(buf, starts, starts + sizes)
        assert len(set(h.tolist())) == len(some)
        seen.setdefault("h", h)
        assert (seen["h"] == h).all()


def test_packing_survives_equal_hashes(spark, monkeypatch):
    """Whatever the hash, a chunk counts as seen only if its bytes are equal."""
    t = packing.Tokenizer(packing.read_ranks())
    encoding = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=packing.read_ranks(), special_tokens={})
    texts = ["one two three", thue_morse(4096), thue_morse(4096, "ba"), "two one", " x " * 50, "three four fünf"]
    bounds = lambda rows: (np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0] + [len(r.encode()) for r in rows]))
    for weak in (lambda buf, a, b: (b - a).astype(np.uint64), lambda buf, a, b: np.zeros(len(a), np.uint64), lambda buf, a, b: buf[a].astype(np.uint64)):
        monkeypatch.setattr(packing, "hashes", weak)
        for rows in (texts, texts[::-1], texts[:1], texts[3:], ["solo"], ["sola"], ["solo"]):
            ids, at = t.encode(*bounds(rows))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encoding.encode_ordinary(r) for r in rows]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_colliding_texts_stay_apart(spark, n):
    docs = spark.createDataFrame([(1, thue_morse(n)), (2, thue_morse(n, "ba")), (3, thue_morse(n))], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}
    rows = packing.unpack(packing.pack(docs.coalesce(1)), packing.LENGTH).collect()
    encoding = tiktoken.Encoding("plain", pat_str=packing.PATTERN, mergeable_ranks=packing.read_ranks(), special_tokens={})
    for i, text in ((1, thue_morse(n)), (2, thue_morse(n, "ba")), (3, thue_morse(n))):
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert encoding.decode(ids) == text
