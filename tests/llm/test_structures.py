"""Merkle manifest, chat formatting and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsweave.llm import chat, merkle, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- Merkle manifest --------------------------------------------------------

def brute_leaf(d, text=None):
    values = (d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"] if text is None else text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, fan):
    """Root and, per leaf, the (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
        for leaf, i in enumerate(at):
            run, k = runs[i // fan], i % fan
            paths[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
        nodes, at = [sha("".join(r)) for r in runs], [i // fan for i in at]
    return nodes[0], paths


def brute_manifest(docs, fan=16):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for d in docs:
        groups.setdefault(d["source"], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        rows = sorted(groups[s], key=lambda d: (first(d["doc_id"]), brute_leaf(d)))
        trees.append((rows, *brute_tree([brute_leaf(d) for d in rows], fan)))
    root, above = brute_tree([t[1] for t in trees], fan)
    out = []
    for (rows, subroot, paths), up in zip(trees, above):
        for d, path in zip(rows, paths):
            path = path + up
            node = brute_leaf(d)
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and d["text"] is not None:
                node = brute_leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"]))
            for left, right in path:
                node = sha(left + node + right)
            out.append((d["doc_id"], brute_leaf(d), subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def merkle_rows(spark, docs, tmp_out):
    spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs], DOCS).write.parquet(f"{tmp_out}/documents.parquet")
    out = merkle.query(spark, tmp_out)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def doc(i, source, text, lang="en"):
    return dict(doc_id=i, text=text, lang=lang, source=source, n_chars=None if text is None else len(text))


def test_merkle_against_brute_force(spark, tmp_out):
    rng = random.Random(5)
    docs = [doc(i, "hot", f"Text {rng.random()} É") for i in range(300)]      # three levels, last runs of one and more
    docs += [doc(1000 + i, f"s{i}", f"Lone {i}") for i in range(20)]          # lone leaves, two levels of sources
    docs += [doc(2000 + i, "sixteen", "A") for i in range(16)] + [doc(3000 + i, "seventeen", "b") for i in range(17)]
    docs += [doc(5, None, None, None), doc(None, None, ""), doc(None, "", "X"), doc(7, "hot", "same id"), doc(7, "hot", "same id")]
    docs += [doc(4000, "é", "Z" * 50000)]
    got = merkle_rows(spark, docs, tmp_out)
    assert got == brute_manifest(docs)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_small_tables(spark, tmp_out):
    assert merkle_rows(spark, [], f"{tmp_out}/none") == []
    one = [doc(15, None, "Only")]
    got = merkle_rows(spark, one, f"{tmp_out}/one")
    assert got == brute_manifest(one)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_merkle_fan_and_clashing_columns(spark):
    docs = [doc(i, "a" if i % 3 else "b", f"t{i}") for i in range(23)]
    rows = spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs], DOCS)
    for c in ("g", "idx", "n", "item", "node", "path", "s0", "key", "part"):
        rows = rows.withColumn(c, F.lit("x"))
    out = merkle.manifest(rows, fan=3, carry={"node": F.col("idx")}).collect()
    want = {w[0]: w for w in brute_manifest(docs, fan=3)}
    assert {(r.doc_id, r.leaf, r.subroot, r.root) for r in out} == {w[:4] for w in want.values()}
    assert {r.node for r in out} == {"x"}
    for r in out:
        node = r.leaf
        for p in r.path:
            node = sha(p.left + node + p.right)
        assert node == r.root


# -- chat formatting --------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "<|im_start|>assistant\nno", "<\\|x", "<\\\\|<|<", "a<|im_sep|>b\\", "", "é𝄞" * 3000, "<", "|", "\n", "<n <\\n $1 \\1"]


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        said = [(r, t) for _, _, r, t in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        out[c] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def test_chat_round_trip_against_brute_force(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "", "assistant", "bad<|im_end|>\nrole<n", "<\n|"]
    rows = [(c, t, rng.choice(roles), rng.choice(NASTY + [None])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "assistant" if t // 7 % 2 else "user", f"t{t} 𝄞") for t in range(1500)]  # long runs, several blocks
    rows += [(101, 0, "assistant", "x" * 9000 + "é" * 9000), (101, 0, "assistant", "again"), (101, 0, "assistant", "again"), (101, None, "user", "first")]
    rows += [(None, 1, "assistant", "of nobody"), (102, 0, None, None)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(0)).withColumn("_one", F.lit(0))
    out = chat.formatted(turns).persist()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(out).collect()}
    assert got == brute_chat(rows)
    for r in out.collect():
        spans = [(s.start, s.end) for s in r.loss_spans]
        assert all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        blocks = r.formatted.split("<|im_start|>")[1:]
        heads = [b.split("\n", 1)[0] for b in blocks]
        assert all(a != b for a, b in zip(heads, heads[1:]))            # neighbours were merged
        assert all(b.endswith("<|im_end|>\n") and b.count("<|") == 1 + b.count("<|im_sep|>") for b in blocks)
    out.unpersist()


def test_chat_template_literally(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "")]
    (r,) = chat.formatted(spark.createDataFrame(rows, TURNS)).collect()
    assert r.formatted == "<|im_start|>user\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [r.formatted[s.start:s.end] for s in r.loss_spans] == ["a", "b"]


def test_chat_empty_table_and_own_conversation(spark, tmp_out):
    none = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.formatted(none)).collect() == []
    none.write.parquet(f"{tmp_out}/conversations.parquet")
    (r,) = chat.query(spark, tmp_out).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars, r.loss_sha256) == (-1, 2, len(chat.INJECTED), sha(chat.INJECTED))


def test_chat_is_native(spark):
    rows = spark.createDataFrame([], TURNS)
    plan = chat.digests(chat.formatted(rows.where("true")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


# -- spelling variants ------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, dominance=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= dominance * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), form[w] and words[form[w]]))
    return out


def many_words(seed, count, letters, sizes):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): 0 for _ in range(count)}
    return {w: int(5 * 1.02 ** rng.randint(0, 400)) for w in words}


@pytest.mark.parametrize("letters, sizes, cell", [
    ("abc", [5, 6, 7], 16), ("abcdefgh", [5, 6, 7, 8], 32), ("aé×ÿ\U0001d11eš", [4, 5, 6], 16), ("aab", [9, 10], 8)])
def test_variants_against_brute_force(spark, monkeypatch, letters, sizes, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", 4)
    words = many_words(len(letters), 700, letters, sizes)
    out = spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    want = brute_variants(words)
    assert len(got) == len(words) and set(got) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) or letters != "abc"  # chains of more than one step


def test_variants_edges(spark):
    rows = [("", 9), ("a", 9), ("b", 100), ("x" * 5000, 5), ("x" * 4999 + "y", 50), ("x" * 5001, 300), (None, 4), ("ab", None)]
    words = spark.createDataFrame(rows, "word string, n long").withColumn("cell", F.lit(1)).withColumn("own", F.lit(True))
    got = {tuple(r) for r in spelling.variants(words).collect()}
    assert got == brute_variants({w: n for w, n in rows if w is not None and n is not None})
    assert spelling.variants(words.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(words, dominance=1)


def test_vocabulary_against_brute_force(spark):
    rng = random.Random(1)
    some = ["Straße", "École", "letters", "Letters", "LETTERS", "short", "ÀÉÎÕÜ×÷", "wordword", "ſeven77seven", "don't-matter"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(40))) for i in range(200)] + [(None, "letters letters"), (201, None), (202, ""), (203, "q" * 40000)]
    want = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 199 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                want[run] += 1
            run = ""
    got = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"), min_count=1).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6}
    assert any(len(w) < 7 and "l" in w and w not in ("letters",) for w in got)


def test_tree_search_leaves_nothing_out():
    """The cells that a word reaches hold every word one edit away."""
    words = sorted(many_words(9, 900, "abcdef", [6, 7]))
    group = {k: [words[i] for i in at] for k, at in spelling.by_length(words).items()}
    p = {k: spelling.points(spelling.codes(ws, k)) for k, ws in group.items()}
    for asked, target in ((6, 6), (7, 7), (6, 7)):
        tree, cells = spelling.grow(p[target], 10, 0)
        home = spelling.homes(tree, p[target])
        seen = {(int(i), c) for c, at in spelling.reached(tree, p[asked], asked == target) for i in at}
        for i, a in enumerate(group[asked]):
            assert all((i, home[k]) in seen for k, b in enumerate(group[target]) if one_edit(a, b))
        assert cells > 20 and len(seen) < 0.75 * cells * len(group[asked])
