"""Merkle manifest of a dataset: one digest per row, group and table.

A row's leaf is the digest of its columns.  The leaves of a group, in the order
of their key, are the bottom of a tree whose nodes are the digests of ``fan``
consecutive children; the groups' roots are the bottom of one more tree, whose
root names the whole table.  With the digests of its siblings a row can be
proved to be in the table without any other row.

Both trees are built by a slot pivot: conditional aggregates spread the
children of each parent into ``fan`` columns, whose concatenation is hashed;
all columns but a child's own are its siblings.  Going down again, a parent's
row is exploded into its children with what stands left and right of each, so
the siblings are never joined to one another.

Places in a group come from one range partitioning of narrow rows (group, key,
leaf): a group with any share of the rows is spread over all partitions, and
one row per (partition, group) is gathered for the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5  # the query tampers with rows whose checksum this divides


def field(c: Column) -> Column:
    """A value as hashed: ``-`` for null, else its UTF-8 length, ``:`` and itself."""
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def placed(rows: DataFrame) -> DataFrame:
    """rows (g, key, item<node, ...>) -> g, item, idx, n: the place in the
    group by (key, node) from 0, nulls first, and the group's size.  Rows equal
    in both have equal leaves, so any order of them is the same tree."""
    order = [F.col("g").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("item.node")]
    at = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
          .withColumn("at", F.monotonically_increasing_id()))
    at = cut(at.select("g", "item", "at", F.shiftright("at", 33).alias("part")))
    group = Window.partitionBy("g")
    firsts = (at.groupBy("part", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
              .withColumn("before", F.coalesce(F.sum("rows").over(
                  group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("n", F.sum("rows").over(group)))
    a, f = at.alias("a"), firsts.alias("f")
    return (a.join(f, (F.col("a.part") == F.col("f.part")) & F.col("a.g").eqNullSafe(F.col("f.g")))
            .select("a.g", "a.item", (F.col("a.at") - F.col("f.first") + F.col("f.before")).alias("idx"), "f.n"))


def pivot(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """nodes (g, idx, n, item) -> their parents: g, idx, n (of the children),
    s0 ... s{fan-1}, the children by slot.  The only node of a group is kept in
    slot 0 of a row of its own."""
    return (nodes.groupBy("g", F.expr(f"idx div {fan}").alias("parent"))
            .agg(F.max("n").alias("n"), *[F.expr(f"max(CASE WHEN idx % {fan} = {k} THEN item END)").alias(f"s{k}") for k in range(fan)])
            .withColumnRenamed("parent", "idx"))


def _joined(slots: Sequence[int]) -> str:
    return f"concat_ws('', {', '.join(f's{k}.node' for k in slots)})" if slots else "''"


def climb(nodes: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """nodes (g, idx, n, item) -> the pivots of all levels, lowest first, and
    (g, node), the root of each group.  A level holds 1/fan of the rows of the
    level below; the number of levels comes from the largest group."""
    levels: list[DataFrame] = []
    widest = None
    while widest is None or widest > 1:
        levels.append(cut(pivot(nodes, fan)))
        widest = -(-(widest or levels[0].agg(F.max("n")).first()[0] or 1) // fan)
        digest = F.when(F.col("n") == 1, F.col("s0.node")).otherwise(F.expr(f"sha2({_joined(range(fan))}, 256)"))
        nodes = levels[-1].select("g", "idx", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.struct(digest.alias("node")).alias("item"))
    return levels, nodes.select("g", F.col("item.node").alias("node"))


def descend(levels: Sequence[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """Pivots and (g, path, *carried of the group) -> g, idx, item, path, and
    the group's carried columns: each lowest node with its siblings (left,
    right) level by level, followed by its group's path."""
    carried = [c for c in tops.columns if c not in ("g", "path")]
    p = tops.withColumn("idx", F.lit(0).cast("long"))
    for t in reversed(levels):
        a, b = t.alias("a"), p.alias("b")
        rows = (a.join(b, F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.idx") == F.col("b.idx")))
                .select("a.*", "b.path", *[f"b.{c}" for c in carried]))
        child = [f"named_struct('k', {k}, 'item', s{k}, 'left', {_joined(range(k))}, 'right', {_joined(range(k + 1, fan))})"
                 for k in range(fan)]
        rows = rows.select("g", "idx", "n", "path", *carried,
                           F.expr(f"explode(filter(array({', '.join(child)}), x -> x.item IS NOT NULL))").alias("c"))
        step = F.when(F.col("n") == 1, F.expr("array()").cast("array<struct<left:string,right:string>>")).otherwise(
            F.array(F.struct(F.col("c.left").alias("left"), F.col("c.right").alias("right"))))
        p = rows.select("g", (F.col("idx") * fan + F.col("c.k")).alias("idx"), F.col("c.item").alias("item"),
                        F.concat(step, F.col("path")).alias("path"), *carried)
        if t is not levels[0]:
            p = p.drop("item")
    return p


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", key: str = "doc_id",
             carry: Mapping[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """docs -> key, group, leaf, subroot, root, path and the ``carry`` columns;
    one row per row.

    ``path`` is array<struct<left, right>>: the digests beside the row's node
    on each level, up through its group's root to the root.  ``carry`` names
    narrow columns that travel with the leaf.  Null values are hashed as such;
    a null group is a group of its own, before all others; null keys come
    first; rows of one key stand by their leaves.  A lone leaf is its group's
    root, a lone group's root is the root.  Columns beyond ``columns`` are not
    hashed and never clash.  An empty table gives no rows.
    """
    carry = dict(carry or {})
    item = F.struct(leaf_digest([F.col(f"`{c}`") for c in columns]).alias("node"), F.col(f"`{key}`").alias("key"),
                    *[c.alias(f"c_{name}") for name, c in carry.items()])
    rows = cut(docs.select(F.col(f"`{group}`").alias("g"), F.col(f"`{key}`").alias("key"), item.alias("item")))
    levels, subroots = climb(placed(rows), fan)
    top = subroots.select(F.lit(0).alias("g"), F.col("g").alias("key"),
                          F.struct("node", F.col("g").alias("group")).alias("item"))
    top_levels, root = climb(placed(top), fan)
    none = F.expr("array()").cast("array<struct<left:string,right:string>>")
    above = descend(top_levels, root.select("g", none.alias("path"), F.col("node").alias("root")), fan)
    tops = above.select(F.col("item.group").alias("g"), "path", "root", F.col("item.node").alias("subroot"))
    out = descend(levels, tops, fan)
    return out.select(F.col("item.key").alias(key), F.col("g").alias(group), F.col("item.node").alias("leaf"),
                      "subroot", "root", "path", *[F.col(f"item.c_{name}").alias(name) for name in carry])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    changed = leaf_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    rows = manifest(docs, carry={"tampered": F.when(hit, changed)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return (rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def crc32_sql(value: str) -> str:
    """DuckDB expression: unsigned CRC-32 of a string's UTF-8 bytes."""
    rows = []
    for i in range(256):  # the table by its rule: eight steps of the reflected polynomial
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        rows.append(str(i))
    digits = f"hex(encode({value}))"
    each = f"list_transform(range(1, length({digits}) + 1, 2), lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)"
    return (f"xor(list_reduce({each}, lambda a, b: xor(a >> 8, ([{','.join(rows)}])[(xor(a, b) & 255) + 1]), "
            f"4294967295::BIGINT), 4294967295::BIGINT)")


_SQL_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END" for c in COLUMNS)
_SQL_LEVELS = 7  # enough for 16^7 rows of one source


def _sql_tree(name: str, base: str, group: str) -> str:
    """CTEs <name>0 ... of a tree: nodes of each level with what stands left
    and right of them in their run."""
    side = (f"coalesce(string_agg(h, '') OVER (PARTITION BY {group}, idx // {FAN} ORDER BY idx "
            "ROWS BETWEEN {} AND {}), '')")
    shown = f"{side.format('UNBOUNDED PRECEDING', '1 PRECEDING')} AS l, {side.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS r"
    out = [f"{name}0 AS MATERIALIZED (SELECT *, {shown} FROM ({base}))"]
    for k in range(1, _SQL_LEVELS + 1):
        out.append(f"{name}{k} AS MATERIALIZED (SELECT *, {shown} FROM (SELECT {group}, idx // {FAN} AS idx, (any_value(n) + {FAN - 1}) // {FAN} AS n, "
                   f"CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k - 1} GROUP BY {group}, idx // {FAN}))")
    return ",\n".join(out)


def _sql_path(name: str, group: str, idx: str) -> tuple[str, str]:
    """Joins that bring each level's node of a row, and the list of (left, right)."""
    joins = " ".join(f"JOIN {name}{k} {name}_{k} ON {name}_{k}.{group} IS NOT DISTINCT FROM b.{group} AND {name}_{k}.idx = b.{idx} // {FAN ** k}"
                     for k in range(_SQL_LEVELS))
    steps = " || ".join(f"CASE WHEN {name}_{k}.n = 1 THEN [] ELSE [{{'l': {name}_{k}.l, 'r': {name}_{k}.r}}] END" for k in range(_SQL_LEVELS))
    return joins, steps


_TREE_JOIN, _TREE_STEPS = _sql_path("t", "g", "idx")
_TOP_JOIN, _TOP_STEPS = _sql_path("u", "one", "place")
ORACLE = f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, source AS g, sha256({_SQL_FIELDS}) AS h,
    CASE WHEN {crc32_sql('doc_id::VARCHAR')} % {TAMPER} = 0 THEN sha256({_SQL_FIELDS.replace('text', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("AS translate", "AS")}) END AS changed
  FROM documents),
{_sql_tree('t', "SELECT doc_id, g, h, changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves", 'g')},
{_sql_tree('u', f"SELECT 0 AS one, g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t{_SQL_LEVELS}", 'one')},
tops AS MATERIALIZED (SELECT b.g, b.h AS subroot, (SELECT h FROM u{_SQL_LEVELS}) AS root, {_TOP_STEPS} AS path FROM (SELECT *, idx AS place FROM u0) b {_TOP_JOIN}),
proofs AS (SELECT b.doc_id, b.h AS leaf, b.changed, tops.subroot, tops.root, {_TREE_STEPS} || tops.path AS path
  FROM t0 b {_TREE_JOIN} JOIN tops ON tops.g IS NOT DISTINCT FROM b.g),
folded AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda p: p.l || p.r), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce(list_transform(path, lambda p: [p.l, p.r]), lambda a, p: [sha256(p[1] || a[1] || p[2])], [coalesce(changed, leaf)])[1] AS folded_root FROM proofs)
SELECT *, folded_root = root AS verified FROM folded
"""
