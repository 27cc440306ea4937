"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds (assignments, access identifiers, long hex runs) are always
reported.  Weak candidates, a bare key of 40 characters or more or a service
endpoint, say little alone; they are reported only where a part of another role (identifier,
secret, endpoint) lies within ``SCOPE`` code points of the same document.

Matches get their places without any Python: the text is split at the pattern,
and the lengths of pieces and matches, summed up, are the starts.  The linking
is an interval join by sorting: inside a document, each candidate looks at the
furthest end before it and the nearest start after it of each role, so no
pairs are made.  Only documents with a weak candidate take part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

SCOPE = 200        # code points between two parts that belong together
# The patterns. A run is matched greedily, so a bound on its
# length in the pattern equals dropping the shorter matches.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# '=' belongs to a key as its padding only, so NAME=value is not one run
KEY = r"[A-Za-z0-9+/]{40,}(?:={1,2}(?![A-Za-z0-9+/=]))?"
ENDPOINT = r"(?:https?|s3|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/@%-]+"
VALUE_MIN = 6
KINDS = ("assign", "access", "hex", "key", "endpoint")  # order of kinds at one start
WEAK = ("key", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "key": "secret", "endpoint": "endpoint"}
_BLOCK = 256


def _running(lengths: Column, start: Column) -> Column:
    """start, start + l1, start + l1 + l2, ..."""
    return F.aggregate(lengths, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def _prefix(lengths: Column) -> Column:
    """Sums of what stands before each element, in blocks: linear in practice,
    also for a text with very many matches."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
    firsts = F.slice(_running(sums, F.lit(0)), F.lit(1), F.size(sums))
    return F.flatten(F.zip_with(blocks, firsts, lambda x, s: F.slice(_running(x, s), F.lit(1), F.size(x))))


def _places(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<start, end>> of the pattern's matches, in code points."""
    pieces = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda x: F.length(x))
    sizes = F.transform(matches, lambda x: F.length(x))
    begin = _prefix(F.zip_with(pieces, sizes, lambda a, b: a + b))
    return F.zip_with(F.zip_with(begin, pieces, lambda a, b: a + b), sizes,
                      lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs -> doc_id, uid and one array of (start, end) per kind; ``uid``
    names the row."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    out = docs.select("doc_id", t.alias("_t")).select(
        "doc_id", "_t",
        F.regexp_extract_all("_t", F.lit(ASSIGN), 0).alias("_assign"),
        F.when(F.contains("_t", F.lit("AKIA")), F.regexp_extract_all("_t", F.lit(ACCESS), 0)).otherwise(none).alias("_access"),
        F.regexp_extract_all("_t", F.lit(HEX), 0).alias("_hex"),
        F.regexp_extract_all("_t", F.lit(KEY), 0).alias("_key"),
        F.when(F.contains("_t", F.lit("://")), F.regexp_extract_all("_t", F.lit(ENDPOINT), 0)).otherwise(none).alias("_endpoint"))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY, "endpoint": ENDPOINT}
    found = {k: F.when(F.size(f"_{k}") > 0, _places(F.col("_t"), F.col(f"_{k}"), p)).otherwise(nothing)
             for k, p in patterns.items()}
    # failing matches are dropped after they have taken their place in the text
    values = F.regexp_extract_all("_t", F.lit(ASSIGN), 2)
    found["assign"] = F.when(F.size("_assign") > 0, F.transform(
        F.filter(F.zip_with(found["assign"], values, lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.length(x["v"]) >= VALUE_MIN),
        lambda x: x["s"])).otherwise(nothing)
    return out.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *[c.alias(k) for k, c in found.items()])


def _tagged(kind: str) -> Column:
    """The kind's spans as (start, number of the kind, end)."""
    n = F.lit(KINDS.index(kind))
    return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), n.alias("kind"), x["end"].alias("end")))


def linked(rows: DataFrame) -> DataFrame:
    """Rows of ``spans`` -> (uid, weak): the weak candidates that a part of
    another role is near to, outside of all strong spans."""
    parts = F.concat(*[_tagged(k) for k in KINDS])
    each = (rows.where(F.size("key") + F.size("endpoint") > 0)
            .select("uid", F.explode(parts).alias("p")).select("uid", "p.*")
            .withColumn("role", F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)))
    order = Window.partitionBy("uid").orderBy("start", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    strong = F.col("kind") < len(KINDS) - len(WEAK)
    near = F.lit(False)
    for role in sorted(set(ROLE.values())):
        mine = F.col("role") == role
        gap = F.least(F.col("start") - F.max(F.when(mine, F.col("end"))).over(before),
                      F.min(F.when(mine, F.col("start"))).over(after) - F.col("end"))
        near = near | (~mine & F.coalesce(gap <= SCOPE, F.lit(False)))
    covered = (F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False))
               | F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False)))
    return (each.withColumn("keep", near & ~covered & ~strong).where("keep")
            .groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak")))


def _listed(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans_), lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256,
    spans; one row per row of the input.

    A null text is empty; an empty text has no spans and the digest of the
    empty string.  Repeated rows are scanned each; a null doc_id is kept;
    further columns are ignored; an empty table gives no rows.
    """
    rows = cut(spans(docs, text))
    base = F.concat(*[_tagged(k) for k in KINDS[:3]])
    return (rows.join(linked(rows), "uid", "left").select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, F.coalesce("weak", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans")))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


# '=' after a key is its padding if it is one or two and no letter of a key
# follows: RE2 cannot look ahead, so all '=' are taken and cut off again.
_SQL_KEY = r"[A-Za-z0-9+/]{40,}=*"
_SQL_PADDED = """list_transform(range(1, len(ms) + 1), lambda i: CASE
      WHEN length(ms[i]) - length(rtrim(ms[i], '=')) IN (1, 2) AND NOT (CASE WHEN ps[i + 1] = '' THEN i < len(ms) ELSE regexp_matches(ps[i + 1], '^[A-Za-z0-9+/]') END)
      THEN ms[i] ELSE rtrim(ms[i], '=') END)"""


def _sql_kind(i: int, kind: str, pattern: str, keep: str, found: str = "ms") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, doc_id, {i} AS kind, '{kind}' AS name, '{ROLE[kind]}' AS role, start, start + length(m) AS "end" FROM (
      SELECT rid, doc_id, unnest({found}) AS m, unnest(vs) AS v, unnest(list_transform(range(1, len(ms) + 1), lambda i:
        coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::INT AS start
      FROM (SELECT rid, doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {2 if kind == 'assign' else 0}) AS vs, string_split_regex(t, '{p}') AS ps FROM d)
      WHERE len(ms) > 0) WHERE {keep}"""


_PARTS = " UNION ALL ".join(_sql_kind(i, *part) for i, part in enumerate((
    ("assign", ASSIGN, f"length(v) >= {VALUE_MIN}"), ("access", ACCESS, "true"), ("hex", HEX, "true"),
    ("key", _SQL_KEY, "true", _SQL_PADDED), ("endpoint", ENDPOINT, "true"))))
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED ({_PARTS}),
k AS (SELECT * FROM p WHERE kind < 3 OR (EXISTS (SELECT 1 FROM p o WHERE o.rid = p.rid AND o.role <> p.role
      AND o.start - p."end" <= {SCOPE} AND p.start - o."end" <= {SCOPE})
    AND NOT EXISTS (SELECT 1 FROM p o WHERE o.rid = p.rid AND o.kind < 3 AND o.start < p."end" AND o."end" > p.start))),
s AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (rid)
"""
