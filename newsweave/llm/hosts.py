"""URL filters: fixed rules, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix.  Each level's rate is shrunk towards the level above it through a
beta-binomial prior whose strength is estimated from the spread of the level's
rates around it (method of moments); a host is blocked when the lower bound
of its posterior bad rate passes a threshold.  A host without labels gets the
posterior of its domain, a domain without labels that of its suffix.

Only DataFrame functions are used.  Outcomes are pre-aggregated to one row per
host before anything else, so a host with a third of all pages costs no more
than another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of more than one label, under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in")
BLOCK_ABOVE = 0.3     # posterior bad rate
Z = 1.2816            # one-sided 90 % normal quantile
STRENGTH = (1.0, 1e4)  # bounds of a prior's strength, in pages


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end to the next ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


# What is no part of a host's name, and numeric addresses.
USER, PORT, DOTS = r"^.*@", r":[0-9]*$", r"\.+$"
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*)$"


def name(h: Column) -> Column:
    """The host that has a reputation: without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(h, USER, ""), PORT, ""), DOTS, "")


def rule_of(h: Column, p: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null.  ``rules`` is
    a list in a configuration; of two rules of one length the first counts."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the last that fits stands outermost
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def suffix(h: Column) -> Column:
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(h, ".", -1))


def domain(h: Column) -> Column:
    """The suffix and one label more (the host itself if it has no more)."""
    return F.when(F.substring_index(h, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def placed(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Rows with a host -> the same with its domain and suffix.  ``suffixes``
    (suffix) lists suffixes of two or three labels, the longest counts; without
    it ``LONG_SUFFIXES`` are taken.  A numeric address is its own domain and
    suffix."""
    alone = lambda c: F.when(F.col("host").rlike(ADDRESS), F.col("host")).otherwise(c)
    if suffixes is None:
        return hosts.withColumn("domain", alone(domain(F.col("host")))).withColumn("suffix", alone(suffix(F.col("host"))))
    known = suffixes.where("suffix IS NOT NULL").select(ascii_lower(F.col("suffix")).alias("_name")).distinct()
    ends = {n: F.substring_index("host", ".", -n) for n in (1, 2, 3, 4)}
    out = hosts.withColumns({"_end2": ends[2], "_end3": ends[3]})
    for n in (2, 3):
        out = out.join(known.select(F.col("_name").alias(f"_end{n}"), F.lit(True).alias(f"_is{n}")), f"_end{n}", "left")
    longest = lambda k: F.when(F.col("_is3"), ends[3 + k]).when(F.col("_is2"), ends[2 + k]).otherwise(ends[1 + k])
    return out.withColumns({"domain": alone(longest(1)), "suffix": alone(longest(0))}).drop("_end2", "_end3", "_is2", "_is3")


def _strength(level: DataFrame) -> float:
    """A beta-binomial prior's strength from the spread of a level's rates
    around the level above (``prior``): with k groups, Pearson's statistic is
    k + r * sum(n - 1) on average, and the strength is 1 / r - 1."""
    rate = F.col("bad") / F.col("n")
    square = F.col("n") * (rate - F.col("prior")) ** 2 / (F.col("prior") * (1 - F.col("prior")))
    x = level.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") - 1).alias("free"),
                  F.sum(F.round(square, 6).cast("decimal(38,6)")).alias("q")).first()
    low, high = STRENGTH
    r = (float(x.q) - x.k) / x.free if x.free else 0.0
    return min(high, max(low, 1 / r - 1)) if r > 0 else high


def reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes (host, bad 0/1) -> lower bounds (key, bound) of hosts, domains and
    suffixes."""
    named = outcomes.select(name(F.col("host")).alias("host"), "bad")
    hosts = cut(named.where("bad IS NOT NULL AND host <> ''").groupBy("host")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    hosts = placed(hosts, suffixes)
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    rate = (total.bad + 0.5) / (total.n + 1.0) if total.n else 0.0

    def posterior(level: DataFrame) -> DataFrame:
        """Rows (n, bad, prior) with the posterior's a, b, mean and bound."""
        strength = F.lit(_strength(level))
        a = F.col("bad") + strength * F.col("prior")
        b = F.col("n") - F.col("bad") + strength * (1 - F.col("prior"))
        return level.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).withColumn("bound", lower_bound())

    s = posterior(suffixes.withColumn("prior", F.lit(rate)))
    d = posterior(domains.join(s.select("suffix", F.col("mean").alias("prior")), "suffix"))
    h = posterior(hosts.join(d.select("domain", F.col("mean").alias("prior")), "domain"))
    return h.select("host", "bound"), d.select("domain", "bound"), s.select("suffix", "bound")


def lower_bound() -> Column:
    """Mean less Z standard deviations of the beta posterior.

    It stands for the posterior's 10 % quantile and comes near it as pages are
    counted: within 0.04 where a + b is 10, 0.004 where it is 100.  For very
    small a + b it can be negative, which blocks nothing.
    """
    a, b = F.col("a"), F.col("b")
    n = a + b
    return a / n - F.lit(Z) * F.sqrt(a * b / (n * n * (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
          block_above: float = BLOCK_ABOVE, suffixes: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, url), outcomes (host, bad) -> page_id, host, path, rule,
    verdict, bound; one row per page.

    A fitting rule decides; else the host is blocked where the lower bound of
    its bad rate is above ``block_above``.  Users, ports and final dots are
    shown with the host but have no reputation of their own.  A null url, or one without ://, has
    an empty host, which no rule fits and no outcome counts for; it is judged
    like a host of an unknown suffix.  Outcomes with a null label or an empty
    host are left out.  Without outcomes nothing is blocked but by rules.
    Repeated pages are judged each; further columns are ignored.  For
    ``suffixes`` see ``placed``.
    """
    by_host, by_domain, by_suffix = reputation(outcomes, suffixes)
    p = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    # posteriors of every host that occurs, known or not: one row per host
    each = p.select(F.col("host").alias("_host"), name(F.col("host")).alias("host")).distinct()
    names = placed(each, suffixes).withColumnsRenamed({"domain": "_domain", "suffix": "_suffix"})
    known = (names.join(by_host.withColumnRenamed("bound", "_h"), "host", "left")
             .join(by_domain.select(F.col("domain").alias("_domain"), F.col("bound").alias("_d")), "_domain", "left")
             .join(by_suffix.select(F.col("suffix").alias("_suffix"), F.col("bound").alias("_s")), "_suffix", "left")
             .select(F.col("_host").alias("host"), F.coalesce("_h", "_d", "_s", F.lit(0.0)).alias("bound")))
    found = rule_of(F.col("host"), F.col("path"), rules)
    return (p.join(known, "host").withColumn("_rule", found)
            .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                    F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") > block_above, "block").otherwise("allow")).alias("verdict"),
                    F.round("bound", 4).alias("bound")))


def query(spark, sf_dir: str) -> DataFrame:
    """Outcome of a page: the label of its number, bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = (pages.join(labels, pages.page_id == labels.doc_id)
                .select(host(F.col("url")).alias("host"), bad.alias("bad")))
    return judge(pages, outcomes)


def _posterior_sql(name: str, key: str, level: str) -> str:
    """Posterior a, b of a level's rows (key, n, bad, prior)."""
    return f"""{name}_in AS MATERIALIZED ({level}),
{name}_r AS (SELECT CASE WHEN sum(n - 1) > 0 THEN (sum(round(n * (bad / n - prior) ** 2 / (prior * (1 - prior)), 6)) - count(*)) / sum(n - 1) ELSE 0 END AS r FROM {name}_in),
{name} AS MATERIALIZED (SELECT {key}, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM {name}_in,
  (SELECT CASE WHEN r > 0 THEN least(1e4, greatest(1.0, 1 / r - 1)) ELSE 1e4 END AS m FROM {name}_r))"""


_LONG = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
_BOUND = f"a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"
ORACLE = rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
y AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '{USER}', ''), '{PORT}', ''), '{DOTS}', '') AS name FROM p),
x AS (SELECT *, string_split(name, '.') AS parts, array_to_string(string_split(name, '.')[-2:], '.') AS two, regexp_matches(name, '{ADDRESS}') AS address FROM y),
q AS (SELECT page_id, host, name, path, CASE WHEN address THEN name WHEN two IN ({_LONG}) THEN two ELSE parts[-1] END AS suffix,
    CASE WHEN address THEN name WHEN two IN ({_LONG}) THEN array_to_string(parts[-3:], '.') ELSE two END AS domain FROM x),
o AS (SELECT q.*, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad
    FROM q JOIN labels ON page_id = doc_id WHERE name <> ''),
h AS MATERIALIZED (SELECT name AS host, domain, suffix, count(*) AS n, sum(bad)::BIGINT AS bad FROM o WHERE bad IS NOT NULL GROUP BY ALL),
d AS MATERIALIZED (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
s AS MATERIALIZED (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY ALL),
{_posterior_sql('sp', 'suffix', 'SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM s) AS prior FROM s')},
{_posterior_sql('dp', 'domain', 'SELECT d.*, sp.a / (sp.a + sp.b) AS prior FROM d JOIN sp USING (suffix)')},
{_posterior_sql('hp', 'host', 'SELECT h.*, dp.a / (dp.a + dp.b) AS prior FROM h JOIN dp USING (domain)')},
z AS (SELECT q.*, coalesce((SELECT {_BOUND} FROM hp WHERE hp.host = q.name), (SELECT {_BOUND} FROM dp WHERE dp.domain = q.domain),
    (SELECT {_BOUND} FROM sp WHERE sp.suffix = q.suffix), 0.0) AS bound FROM q),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM z)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN bound > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END AS verdict, round(bound, 4) AS bound FROM r
"""
