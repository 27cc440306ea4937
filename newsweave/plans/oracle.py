"""DuckDB SQL that restates each registered query, for the correctness check.

The SQL is written against the raw tables (`documents`, `embeddings`, ...)
and rebuilds the article stand-in with the same expressions as
``sources.news``.  Fixed value lists are rendered from ``functions.fixed``
so that both engines read the same literals.
"""

from __future__ import annotations

from ..functions.fixed import (CATEGORY_MERGE, FIXTURE_CATEGORIES, STOPWORDS_EN)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _w(x: str) -> str:
    return f"concat('Writer ', cast(({x}) % 37 AS VARCHAR))"


NEWS = f"""
headlines AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN text ELSE regexp_extract(text, '^[^.!?\\n]*[.!?]*', 0) END AS headline FROM documents),
news AS (
  SELECT doc_id AS row_id,
         CASE WHEN doc_id % 97 = 5 THEN NULL
              ELSE concat('HTTPS://news.example.org/', cast(doc_id AS VARCHAR)) END AS link,
         headline,
         ({sql_list([c.upper() for c in FIXTURE_CATEGORIES])})[cast(floor(sqrt(doc_id % 1024)) AS INTEGER) + 1] AS category,
         CASE WHEN doc_id % 101 = 7 THEN NULL
              ELSE substring(text, length(headline) + 1) END AS short_description,
         CASE doc_id % 7
              WHEN 0 THEN ''
              WHEN 1 THEN {_w('doc_id')}
              WHEN 2 THEN concat({_w('doc_id')}, ', ', {_w('doc_id * 5 + 3')})
              WHEN 3 THEN concat({_w('doc_id')}, ' and ', {_w('doc_id * 5 + 3')})
              WHEN 4 THEN concat({_w('doc_id')}, ', ', {_w('doc_id * 5 + 3')}, ' and ', {_w('doc_id * 3 + 1')})
              WHEN 5 THEN concat({_w('doc_id')}, ', AP')
              ELSE concat({_w('doc_id')}, ', and ', {_w('doc_id * 5 + 3')}) END AS authors,
         DATE '2020-01-01' + cast(doc_id % 700 AS INTEGER) AS date
  FROM headlines)"""

CLEAN = """
clean AS (
  SELECT row_id, lower(link) AS link, lower(headline) AS headline, lower(category) AS category,
         lower(short_description) AS short_description, lower(authors) AS authors, date
  FROM news
  WHERE link IS NOT NULL AND headline IS NOT NULL AND category IS NOT NULL
    AND short_description IS NOT NULL AND authors IS NOT NULL AND date IS NOT NULL)"""

BYLINE = """
byline AS (
  SELECT row_id, category, headline,
         list_filter(string_split_regex(
             CASE WHEN ends_with(authors, ', ap') THEN substring(authors, 1, length(authors) - 4)
                  ELSE authors END, ', | and '), lambda x: x <> '') AS authors
  FROM clean),
author_rows AS (
  SELECT row_id, category, unnest(authors) AS author, unnest(range(len(authors))) AS author_pos
  FROM byline)"""

MERGE_CASE = "CASE category " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in CATEGORY_MERGE.items()) + " ELSE category END"

MERGED = f"""
merged AS (
  SELECT row_id, {MERGE_CASE} AS category, category AS raw_category,
         concat(headline, ' ', short_description) AS combined_text
  FROM clean)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


BASE = with_(NEWS, CLEAN)

ORACLE: dict[str, str] = {}

ORACLE["clean_news"] = BASE + """
SELECT row_id, headline, category, short_description, authors FROM clean"""

ORACLE["category_profile"] = BASE + """
SELECT category, count(*) AS articles,
       round(avg(length(headline)), 9) AS mean_headline_len,
       median(length(headline))::DOUBLE AS median_headline_len,
       round(avg(length(short_description)), 9) AS mean_description_len,
       median(length(short_description))::DOUBLE AS median_description_len
FROM clean GROUP BY category ORDER BY articles DESC, category"""

ORACLE["top_categories"] = BASE + """
SELECT category, count(*) AS articles FROM clean
GROUP BY category ORDER BY articles DESC, category LIMIT 3"""

ORACLE["category_percent"] = BASE + """
SELECT category, articles, round(articles * 100.0 / sum(articles) OVER (), 1) AS percent
FROM (SELECT category, count(*) AS articles FROM clean GROUP BY category)"""

ORACLE["distinct_categories_first_seen"] = BASE + """
SELECT category, first_row_id, row_number() OVER (ORDER BY first_row_id, category) AS seen_order
FROM (SELECT category, min(row_id) AS first_row_id FROM clean GROUP BY category)"""

ORACLE["length_summary"] = BASE + """,
l AS (SELECT category, length(headline) AS len FROM clean),
qt AS (SELECT category, count(*) AS n,
              quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS q2,
              quantile_cont(len, 0.75) AS q3
       FROM l GROUP BY category),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qt)
SELECT b.category, b.n AS articles, round(q1, 9) AS q1, round(q2, 9) AS median, round(q3, 9) AS q3,
       min(CASE WHEN len BETWEEN lo AND hi THEN len END)::BIGINT AS whisker_low,
       max(CASE WHEN len BETWEEN lo AND hi THEN len END)::BIGINT AS whisker_high,
       sum(CASE WHEN len BETWEEN lo AND hi THEN 0 ELSE 1 END)::BIGINT AS outliers
FROM l JOIN b USING (category)
GROUP BY b.category, b.n, q1, q2, q3"""

ORACLE["description_length_summary"] = ORACLE["length_summary"].replace("length(headline) AS len", "length(short_description) AS len")

_COUNTED = BASE + """,
l AS (SELECT category, 'headline' AS measure, length(headline) AS len FROM clean
      UNION ALL SELECT category, 'short_description', length(short_description) FROM clean),
b AS (SELECT category, measure, CASE WHEN len < 256 THEN len ELSE len - len % (1 << (length(bin(len)) - 8)) END AS low,
             count(*) AS times, sum(len) AS total, min(len) AS shortest, max(len) AS longest
      FROM l GROUP BY ALL),
c AS (SELECT *, sum(times) OVER (PARTITION BY category, measure ORDER BY low) AS upto, sum(times) OVER (PARTITION BY category, measure) AS n FROM b),
p AS (SELECT category, measure, n, total / n AS mean, q, floor(q * (n - 1)) AS i, q * (n - 1) - floor(q * (n - 1)) AS f
      FROM (SELECT category, measure, any_value(n)::BIGINT AS n, sum(total)::DOUBLE AS total FROM c GROUP BY category, measure),
           (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q)),
qs AS (SELECT p.category, p.measure, p.n, p.mean, q,
              any_value(f) AS f, any_value(x.shortest) AS s1, any_value(x.longest) AS l1, any_value(y.shortest) AS s2, any_value(y.longest) AS l2
       FROM p JOIN c x ON x.category = p.category AND x.measure = p.measure AND x.upto - x.times <= i AND i < x.upto
              JOIN c y ON y.category = p.category AND y.measure = p.measure AND y.upto - y.times <= least(i + 1, p.n - 1) AND least(i + 1, p.n - 1) < y.upto
       GROUP BY p.category, p.measure, p.n, p.mean, q),
bounds AS (SELECT category, measure, n, mean, q, s1 + f * (s2 - s1) AS a, l1 + f * (l2 - l1) AS z FROM qs)
"""
ORACLE["profile_from_parts"] = _COUNTED + """
SELECT category, measure, n AS articles, round(mean, 9) AS mean_len, a AS median_at_least, z AS median_at_most
FROM bounds WHERE q = 0.5"""
ORACLE["box_numbers_from_parts"] = _COUNTED + """,
w AS (SELECT x.category, x.measure, x.n, x.a AS q1a, x.z AS q1z, y.a AS ma, y.z AS mz, v.a AS q3a, v.z AS q3z,
             x.a - 1.5 * (v.z - x.a) AS lo1, x.z - 1.5 * (v.a - x.z) AS lo2, v.a + 1.5 * (v.a - x.z) AS hi1, v.z + 1.5 * (v.z - x.a) AS hi2
      FROM bounds x JOIN bounds y USING (category, measure) JOIN bounds v USING (category, measure) WHERE x.q = 0.25 AND y.q = 0.5 AND v.q = 0.75)
SELECT category, measure, w.n AS rows, q1a AS q1_at_least, q1z AS q1_at_most, ma AS median_at_least, mz AS median_at_most,
       q3a AS q3_at_least, q3z AS q3_at_most,
       min(greatest(shortest, ceil(lo1))) FILTER (longest >= lo1)::BIGINT AS whisker_low_at_least,
       min(CASE WHEN shortest >= lo2 THEN shortest ELSE longest END) FILTER (longest >= lo2)::BIGINT AS whisker_low_at_most,
       max(CASE WHEN longest <= hi1 THEN longest ELSE shortest END) FILTER (shortest <= hi1)::BIGINT AS whisker_high_at_least,
       max(least(longest, floor(hi2))) FILTER (shortest <= hi2)::BIGINT AS whisker_high_at_most,
       coalesce(sum(times) FILTER (longest < lo1 OR shortest > hi2), 0)::BIGINT AS outliers_at_least,
       coalesce(sum(times) FILTER (shortest < lo2 OR longest > hi1), 0)::BIGINT AS outliers_at_most
FROM b JOIN w USING (category, measure) GROUP BY ALL"""

ORACLE["category_orders"] = BASE + """
SELECT category, row_number() OVER (ORDER BY articles DESC, category) AS by_articles,
  row_number() OVER (ORDER BY mh DESC, category) AS by_mean_headline_len, row_number() OVER (ORDER BY dh DESC, category) AS by_median_headline_len,
  row_number() OVER (ORDER BY md DESC, category) AS by_mean_description_len, row_number() OVER (ORDER BY dd DESC, category) AS by_median_description_len
FROM (SELECT category, count(*) AS articles, round(avg(length(headline)), 9) AS mh, median(length(headline)) AS dh,
        round(avg(length(short_description)), 9) AS md, median(length(short_description)) AS dd FROM clean GROUP BY category)"""

ORACLE["read_news_json"] = with_(NEWS, CLEAN.replace("FROM news", "FROM keyed")).replace("clean AS (", """keyed AS (
  SELECT * REPLACE (row_number() OVER (ORDER BY sha256(concat_ws(chr(31), coalesce(link, chr(0)), coalesce(headline, chr(0)), coalesce(category, chr(0)),
    coalesce(short_description, chr(0)), coalesce(authors, chr(0)), coalesce(cast(date AS VARCHAR), chr(0))))) - 1 AS row_id) FROM news),
clean AS (""", 1) + """
SELECT row_id, link, headline, category, short_description, authors, date FROM clean"""

ORACLE["byline_authors"] = with_(NEWS, CLEAN, BYLINE) + """
SELECT row_id, authors FROM byline"""

ORACLE["author_counts"] = with_(NEWS, CLEAN, BYLINE) + """
SELECT author, count(*) AS articles FROM author_rows GROUP BY author
ORDER BY articles DESC, author"""

ORACLE["author_category_counts"] = with_(NEWS, CLEAN, BYLINE) + """
SELECT author, category, count(*) AS n FROM author_rows GROUP BY author, category"""

_COMPAT = with_(NEWS, CLEAN, BYLINE) + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY row_id, author_pos) AS rn
           FROM author_rows)
SELECT author, category, count(*) AS n FROM ranked WHERE rn > 1 {extra}
GROUP BY author, category"""

ORACLE["author_category_counts_compat"] = _COMPAT.format(extra="")
ORACLE["author_lookup"] = _COMPAT.format(extra="AND author = 'writer 5'")

ORACLE["merged_categories"] = with_(NEWS, CLEAN, MERGED) + """
SELECT raw_category, category, count(*) AS articles FROM merged GROUP BY raw_category, category"""

ORACLE["combined_text"] = with_(NEWS, CLEAN, MERGED) + """
SELECT row_id, combined_text, category FROM merged"""

STOPWORDS_SQL = sql_in(STOPWORDS_EN)

# --- stage 5: split -----------------------------------------------------------

QUOTAS = """
cnt AS (SELECT category, count(*) AS n FROM merged GROUP BY category),
t1 AS (SELECT *, NN - (NN * 3 + 9) // 10 AS T
       FROM (SELECT *, sum(n) OVER () AS NN FROM cnt)),
a1 AS (SELECT *, CASE WHEN NN = 0 THEN 0 ELSE n * T // NN END AS base,
              CASE WHEN NN = 0 THEN 0 ELSE n * T % NN END AS rem FROM t1),
q1 AS (SELECT category, n, base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS train
       FROM (SELECT *, T - sum(base) OVER () AS short,
                    row_number() OVER (ORDER BY rem DESC, category) AS rk FROM a1)),
m1 AS (SELECT *, n - train AS m FROM q1),
m2 AS (SELECT *, sum(m) OVER () AS MM FROM m1),
a2 AS (SELECT *, MM // 2 AS V,
              CASE WHEN MM = 0 THEN 0 ELSE m * (MM // 2) // MM END AS base,
              CASE WHEN MM = 0 THEN 0 ELSE m * (MM // 2) % MM END AS rem FROM m2),
quota AS (SELECT category, n, train, base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS validation, m
          FROM (SELECT *, V - sum(base) OVER () AS short,
                       row_number() OVER (ORDER BY rem DESC, category) AS rk FROM a2)),
ranked AS (SELECT g.row_id, g.category, g.combined_text, g.raw_category,
                  row_number() OVER (PARTITION BY g.category ORDER BY md5(concat('42:', cast(g.row_id AS VARCHAR))), g.row_id) AS rnk
           FROM merged g),
splits AS (SELECT r.*, CASE WHEN rnk <= q.train THEN 'train'
                            WHEN rnk <= q.train + q.validation THEN 'validation'
                            ELSE 'test' END AS split
           FROM ranked r JOIN quota q USING (category))"""

SPLIT = with_(NEWS, CLEAN, MERGED, QUOTAS)

ORACLE["split_quotas"] = SPLIT + """
SELECT category, n, train::BIGINT AS train, validation::BIGINT AS validation,
       (m - validation)::BIGINT AS test FROM quota"""

ORACLE["stratified_split"] = SPLIT + """
SELECT row_id, category, split FROM splits"""

ORACLE["split_check"] = SPLIT + """
SELECT 0::BIGINT AS in_several, 0::BIGINT AS in_none, count(*) AS rows FROM merged"""

ORACLE["persisted_split"] = SPLIT + """
SELECT row_id, category, combined_text FROM splits WHERE split = 'test'"""

ORACLE["class_distribution"] = SPLIT + """
SELECT split, category, n, round(n / sum(n) OVER (PARTITION BY split), 9) AS share
FROM (SELECT split, category, count(*) AS n FROM splits GROUP BY split, category)"""

ORACLE["shuffled_batches"] = SPLIT + """
SELECT row_id, position, position // 8 AS batch
FROM (SELECT row_id, row_number() OVER (ORDER BY md5(concat('shuffle:42:', cast(row_id AS VARCHAR))), row_id) - 1 AS position
      FROM splits WHERE split = 'train')"""

ORACLE["written_batches"] = SPLIT + """,
p AS (SELECT row_id, category, row_number() OVER (ORDER BY md5(concat('shuffle:42:', cast(row_id AS VARCHAR))), row_id) - 1 AS position
      FROM splits WHERE split = 'train')
SELECT row_id, category, position, position // 8 AS batch, position // 8 // 16 AS block
FROM p WHERE position // 8 >= (SELECT max(position) // 8 // 2 FROM p)"""

ORACLE["batch_plan"] = SPLIT + """
SELECT rows, batches_per_epoch, batches_per_epoch * 4 AS total_steps,
       (batches_per_epoch * 4 * 10) // 100 AS warmup_steps
FROM (SELECT count(*) AS rows, (count(*) + 7) // 8 AS batches_per_epoch FROM splits WHERE split = 'train')"""

ORACLE["label_index"] = SPLIT + """
SELECT row_number() OVER (ORDER BY category) - 1 AS idx, category
FROM (SELECT DISTINCT category FROM splits WHERE split = 'train')"""

ORACLE["one_hot"] = SPLIT + """,
cls AS (SELECT list(category ORDER BY category) AS classes FROM (SELECT DISTINCT category FROM splits WHERE split = 'train'))
SELECT s.row_id, s.split, list_transform(cls.classes, lambda k: CASE WHEN k = s.category THEN 1 ELSE 0 END) AS one_hot
FROM splits s, cls"""

# --- stage 6: evaluation over the stand-in language predictor -------------------

def _lang_counts() -> str:
    from ..functions.fixed import LANGUAGE_WORDS
    return "[" + ", ".join(f"len(list_filter(w, lambda x: x IN {sql_in(ws)}))" for _, ws in LANGUAGE_WORDS) + "]"


def _lang_codes() -> str:
    from ..functions.fixed import LANGUAGE_WORDS
    return sql_list([c for c, _ in LANGUAGE_WORDS])


PRED = f"""
lw AS (SELECT doc_id, lang AS actual, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents),
lc AS (SELECT doc_id, actual, {_lang_counts()} AS c FROM lw),
pred AS (SELECT doc_id, actual, ({_lang_codes()})[list_position(c, list_max(c))] AS predicted FROM lc),
conf AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY actual, predicted),
lab AS (SELECT DISTINCT label FROM (SELECT actual AS label FROM pred UNION ALL SELECT predicted FROM pred)),
dense AS (SELECT a.label AS actual, b.label AS predicted, coalesce(conf.n, 0)::BIGINT AS n
          FROM lab a CROSS JOIN lab b
          LEFT JOIN conf ON conf.actual = a.label AND conf.predicted = b.label),
rep AS (SELECT label, tp, support, predicted,
               CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1
        FROM (SELECT label,
                     sum(CASE WHEN actual = label AND predicted = label THEN n ELSE 0 END)::BIGINT AS tp,
                     sum(CASE WHEN actual = label THEN n ELSE 0 END)::BIGINT AS support,
                     sum(CASE WHEN predicted = label THEN n ELSE 0 END)::BIGINT AS predicted
              FROM lab JOIN conf ON conf.actual = lab.label OR conf.predicted = lab.label
              GROUP BY label))"""

EVAL = "WITH " + PRED + "\n"

ORACLE["rule_predictions"] = EVAL + "SELECT doc_id, actual, predicted FROM pred"
ORACLE["confusion_matrix"] = EVAL + "SELECT actual, predicted, n FROM conf"
ORACLE["confusion_dense"] = EVAL + "SELECT actual, predicted, n FROM dense"
ORACLE["confusion_wide"] = EVAL + """
SELECT actual, list(n ORDER BY predicted) AS counts,
       (SELECT list(label ORDER BY label) FROM lab) AS labels
FROM dense GROUP BY actual"""
ORACLE["class_report"] = EVAL + """
SELECT label, tp, support, predicted, round(precision, 9) AS precision,
       round(recall, 9) AS recall, round(f1, 9) AS f1 FROM rep"""
ORACLE["evaluation_metrics"] = EVAL + """
SELECT round(sum(tp) / sum(support), 9) AS accuracy,
       round(sum(support * precision) / sum(support), 9) AS weighted_precision,
       round(sum(support * recall) / sum(support), 9) AS weighted_recall,
       round(sum(support * f1) / sum(support), 9) AS weighted_f1,
       printf('%.5f', sum(tp) / sum(support)) AS accuracy_text,
       printf('%.5f', sum(support * f1) / sum(support)) AS weighted_f1_text,
       printf('%.5f', sum(support * precision) / sum(support)) AS weighted_precision_text,
       printf('%.5f', sum(support * recall) / sum(support)) AS weighted_recall_text,
       sum(support)::BIGINT AS rows
FROM rep"""

# --- vectors over `embeddings` ---------------------------------------------------

VEC = """
WITH sc AS (
  SELECT vec_id, label, embedding,
         list_transform(range(10), lambda c: list_sum(list_transform(range(64),
             lambda j: embedding[j + 1]::DOUBLE * ((((c * 7 + j * 13) % 17) - 8) / 8.0::DOUBLE)))
             + ((c % 3) - 1) / 10.0::DOUBLE) AS scores
  FROM embeddings),
ex AS (SELECT *, list_transform(scores, lambda x: exp(x - list_max(scores))) AS e FROM sc),
pr AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM ex)
"""

ORACLE["dense_scores"] = VEC + "SELECT vec_id, list_transform(scores, lambda x: round(x, 9)) AS scores FROM pr"
ORACLE["softmax_scores"] = VEC + "SELECT vec_id, list_transform(probs, lambda x: round(x, 9)) AS probs FROM pr"
ORACLE["sigmoid_scores"] = VEC + """
SELECT vec_id, list_transform(scores, lambda x: round(1.0 / (1.0 + exp(-x)), 9)) AS sigmoid FROM pr"""
ORACLE["argmax_label"] = VEC + """
SELECT vec_id, label, (list_position(scores, list_max(scores)) - 1)::INTEGER AS predicted FROM pr"""
ORACLE["cross_entropy"] = VEC + """
SELECT round(avg(-ln(greatest(least(probs[label + 1], 1 - 1e-7), 1e-7))), 9) AS cross_entropy,
       count(*) AS rows FROM pr"""
ORACLE["categorical_accuracy"] = VEC + """
SELECT round(avg(CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1 ELSE 0 END), 9)
         AS categorical_accuracy, count(*) AS rows FROM pr"""
ORACLE["pooled_features"] = """
WITH halves AS (SELECT vec_id, embedding[1:16] AS a, embedding[17:32] AS b, embedding[33:48] AS c, embedding[49:64] AS d FROM embeddings)
SELECT vec_id, list_transform(range(1, 17), lambda i: greatest(a[i], b[i], c[i], d[i])) AS pooled FROM halves"""

ORACLE["max_pool"] = """
SELECT label, list(m ORDER BY pos) AS pooled
FROM (SELECT label, pos, max(x) AS m
      FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
      GROUP BY label, pos)
GROUP BY label"""

# --- stage 4: text ---------------------------------------------------------------

def _repl(rep: str) -> str:
    import re
    return re.sub(r"\$(\d)", r"\\\1", rep)


def tokenize_sql(col: str, marked: bool = False) -> str:
    """The tokeniser of ``functions.tokenize`` as a DuckDB expression."""
    from ..functions.fixed import ACRONYM_AT_BREAK, BLANKS, SENTENCE_END, TOKEN_RULES
    x = col
    if not marked:
        x = f"trim(regexp_replace({col}, {q(BLANKS)}, ' ', 'g'))"
        x = f"regexp_replace({x}, {q(SENTENCE_END)}, '\\1' || chr(10), 'g')"
        x = f"regexp_replace({x}, {q(ACRONYM_AT_BREAK)}, '\\1\\2 ', 'g')"
    t = "concat(' ', s, ' ')"
    for pat, rep in TOKEN_RULES:
        t = f"regexp_replace({t}, {q(pat)}, {q(_repl(rep))}, 'g')"
    toks = f"flatten(list_transform(string_split({x}, chr(10)), lambda s: string_split_regex(trim({t}), ' +')))"
    return f"list_filter({toks}, lambda t: t <> '')"


def cleaned_tokens_sql(col: str) -> str:
    from ..functions.fixed import NON_WORD
    return (f"list_transform(list_filter({tokenize_sql(col)}, lambda t: t NOT IN {STOPWORDS_SQL}), "
            f"lambda t: regexp_replace(t, {q(NON_WORD)}, '', 'g'))")


def _lemma_candidates() -> str:
    from ..functions.fixed import NOUN_SUFFIX_RULES
    parts = []
    for suf, rep in NOUN_SUFFIX_RULES:
        cond = f"ends_with(word, {q(suf)})" + (" AND length(word) > 1" if suf == "s" else "")
        parts.append(f"CASE WHEN {cond} THEN concat(substring(word, 1, length(word) - {len(suf)}), {q(rep)}) END")
    return "[" + ", ".join(parts) + "]"


WORD_SQL = "'[\\p{L}\\p{N}_]+'"

TEXT = f"""
tok AS (SELECT row_id, category, {cleaned_tokens_sql('combined_text')} AS t FROM merged),
voc AS (SELECT DISTINCT w AS word FROM (SELECT unnest(t) AS w FROM tok) WHERE w <> ''),
cand AS (SELECT word AS form, unnest({_lemma_candidates()}) AS lemma FROM voc),
lem AS (SELECT form, lemma FROM (
          SELECT form, lemma, row_number() OVER (PARTITION BY form ORDER BY length(lemma), lemma) AS rn
          FROM cand WHERE lemma IS NOT NULL AND lemma <> form AND length(lemma) < length(form) AND lemma IN (SELECT word FROM voc))
        WHERE rn = 1),
ex AS (SELECT row_id, unnest(t) AS form, unnest(range(len(t))) AS pos FROM tok),
rl AS (SELECT row_id, list(coalesce(lem.lemma, ex.form) ORDER BY pos) AS t
       FROM ex LEFT JOIN lem USING (form) GROUP BY row_id),
norm AS (SELECT tok.row_id, tok.category, coalesce(rl.t, []::VARCHAR[]) AS t
         FROM tok LEFT JOIN rl USING (row_id))"""

TEXTQ = with_(NEWS, CLEAN, MERGED, TEXT)

ORACLE["tokenize"] = with_(NEWS, CLEAN, MERGED) + f"""
SELECT row_id, {tokenize_sql('combined_text')} AS tokens FROM merged"""

def _ll(k: str, n: str, p: str) -> str:
    part = lambda x, y: f"CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END"
    return f"({part(k, p)} + {part(f'({n} - {k})', f'(1.0::DOUBLE - {p})')})"


def _learned_sql() -> str:
    from ..functions.fixed import (ABBREVIATION_SCORE, BLANKS, DOT_PROBABILITY, INITIALS, PLAIN_WORD,
                                   STARTER_SCORE, WORD_EDGES)
    bare = lambda c: f"regexp_replace(lower({c}), {q(WORD_EDGES)}, '', 'g')"
    form = lambda c: f"regexp_replace({bare(c)}, '\\.$', '')"
    p, letters = "(dot::DOUBLE / total)", "length(replace(form, '.', ''))"
    keeps = f"(regexp_matches(wf, {q(INITIALS)}) OR wf IN (SELECT form FROM abbr))"
    return f"""
ws AS MATERIALIZED (SELECT row_id, string_split(trim(regexp_replace(combined_text, {q(BLANKS)}, ' ', 'g')), ' ') AS w FROM merged),
each AS MATERIALIZED (SELECT row_id, pos, word, nxt, {bare('word')} AS wb, {form('word')} AS wf, {form('nxt')} AS nf
  FROM (SELECT row_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word, unnest(list_concat(w[2:], [NULL])) AS nxt FROM ws)),
wc AS (SELECT wf AS form, count(*) FILTER (ends_with(wb, '.')) AS n_dot, count(*) FILTER (NOT ends_with(wb, '.')) AS n_plain
  FROM each WHERE regexp_matches(wf, {q(PLAIN_WORD)}) GROUP BY wf),
abbr AS MATERIALIZED (SELECT * FROM (SELECT form, round(2 * ({_ll('n_dot', '(n_dot + n_plain)', f'{DOT_PROBABILITY}::DOUBLE')} - {_ll('n_dot', '(n_dot + n_plain)', p)})
    * exp(-{letters}) * (length(form) - {letters} + 1) * pow({letters}, -n_plain), 3) AS score
  FROM wc, (SELECT sum(n_dot) AS dot, sum(n_dot + n_plain) AS total FROM wc) WHERE n_dot > 0 AND dot < total) WHERE score >= {ABBREVIATION_SCORE}),
sc AS (SELECT nf AS form, count(*) FILTER (regexp_matches(word, '[!?]$') OR (ends_with(word, '.') AND NOT {keeps})) AS k, count(*) AS n
  FROM each WHERE nxt IS NOT NULL AND regexp_matches(nf, {q(PLAIN_WORD)}) GROUP BY nf),
st AS MATERIALIZED (SELECT * FROM (SELECT form, round(2 * ({_ll('k', 'ka', '(k::DOUBLE / ka)')} + {_ll('(n - k)', '(na - ka)', '((n - k)::DOUBLE / (na - ka))')}
    - {_ll('k', 'ka', '(n::DOUBLE / na)')} - {_ll('(n - k)', '(na - ka)', '(n::DOUBLE / na)')}), 3) AS start_score
  FROM sc, (SELECT sum(k) AS ka, sum(n) AS na FROM sc) WHERE ka > 0 AND ka < na AND k::DOUBLE / ka > n::DOUBLE / na) WHERE start_score >= {STARTER_SCORE}),
learned AS (SELECT form, (CASE WHEN score IS NULL THEN 0 ELSE 1 END + CASE WHEN start_score IS NULL THEN 0 ELSE 2 END)::INT AS kind, score, start_score
  FROM abbr FULL JOIN st USING (form)),
marked AS (SELECT row_id, string_agg(word || CASE WHEN nxt IS NULL THEN '' WHEN regexp_matches(word, '[!?]$')
      OR (ends_with(word, '.') AND NOT ({keeps} AND nf NOT IN (SELECT form FROM st))) THEN chr(10) ELSE ' ' END, '' ORDER BY pos) AS m FROM each GROUP BY row_id)"""


LEARNED = with_(NEWS, CLEAN, MERGED) + "," + _learned_sql()
ORACLE["sentence_words"] = LEARNED + " SELECT * FROM learned"
ORACLE["tokenize_sentences"] = LEARNED + f"""
SELECT row_id, len(list_filter(string_split(m, chr(10)), lambda s: s <> '')) AS n_sentences, {tokenize_sql('m', marked=True)} AS tokens FROM marked"""

ORACLE["lemmatize"] = TEXTQ + "SELECT form, lemma FROM lem"

ORACLE["normalize_text"] = TEXTQ + """
SELECT row_id,
       array_to_string(list_transform(list_filter(t, lambda x: x <> ''),
                                      lambda x: regexp_replace(x, '\\p{Nd}+', '', 'g')), ' ') AS combined_text,
       category
FROM norm"""

HEADWORDS = f"""
hw AS (SELECT category, row_id, regexp_extract_all(concat(headline, ' ', short_description), {WORD_SQL}) AS w FROM clean)"""

ORACLE["word_frequencies"] = with_(NEWS, CLEAN, HEADWORDS) + f"""
SELECT category, word, count(*) AS n
FROM (SELECT category, unnest(w) AS word FROM hw) WHERE word NOT IN {STOPWORDS_SQL}
GROUP BY category, word"""

LISTED = f"""
listed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORD_SQL})) AS word FROM benchmark)"""

ORACLE["remove_stopwords_table"] = with_(NEWS, CLEAN, MERGED, LISTED) + f""",
t AS (SELECT row_id, {tokenize_sql('combined_text')} AS tokens FROM merged),
each AS (SELECT row_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM t),
kept AS (SELECT row_id, list(token ORDER BY pos) AS tokens FROM each WHERE token NOT IN (SELECT word FROM listed) GROUP BY row_id)
SELECT t.row_id, coalesce(kept.tokens, []::VARCHAR[]) AS tokens FROM t LEFT JOIN kept USING (row_id)"""

ORACLE["word_frequencies_table"] = with_(NEWS, CLEAN, HEADWORDS, LISTED) + """
SELECT category, word, count(*) AS n
FROM (SELECT category, unnest(w) AS word FROM hw) WHERE word NOT IN (SELECT word FROM listed)
GROUP BY category, word"""

ORACLE["word_weights"] = with_(NEWS, CLEAN, HEADWORDS) + f"""
SELECT category, word, n, rank_in_class, round(n / max(n) OVER (PARTITION BY category), 9) AS weight
FROM (SELECT category, word, count(*) AS n,
             row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, word) AS rank_in_class
      FROM (SELECT category, unnest(w) AS word FROM hw) WHERE word NOT IN {STOPWORDS_SQL}
      GROUP BY category, word)
WHERE rank_in_class <= 200"""


def _top_ngrams_sql(n: int) -> str:
    grams = f"list_transform(range(0, len(w) - {n} + 1), lambda i: array_to_string(w[i + 1 : i + {n}], ' '))"
    return with_(NEWS, CLEAN, HEADWORDS) + f"""
SELECT category, gram, n, rank_in_class
FROM (SELECT category, gram, count(*) AS n,
             row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, gram) AS rank_in_class
      FROM (SELECT category, unnest({grams}) AS gram FROM hw)
      GROUP BY category, gram)
WHERE rank_in_class <= 10"""


ORACLE["top_bigrams"] = _top_ngrams_sql(2)
ORACLE["top_trigrams"] = _top_ngrams_sql(3)

ORACLE["bigrams_straddling"] = with_(NEWS, CLEAN, HEADWORDS) + """,
ws AS (SELECT category, row_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM hw),
g AS (SELECT category, word || ' ' || lead(word) OVER (PARTITION BY category ORDER BY row_id, pos) AS gram FROM ws)
SELECT category, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY category, gram"""

ORACLE["trigrams_straddling"] = with_(NEWS, CLEAN, HEADWORDS) + """,
ws AS (SELECT category, row_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM hw),
g AS (SELECT category,
             word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram
      FROM ws WINDOW o AS (PARTITION BY category ORDER BY row_id, pos))
SELECT category, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY category, gram"""

# --- stage 5b: vocabulary and encoding ----------------------------------------------

ENC = f""",
tk AS (SELECT row_id, split, {tokenize_sql('combined_text')} AS t FROM splits),
vcount AS (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM tk WHERE split = 'train')
           WHERE word <> '' GROUP BY word),
voc AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 + 4 AS id
        FROM vcount)"""

ORACLE["build_vocab"] = SPLIT + ENC + "\nSELECT word, n, id FROM voc"

ORACLE["encode_sequences"] = SPLIT + ENC + """,
ex AS (SELECT row_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM tk),
idl AS (SELECT row_id, list(coalesce(voc.id, 3)::INTEGER ORDER BY pos) AS ids
        FROM ex LEFT JOIN voc USING (word) GROUP BY row_id),
al AS (SELECT tk.row_id, coalesce(idl.ids, []::INTEGER[])[1:254] AS ids FROM tk LEFT JOIN idl USING (row_id))
SELECT row_id,
       list_concat([0], ids, [2], list_transform(range(256 - len(ids) - 2), lambda x: 1)) AS input_word_ids,
       list_concat(list_transform(range(len(ids) + 2), lambda x: 1),
                   list_transform(range(256 - len(ids) - 2), lambda x: 0)) AS input_mask
FROM al"""

ORACLE["training_frame"] = ORACLE["encode_sequences"].replace("SELECT row_id,\n       list_concat([0]", """, cls AS (SELECT list(category ORDER BY category) AS classes FROM (SELECT DISTINCT category FROM splits WHERE split = 'train'))
SELECT al.row_id, list_transform(cls.classes, lambda k: CASE WHEN k = s.category THEN 1 ELSE 0 END) AS one_hot,
       list_concat([0]""").replace("\nFROM al", "\nFROM al JOIN splits s USING (row_id), cls WHERE s.split = 'train'")

# --- stage 6b: batched scoring and prediction attachment ----------------------------

ORACLE["batched_inference"] = VEC + """
SELECT vec_id, label, (list_position(probs, list_max(probs)) - 1)::INTEGER AS predicted,
       round(list_max(probs), 6) AS p_max FROM pr"""

ORACLE["stored_inference"] = ORACLE["batched_inference"]

ORACLE["score_example"] = ORACLE["sigmoid_scores"] + " WHERE vec_id = (SELECT min(vec_id) FROM embeddings)"

ATTACH = SPLIT + "," + PRED + """
SELECT s.row_id, s.combined_text, s.category, p.predicted AS prediction
FROM splits s JOIN pred p ON p.doc_id = s.row_id WHERE s.split = 'test'"""

ORACLE["attach_predictions"] = ATTACH
ORACLE["csv_round_trip"] = ATTACH

ORACLE["decode_class"] = SPLIT + """,
cls AS (SELECT row_number() OVER (ORDER BY category) - 1 AS idx, category
        FROM (SELECT DISTINCT category FROM splits WHERE split = 'train'))
SELECT s.row_id, c.idx AS label, d.category AS decoded
FROM splits s LEFT JOIN cls c ON c.category = s.category LEFT JOIN cls d ON d.idx = c.idx
WHERE s.split = 'test'"""

ORACLE["preview_normalized"] = TEXTQ + """
SELECT row_id,
       array_to_string(list_transform(list_filter(t, lambda x: x <> ''),
                                      lambda x: regexp_replace(x, '\\p{Nd}+', '', 'g')), ' ') AS combined_text,
       category
FROM norm ORDER BY row_id LIMIT 5"""

# --- naive Bayes over document languages -------------------------------------------

BAYES = with_("""
merged AS (SELECT doc_id AS row_id, lang AS category, lang AS raw_category, text AS combined_text FROM documents
           WHERE lang IS NOT NULL AND text IS NOT NULL)""", QUOTAS) + f""",
bw AS (SELECT row_id, category, split, unnest(regexp_extract_all(lower(combined_text), {WORD_SQL})) AS word FROM splits),
cw AS (SELECT category, word, count(*) AS n FROM bw WHERE split = 'train' GROUP BY category, word)"""

BAYES_SCORES = BAYES + """,
cl AS (SELECT category, count(*) AS rows, (SELECT coalesce(sum(n), 0) FROM cw WHERE cw.category = s.category) AS words,
              (SELECT count(DISTINCT word) FROM cw) AS vocabulary FROM splits s WHERE split = 'train' GROUP BY category),
tw AS (SELECT row_id, word, count(*) AS times FROM bw WHERE split = 'test' GROUP BY row_id, word),
ln AS (SELECT row_id, sum(times) AS length FROM tw GROUP BY row_id),
gain AS (SELECT row_id, cw.category AS class, sum(times * ln(n + 1)) AS gain FROM tw JOIN cw USING (word) GROUP BY row_id, cw.category),
sc AS (SELECT t.row_id, cl.category AS class,
              round(ln(cl.rows) - coalesce(length, 0) * ln(words + vocabulary) + coalesce(gain, 0), 6) AS score
       FROM (SELECT row_id FROM splits WHERE split = 'test') t CROSS JOIN cl
       LEFT JOIN ln ON ln.row_id = t.row_id LEFT JOIN gain ON gain.row_id = t.row_id AND gain.class = cl.category),
pb AS (SELECT row_id, class AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, class) AS rn FROM sc) WHERE rn = 1),
pred AS (SELECT s.row_id AS doc_id, s.category AS actual, pb.prediction AS predicted FROM splits s JOIN pb USING (row_id))"""

ORACLE["bayes_words"] = BAYES + "\nSELECT category, word, n FROM cw"
ORACLE["bayes_predictions"] = BAYES_SCORES + "\nSELECT doc_id AS row_id, actual AS category, predicted AS prediction FROM pred"
ORACLE["bayes_evaluation"] = BAYES_SCORES + ",\n" + PRED[PRED.index("conf AS"):] + "\n" + ORACLE["evaluation_metrics"][len(EVAL):]
