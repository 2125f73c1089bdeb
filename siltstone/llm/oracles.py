"""DuckDB SQL that gives the same rows as the query of the same name."""

from __future__ import annotations

from siltstone.llm.quality import ROUNDS, RULES, START

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    """Measures by unnesting words, then the rounds as a recursive query over vote patterns."""
    r = range(len(RULES))
    rules = [
        ("n_symbols * 100 <= n_words", "n_symbols * 100 > n_words * 10"),
        ("n_dup_lines = 0 AND n_lines >= 3", "n_dup_lines >= 3 AND n_dup_lines * 100 > n_lines * 30"),
        ("n_repeat_words * 100 <= n_words * 5", "n_repeat_words * 100 > n_words * 30"),
        ("n_upper * 100 <= word_chars * 10", "n_upper * 100 > word_chars * 40"),
        ("word_chars >= n_words * 3 AND word_chars <= n_words * 9", "word_chars * 2 < n_words * 5 OR word_chars > n_words * 12"),
        ("n_distinct * 100 >= n_words * 40", "n_distinct * 100 < n_words * 15"),
        ("n_bang * 100 <= n_words * 2", "n_bang * 100 > n_words * 20"),
        ("n_ends * 100 >= n_words * 3", "n_ends * 100 < n_words"),
        ("n_marks * 100 <= n_words * 2", "n_marks * 100 > n_words * 10"),
    ]
    vote = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{i}" for i, (good, bad) in enumerate(rules))
    vs = ", ".join(f"v{i}" for i in r)
    odds = "ln(1 - pi) - ln(pi)" + "".join(f" + CASE v{i} WHEN -1 THEN ln(b{i}) - ln(1 - a{i}) WHEN 1 THEN ln(1 - b{i}) - ln(a{i}) ELSE 0 END" for i in r)
    fit = ", ".join(
        f"(coalesce(sum(p * n) FILTER (v{i} = 1), 0) + 1) / (coalesce(sum(p * n) FILTER (v{i} <> 0), 0) + 2) AS a{i}, "
        f"(coalesce(sum((1 - p) * n) FILTER (v{i} = -1), 0) + 1) / (coalesce(sum((1 - p) * n) FILTER (v{i} <> 0), 0) + 2) AS b{i}"
        for i in r
    )
    first = ", ".join(f"{START[1]}::DOUBLE AS a{i}, {START[2]}::DOUBLE AS b{i}" for i in r)
    chars = lambda s: f"(length(t) - length(regexp_replace(t, '[{s}]', '', 'g')))"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
tw AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rp AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM tw, (VALUES (0), (1), (2)) x(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, {chars('#*$%&|<>')}::BIGINT AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  {chars('A-Z')} AS n_upper, {chars('!')} AS n_bang, {chars('.!?')} AS n_ends, len(list_distinct(ws)) AS n_distinct, len(regexp_extract_all(t, '[#*$%&|<>]+')) AS n_marks
  FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rp USING (doc_id)),
v AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {vote} FROM m),
pt AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n FROM v WHERE n_words >= 50 GROUP BY ALL),
em AS (SELECT 0 AS it, {START[0]}::DOUBLE AS pi, {first}
  UNION ALL SELECT it + 1, (sum(p * n) + 1) / (sum(n) + 2) AS pi, {fit}
  FROM (SELECT *, 1 / (1 + exp({odds})) AS p FROM em, pt WHERE it < {ROUNDS}) GROUP BY it),
ok AS (SELECT {vs}, 1 / (1 + exp({odds})) >= 0.5 AS good FROM pt, (SELECT * FROM em WHERE it = {ROUNDS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(good, FALSE) AS kept
FROM v LEFT JOIN ok USING ({vs})"""


_MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS w, source_size * 2 AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () * 3 AS budget, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w,
  sum(source_size) OVER () * 3 - coalesce(sum(cap) OVER b, 0) * 2 AS left_b FROM r
  WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * 2 * left_w <= w * left_b AS stops FROM o),
t AS (SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE
  ((budget - coalesce(sum(cap) FILTER (stops) OVER (), 0) * 2) * w)::DOUBLE / (sum(w) FILTER (NOT stops) OVER () * 2)::DOUBLE END AS target FROM f),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds,
  sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, target - rounds * source_size AS b FROM c),
x AS (SELECT source, min(h) AS cut FROM e WHERE upto > b GROUP BY source),
y AS (SELECT x.source, cut, any_value(upto) AS hi, any_value(b) AS b, any_value(upto) - sum(size) AS lo FROM x JOIN e ON x.source IS NOT DISTINCT FROM e.source AND h = cut GROUP BY x.source, cut)
SELECT doc_id, size, source_size, target,
  (size * (rounds + CASE WHEN cut IS NOT NULL AND (h < cut OR h = cut AND hi - y.b < y.b - lo) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e LEFT JOIN y ON e.source IS NOT DISTINCT FROM y.source"""


_LINES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS three FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
k AS (SELECT *, row_number() OVER (PARTITION BY three ORDER BY doc_id, i) AS nth FROM w WHERE regexp_matches(three, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, i + x.j AS i FROM k, (VALUES (0), (1), (2)) x(j) WHERE nth > 1),
p AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
q AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(q.text, '') AS text, CASE WHEN t = '' THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
  CASE WHEN t = '' THEN 0 ELSE len(ls) - coalesce(n, 0) END::BIGINT AS n_removed
FROM d LEFT JOIN q USING (doc_id)"""

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_SCORES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS v, ws[i - 1] AS u, ws[i - 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY v) - count(*) OVER (PARTITION BY doc_id, v) AS one,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY i > 1, u, v) - count(*) OVER (PARTITION BY i > 1, doc_id, u, v) END AS two,
  CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY i > 2, t, u, v) - count(*) OVER (PARTITION BY i > 2, doc_id, t, u, v) END AS three FROM p),
c AS (SELECT *, lag(one) OVER d AS one_before, lag(two) OVER d AS two_before FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
nd AS (SELECT doc_id, len(ws)::BIGINT AS n_words, sum(len(ws)) OVER () - len(ws) AS rest FROM w),
s AS (SELECT doc_id, CASE WHEN three > 0 AND two_before > 0 THEN log10(three / two_before)
  WHEN two > 0 AND one_before > 0 THEN log10(two / one_before) + CASE WHEN i > 2 THEN log10(0.4::DOUBLE) ELSE 0 END
  ELSE CASE WHEN one > 0 THEN log10(one / rest) ELSE -log10(rest + 1.0::DOUBLE) END + least(i - 1, 2) * log10(0.4::DOUBLE) END AS s
  FROM c JOIN nd USING (doc_id))
SELECT nd.doc_id, n_words, round(coalesce(sum(s), 0), 6) AS log10_score FROM nd LEFT JOIN s USING (doc_id) GROUP BY nd.doc_id, n_words"""

SQL: dict[str, str] = {
    "op4_exact_top_k": _TOP_K,
    "op2_quality_rules": _quality(),
    "op3_source_mixing": _MIXING,
    "op5_line_dedup": _LINES,
    "op6_lm_score": _SCORES,
}
