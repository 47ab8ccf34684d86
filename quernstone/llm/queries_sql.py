"""SQL for the pN_ queries whose result it can tell, in DuckDB's dialect on the same tables."""

from __future__ import annotations

from quernstone.llm.labels import UNKNOWN_WORDS

_WORDS = ", ".join(f"'{w}'" for w in UNKNOWN_WORDS)
_LOW = r"lower(trim(regexp_replace(lang, '[\s\p{Z}]+', ' ', 'g')))"
KEY = rf"CASE WHEN {_LOW} IN ({_WORDS}) OR NOT regexp_matches({_LOW}, '\p{{L}}') THEN NULL ELSE regexp_replace({_LOW}, '^([a-z]{{2,3}})[-_][a-z0-9]{{2,8}}([-_][a-z0-9]{{2,8}})*$', '\1') END"
CODES = "codes AS (SELECT lower(trim(n)) AS name, min(code) AS code FROM (SELECT code, unnest([code, iso3, name_en, name_native]) AS n FROM languages) GROUP BY 1)"
_VALID = "{c} IS NOT NULL AND len({c}) = 64 AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform({c}, lambda x: abs(x))) > 0"
_CLOSING = "piece IN ('\"', '''', '»', '”', '’', ')', ']')"


def _near(field: str, name: str) -> str:
    return f"""SELECT '{field}' AS field, least(a, b) AS docid_a, greatest(a, b) AS docid_b FROM (
  SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM (
    SELECT x.docid AS a, y.docid AS b, round(list_cosine_similarity(x.v, y.v), 6) AS c FROM {name} x JOIN {name} y ON x.docid <> y.docid)) WHERE n <= 10 AND c >= 0.9"""


P1 = f"""WITH em AS (SELECT DISTINCT docid, CAST(embeds AS DOUBLE[]) AS v FROM doc_embeds WHERE {_VALID.format(c="embeds")}),
en AS (SELECT DISTINCT docid, CAST(encode AS DOUBLE[]) AS v FROM doc_encodes WHERE {_VALID.format(c="encode")})
SELECT DISTINCT * FROM ({_near("embeds", "em")} UNION ALL {_near("encode", "en")})"""

P3 = f"""WITH items AS (SELECT item_id, any_value(tokens.input_ids) AS ids FROM token_dataset WHERE tokens IS NOT NULL AND tokens.input_ids IS NOT NULL GROUP BY item_id),
t AS (SELECT item_id, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM items),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS p, count(*) OVER (PARTITION BY item_id) AS n, coalesce(v.piece, '') AS piece FROM t LEFT JOIN vocab v ON v.token_id = t.id WHERE t.id IS NOT NULL AND NOT coalesce(v.is_special, false)),
m AS (SELECT item_id, p, n, piece, lead(piece) OVER (PARTITION BY item_id ORDER BY p) AS next, last_value(CASE WHEN NOT ({_CLOSING}) THEN piece END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM r),
b AS (SELECT item_id, n, p FROM m WHERE p = n OR piece = chr(10) OR (ltrim(before, '▁') IN ('.', '!', '?', '…', '؟') AND (next LIKE '▁%' OR next = chr(10)))),
s AS (SELECT item_id, n, p - coalesce(lag(p) OVER (PARTITION BY item_id ORDER BY p), 0) AS stretch FROM b)
SELECT item_id, CASE WHEN max(stretch) > 510 THEN 'forced' ELSE 'natural' END AS cut_kind FROM s WHERE n > 510 GROUP BY item_id"""

_P4 = rf"""WITH {CODES},
t AS (SELECT query_id, min(ROW(coalesce(c.code, k), domain)) AS x FROM (SELECT query_id, source, {KEY} AS k FROM train WHERE regexp_matches(query, '[^\s\p{{Z}}]')) q LEFT JOIN codes c ON q.k = c.name LEFT JOIN (SELECT source, min(domain) AS domain FROM sources GROUP BY source) d ON d.source = q.source GROUP BY query_id),
l AS (SELECT x[1] AS lang, x[2] AS domain, count(*) AS n FROM t GROUP BY 1, 2),
a AS (SELECT CAST(count(*) AS BIGINT) AS n FROM t),
r AS (SELECT plan_id, s.lang, target_pct, min_rows, coalesce((SELECT CAST(sum(l.n) AS BIGINT) FROM l WHERE l.lang = s.lang), 0) AS n_available, greatest((target_pct * sample_pct * a.n + 9999) // 10000, min_rows) AS n_target FROM (SELECT DISTINCT * FROM sample_targets) s CROSS JOIN a)
"""

_P6 = rf"""WITH RECURSIVE {CODES},
special AS (SELECT list(token_id) AS ids FROM vocab WHERE is_special),
i AS (SELECT item_id, any_value(q_id) AS q_id, any_value(source) AS source, any_value(k) AS k, max(n) AS n FROM (SELECT item_id, q_id, source, {KEY} AS k, len(list_filter(tokens.input_ids, lambda x: x IS NOT NULL AND NOT list_contains(ids, x))) AS n FROM token_dataset, special) GROUP BY item_id),
x AS (SELECT DISTINCT docid, text FROM corpus_df WHERE docid IN (SELECT q_id FROM i WHERE n IS NULL) AND text IS NOT NULL),
w AS (SELECT docid, unnest(list_filter(string_split_regex(text, '\s+'), lambda s: s <> '')) AS word FROM x),
g AS (SELECT DISTINCT '▁' || word AS word, 0 AS n, CAST(1 AS BIGINT) AS at FROM w
  UNION ALL SELECT g.word, g.n + 1, g.at + coalesce(max(length(v.piece)), 1) FROM g LEFT JOIN vocab v ON NOT v.is_special AND starts_with(substr(g.word, g.at), v.piece) WHERE g.at <= length(g.word) GROUP BY g.word, g.n, g.at),
c AS (SELECT word, max(n) AS n FROM g GROUP BY word),
ws AS (SELECT w.docid, sum(c.n) AS n FROM w JOIN c ON c.word = '▁' || w.word GROUP BY w.docid),
e AS (SELECT x.docid, length(x.text) - length(replace(x.text, chr(10), '')) + coalesce(ws.n, 0) AS n FROM x LEFT JOIN ws ON ws.docid = x.docid),
f AS (SELECT i.source, coalesce(codes.code, i.k) AS lang, i.n, e.n AS est FROM i LEFT JOIN e ON i.n IS NULL AND e.docid = i.q_id LEFT JOIN codes ON codes.name = i.k),
d AS (SELECT source, min(domain) AS domain FROM sources GROUP BY source),
b AS (SELECT f.source, d.domain, f.lang, count(*) AS n_items, CAST(sum(coalesce(f.n, f.est, 0)) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN f.n IS NULL THEN coalesce(f.est, 0) ELSE 0 END) AS BIGINT) AS n_estimated FROM f LEFT JOIN d ON d.source = f.source GROUP BY f.source, d.domain, f.lang)
"""

_P9 = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS l FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]'))
SELECT doc_id, len(w) AS n_words, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 6) AS mean_word_length, round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…؟。]["''»”)\]]*[\s\p{Z}]*$'))) / len(l), 6) AS end_punctuation_share FROM t"""

SQL = {
    "p1_found": P1,
    "p3_found": P3,
    "p4_found": _P4 + "SELECT plan_id, lang FROM r WHERE n_available < n_target",
    "p4_report": _P4 + "SELECT *, least(n_target, n_available) AS n_drawn, greatest(n_target - n_available, 0) AS short, n_available < n_target AS unmet FROM r",
    "p4_shares": _P4 + "SELECT plan_id, r.lang, domain, n AS n_rows, TRUE AS fair FROM r JOIN l ON l.lang = r.lang",
    "p7_rules": "SELECT doc_id, TRUE AS kept FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL",
    "p9_counts": _P9,
    "p8_rules": "SELECT DISTINCT mix_id, source, weight_pct, max_repeats, TRUE AS kept FROM mix_targets",
    "p6_totals": _P6 + "SELECT * FROM b",
    "p6_rollup": _P6 + "SELECT slice, name, CAST(sum(n_items) AS BIGINT) AS n_items, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM (SELECT 'source' AS slice, source AS name, n_items, n_tokens FROM b UNION ALL SELECT 'lang', lang, n_items, n_tokens FROM b UNION ALL SELECT 'domain', domain, n_items, n_tokens FROM b UNION ALL SELECT 'all', 'all', n_items, n_tokens FROM b) GROUP BY slice, name",
}
