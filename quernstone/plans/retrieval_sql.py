"""The retrieval queries in DuckDB's SQL, on the same tables."""

from __future__ import annotations

from quernstone.functions.text import ARABIC_MARKS, ARABIC_PUNCTUATION
from quernstone.operators.analyze import STOP_WORDS
from quernstone.operators.index import TUNED

_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(c: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({c}, {_lit(pattern)}, {_lit(by)}, 'g')"


def _cleaned(c: str, run: int) -> str:
    no_urls = _replace(c, rf"https?://[^{_SPACE}]+|www\.[^{_SPACE}]+")
    no_runs = _replace(no_urls, rf"[^\p{{L}}\p{{N}}_{_SPACE}]{{{run},}}")
    return no_runs


def _collapsed(c: str) -> str:
    return f"trim({_replace(c, rf'[{_SPACE}]+')}, ' ')"


LEXICAL = f"lower({_collapsed(_cleaned('text', 4))})"
DENSE = _collapsed(_cleaned("text", 10))
_UNMARKED = f"translate({_cleaned('text', 4)}, {_lit(ARABIC_PUNCTUATION)}, '')"
ARABIC = _replace(f"lower({_collapsed(_UNMARKED)})", ARABIC_MARKS, "")
WORDS = r"list_filter(string_split_regex(clean, '[^\p{L}\p{N}_]+'), lambda w: w <> '')"

DOCS = f"""docs AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents),
toks AS (SELECT doc_id, lang, {WORDS} AS tokens FROM (SELECT doc_id, lang, CASE WHEN lang = 'ar' THEN {ARABIC} ELSE {LEXICAL} END AS clean FROM docs))"""
CORPUS = f"""docs AS (SELECT DISTINCT docid AS doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM corpus_df),
toks AS (SELECT doc_id, lang, {WORDS} AS tokens FROM (SELECT doc_id, lang, {LEXICAL} AS clean FROM docs))"""
TF = """tf AS (SELECT lang, doc_id, dl, term, count(*) AS tf FROM (SELECT lang, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL),
stats AS (SELECT lang, count(*) AS n_docs, avg(CAST(len(tokens) AS DOUBLE)) AS avgdl FROM toks GROUP BY ALL)"""
IDF = "ln((n_docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)) + 1)"


def _weight(k1: str, b: str) -> str:
    k1, b = f"CAST({k1} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"


def _index(k1: str = "1.5", b: str = "0.75") -> str:
    return f"""widf AS (SELECT tf.lang, tf.doc_id, tf.dl, tf.term, tf.tf, n_docs, avgdl, {IDF} AS idf FROM tf JOIN df ON tf.lang = df.lang AND tf.term = df.term JOIN stats ON tf.lang = stats.lang),
bm25 AS (SELECT lang, doc_id, term, tf, {_weight(k1, b)} AS weight FROM widf)"""


QUERIES = """q AS (SELECT doc_id AS query_id, lang, list_slice(tokens, 3, 8) AS terms FROM toks WHERE doc_id % 20 = 0),
qt AS (SELECT query_id, lang, term, count(*) AS qtf FROM (SELECT query_id, lang, unnest(terms) AS term FROM q) GROUP BY ALL)"""
SCORES = "scored AS (SELECT qt.query_id, qt.lang, bm25.doc_id, round(sum(qtf * weight), 6) AS score FROM qt JOIN bm25 ON qt.lang = bm25.lang AND qt.term = bm25.term GROUP BY ALL)"
TFIDF = """tw AS (SELECT tf.lang, tf.doc_id, tf.term, tf.tf, ln(CAST(n_docs AS DOUBLE) / df) AS idf FROM tf JOIN df ON tf.lang = df.lang AND tf.term = df.term JOIN stats ON tf.lang = stats.lang),
tn AS (SELECT lang, doc_id, sqrt(sum((tf * idf) * (tf * idf))) AS n FROM tw GROUP BY ALL),
tfidf AS (SELECT tw.lang, tw.doc_id, term, tf, CASE WHEN n > 0 THEN tf * idf / n ELSE 0 END AS weight FROM tw JOIN tn ON tw.lang = tn.lang AND tw.doc_id = tn.doc_id)"""
TSCORES = """tidf AS (SELECT df.lang, df.term, ln(CAST(n_docs AS DOUBLE) / df) AS idf FROM df JOIN stats ON df.lang = stats.lang),
qw AS (SELECT qt.query_id, qt.lang, qt.term, qtf * idf AS w FROM qt JOIN tidf ON qt.lang = tidf.lang AND qt.term = tidf.term),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY ALL),
tscored AS (SELECT qw.query_id, qw.lang, tfidf.doc_id, round(sum(CASE WHEN n > 0 THEN w / n ELSE 0 END * weight), 6) AS score FROM qw JOIN qn ON qw.query_id = qn.query_id JOIN tfidf ON qw.lang = tfidf.lang AND qw.term = tfidf.term GROUP BY ALL)"""


def _top(name: str, scored: str, k: int = 10) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {scored}) WHERE rank <= {k})"


def _padded(name: str, scored: str, k: int = 10) -> str:
    return f"""{name}_fill AS (SELECT q.query_id, q.lang, d.doc_id, CAST(0 AS DOUBLE) AS score FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM toks) d ON q.lang = d.lang AND d.n <= {k}),
{name}_all AS (SELECT query_id, lang, doc_id, max(score) AS score FROM (SELECT query_id, lang, doc_id, score FROM {scored} UNION ALL SELECT * FROM {name}_fill) GROUP BY ALL),
{_top(name, name + "_all", k)}"""


FUSED = """fpos AS (SELECT query_id, lang, doc_id, CASE WHEN rank <= 9 THEN rank ELSE rank + 9 END AS pos FROM b10 UNION ALL SELECT query_id, lang, doc_id, rank + 9 FROM t10 WHERE rank <= 9),
fused AS (SELECT * FROM (SELECT query_id, lang, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS rank FROM fpos GROUP BY query_id, lang, doc_id) WHERE rank <= 10)"""
RANKS = """target AS (SELECT q.query_id, q.lang, coalesce(s.score, 0) AS target FROM q LEFT JOIN scored s ON q.query_id = s.query_id AND s.doc_id = q.query_id),
ranks AS (SELECT t.query_id, t.lang, t.target AS score, CASE WHEN t.target > 0 THEN (SELECT count(*) FROM scored s WHERE s.query_id = t.query_id AND s.score >= t.target) ELSE n_docs END AS rank FROM target t JOIN stats ON t.lang = stats.lang)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _accuracy(name: str) -> str:
    return f"SELECT q.lang, count(*) AS n_queries, round(avg(CASE WHEN h.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS accuracy FROM q LEFT JOIN {name} h ON q.query_id = h.query_id AND h.doc_id = q.query_id GROUP BY q.lang"


def _stop_rows() -> str:
    return ", ".join(f"({_lit(lang)}, {_lit(w)})" for lang, line in STOP_WORDS.items() for w in line.split())


_B10 = (DOCS, TF, _index(), QUERIES, SCORES, _padded("b10", "scored"))
_T10 = (TFIDF, TSCORES, _padded("t10", "tscored"))
_TUNED_K1 = "CASE lang " + " ".join(f"WHEN '{x}' THEN {p[0]}" for x, p in TUNED.items()) + " ELSE 1.5 END"
_TUNED_B = "CASE lang " + " ".join(f"WHEN '{x}' THEN {p[1]}" for x, p in TUNED.items()) + " ELSE 0.75 END"
_DEV = """q AS (SELECT query_id, lang, list_filter(string_split_regex(clean, '[^\\p{L}\\p{N}_]+'), lambda w: w <> '') AS terms, positive_docs FROM (SELECT query_id, lang, positive_docs, """ + LEXICAL + """ AS clean FROM (SELECT DISTINCT query_id, coalesce(lang, 'und') AS lang, coalesce(query, '') AS text, positive_docs FROM dev))),
qt AS (SELECT query_id, lang, term, count(*) AS qtf FROM (SELECT query_id, lang, unnest(terms) AS term FROM q) GROUP BY ALL)"""
_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({k1} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (k1, b) in enumerate((k1, b) for k1 in (1.2, 1.5, 2.0) for b in (0.0, 0.75, 1.0))) + ") g(grid_pos, k1, b))"
_GRID_RECALL = f"""{_GRID},
gs AS (SELECT grid_pos, k1, b, qt.query_id, qt.lang, widf.doc_id, round(sum(qtf * (idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))), 6) AS score FROM qt JOIN widf ON qt.lang = widf.lang AND qt.term = widf.term, grid GROUP BY ALL),
gt AS (SELECT grid.grid_pos, grid.k1, grid.b, q.query_id, q.lang, coalesce(s.score, 0) AS target FROM q, grid LEFT JOIN gs s ON s.grid_pos = grid.grid_pos AND s.query_id = q.query_id AND s.doc_id = q.query_id),
ga AS (SELECT gt.grid_pos, gt.query_id, count(*) AS n FROM gt JOIN gs ON gs.grid_pos = gt.grid_pos AND gs.query_id = gt.query_id AND gs.score >= gt.target WHERE gt.target > 0 GROUP BY ALL),
recall AS (SELECT gt.lang, gt.grid_pos, gt.k1, gt.b, round(avg(CASE WHEN coalesce(ga.n, n_docs) <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, 10 AS k FROM gt LEFT JOIN ga ON ga.grid_pos = gt.grid_pos AND ga.query_id = gt.query_id JOIN stats ON stats.lang = gt.lang GROUP BY gt.lang, gt.grid_pos, gt.k1, gt.b)"""
_CHUNKS = f"""WITH RECURSIVE w AS (SELECT doc_id, words, len(words) AS n, list_transform(list_filter(range(1, len(words) + 1), lambda i: regexp_matches(words[i], '[.!?]$')), lambda i: i - 1) AS ends
  FROM (SELECT doc_id, CASE WHEN clean = '' THEN [] ELSE string_split(clean, ' ') END AS words FROM (SELECT doc_id, {DENSE} AS clean FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))),
c AS (
  SELECT doc_id, 1 AS chunk_no, CAST(0 AS BIGINT) AS s, CASE WHEN l > 0 AND 270 - l <= 30 THEN l + 1 ELSE 270 END AS e, n FROM (SELECT doc_id, n, coalesce(list_max(list_filter(ends, lambda x: x < 270)), 0) AS l FROM w WHERE n > 0)
  UNION ALL
  SELECT doc_id, chunk_no + 1, s, CASE WHEN l > 0 AND 270 - l <= 30 THEN s + l + 1 ELSE s + 270 END, n FROM (
    SELECT doc_id, chunk_no, s, n, coalesce(list_max(list_filter(ends, lambda x: x >= s AND x < s + 270)) - s, 0) AS l FROM (
      SELECT doc_id, chunk_no, n, ends, CASE WHEN f IS NOT NULL AND f - s0 < 30 THEN f + 1 ELSE s0 END AS s FROM (
        SELECT w.doc_id, c.chunk_no, w.n, w.ends, c.e - 130 AS s0, list_min(list_filter(w.ends, lambda x: x >= c.e - 130 AND x < c.e + 140)) AS f FROM c JOIN w ON c.doc_id = w.doc_id WHERE c.e < c.n)) WHERE s < n))
SELECT c.doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start_word, CAST(least(e, c.n) AS INTEGER) AS end_word, array_to_string(list_slice(words, s + 1, least(e, c.n)), ' ') AS chunk FROM c JOIN w ON c.doc_id = w.doc_id"""
_VALID = "{c} IS NOT NULL AND len({c}) = 64 AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x))) = 0 AND list_sum(list_transform({c}, lambda x: abs(x))) > 0"
_PAIRS = f"""t AS (SELECT DISTINCT query_id, lang, positive_docs, negative_docs FROM train),
pairs AS (SELECT query_id, lang, trim(positive_docs) AS doc_id, true AS is_positive FROM t WHERE trim(positive_docs) NOT IN ('', '[]')
  UNION ALL SELECT query_id, lang, x[2:len(x) - 1], false FROM (SELECT query_id, lang, unnest(list_filter(string_split(regexp_replace(coalesce(negative_docs, ''), '^\\[|\\]$', '', 'g'), ', '), lambda x: x <> '')) AS x FROM t))"""
_ENC = f"""em AS (SELECT DISTINCT docid, CAST(embeds AS DOUBLE[]) AS v FROM doc_embeds WHERE {_VALID.format(c="embeds")}),
en AS (SELECT DISTINCT docid, CAST(encode AS DOUBLE[]) AS v FROM doc_encodes WHERE {_VALID.format(c="encode")})"""
_LOSS = """scored AS (SELECT p.query_id, p.is_positive, list_cosine_similarity(em.v, en.v) AS cosine FROM pairs p JOIN pairs o ON o.query_id = p.query_id AND o.is_positive JOIN em ON em.docid = o.doc_id JOIN en ON en.docid = p.doc_id),
loss AS (SELECT query_id, ln(sum(exp(cosine)) / sum(CASE WHEN is_positive THEN exp(cosine) ELSE 0 END)) AS loss FROM scored GROUP BY query_id HAVING bool_or(is_positive))"""
_DENSE = """qv AS (SELECT vec_id AS query_id, label AS lang, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
dv AS (SELECT vec_id AS doc_id, label AS lang, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dscored AS (SELECT query_id, qv.lang, doc_id, round(list_cosine_similarity(qv.v, dv.v), 6) AS score FROM qv JOIN dv ON qv.lang = dv.lang)"""


def _chunk_agg(f: str) -> str:
    return _with(_DENSE, _top("d10", "dscored", 100)) + f"SELECT query_id, doc_id // 4 AS doc_id, round({f}(score), 8) AS score FROM d10 GROUP BY ALL"




def _layer(x: str, a: int, b: int, n: int) -> str:
    """``b`` numbers from the ``a`` of ``x``: weights are sines and offsets cosines of their places."""
    return f"list_transform(range(1, {b + 1}), lambda j: list_sum(list_transform(range(1, {a + 1}), lambda i: {x}[i] * sin(i * 7 + j * 3 + {n}) / 4)) + cos(j * 5 + {n}) / 4)"


def _encoded(name: str, rows: str, x: str, shift: int = 0) -> str:
    """Tables that take ``id, v`` of ``rows`` through the encoder; ``name`` has ``id, y``."""
    relu = "lambda z: greatest(z, 0::DOUBLE)"
    unit = "list_transform(u, lambda z: CASE WHEN sqrt(list_sum(list_transform(u, lambda w: w * w))) > 0 THEN z / sqrt(list_sum(list_transform(u, lambda w: w * w))) ELSE 0 END)"
    return f"""{name}0 AS (SELECT vec_id AS id, list_transform({x}, lambda z: CAST(z AS DOUBLE)) AS v FROM {rows}),
{name}1 AS (SELECT id, v, list_transform({_layer("v", 64, 8, 1 + shift)}, {relu}) AS h FROM {name}0),
{name}2 AS (SELECT id, list_transform(list_zip(v, {_layer("h", 8, 64, 2 + shift)}), lambda z: z[1] + z[2]) AS u FROM {name}1),
{name}3 AS (SELECT id, {unit} AS v FROM {name}2),
{name}4 AS (SELECT id, list_transform({_layer("v", 64, 8, 3 + shift)}, {relu}) AS h FROM {name}3),
{name}5 AS (SELECT id, {_layer("h", 8, 64, 4 + shift)} AS u FROM {name}4),
{name} AS (SELECT id, {unit} AS y FROM {name}5)"""

SQL: dict[str, str] = {
    "clean_lexical": f"SELECT doc_id, {LEXICAL} AS clean FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "clean_dense": f"SELECT doc_id, {DENSE} AS clean FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "arabic_normalize": f"SELECT doc_id, {ARABIC} AS clean FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE lang = 'ar')",
    "tokenize_words": _with(DOCS) + "SELECT doc_id, lang, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM toks",
    "remove_stop_words": _with(DOCS, f"stop AS (SELECT lang, list(word) AS words FROM (VALUES {_stop_rows()}) s(lang, word) GROUP BY lang)") + "SELECT doc_id, toks.lang, array_to_string(list_filter(tokens, lambda w: NOT coalesce(list_contains(words, w), false)), ' ') AS tokens FROM toks LEFT JOIN stop ON toks.lang = stop.lang",
    "split_compounds": _with(DOCS) + "SELECT doc_id, array_to_string(flatten(list_transform(tokens, lambda w: CASE WHEN length(w) > 5 THEN string_split(regexp_replace(w, '([aeiouyäöü])([^aeiouyäöü][aeiouyäöü])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [w] END)), ' ') AS parts FROM toks WHERE lang = 'de'",
    "chunk_documents": _CHUNKS,
    "token_windows": "SELECT item_id, len(w) AS n_windows, list_sum(list_transform(w, lambda x: len(x)))::BIGINT AS n_ids FROM (SELECT item_id, list_transform(range(0, greatest(len(ids), 1), 510), lambda i: list_concat([1], list_concat(list_slice(ids, i + 1, i + 510), [2]))) AS w FROM (SELECT DISTINCT item_id, tokens.input_ids AS ids FROM token_dataset WHERE tokens IS NOT NULL AND tokens.input_ids IS NOT NULL))",
    "explode_windows": "SELECT item_id, lang, CAST(i // 510 + 1 AS INTEGER) AS window_no, array_to_string(list_concat([1], list_concat(list_slice(ids, i + 1, i + 510), [2])), ' ') AS ids FROM (SELECT item_id, lang, ids, unnest(range(0, greatest(len(ids), 1), 510)) AS i FROM (SELECT DISTINCT item_id, lang, tokens.input_ids AS ids FROM token_dataset WHERE tokens IS NOT NULL AND tokens.input_ids IS NOT NULL))",
    "pad_windows": "SELECT item_id, array_to_string(list_concat(f, list_transform(range(0, 512 - len(f)), lambda i: 0)), ' ') AS ids, len(f) AS n_real FROM (SELECT item_id, list_concat([1], list_concat(list_slice(ids, 1, 510), [2])) AS f FROM (SELECT DISTINCT item_id, tokens.input_ids AS ids FROM token_dataset WHERE tokens IS NOT NULL AND tokens.input_ids IS NOT NULL))",
    "vocabulary": _with(DOCS, TF) + "SELECT lang, term FROM df",
    "term_frequency": _with(DOCS, TF) + "SELECT lang, doc_id, dl, term, tf FROM tf",
    "document_frequency": _with(DOCS, TF) + "SELECT lang, term, df FROM df",
    "doc_length_stats": _with(DOCS, TF) + "SELECT lang, n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_idf": _with(DOCS, TF) + f"SELECT df.lang, term, df, round({IDF}, 6) AS idf FROM df JOIN stats ON df.lang = stats.lang",
    "bm25_index": _with(DOCS, TF, _index()) + "SELECT lang, doc_id, term, tf, round(weight, 6) AS weight FROM bm25",
    "bm25_index_tuned": _with(DOCS, TF, _index(_TUNED_K1, _TUNED_B)) + "SELECT lang, doc_id, term, tf, round(weight, 6) AS weight FROM bm25",
    "tfidf_idf": _with(DOCS, TF) + "SELECT df.lang, term, df, round(ln(CAST(n_docs AS DOUBLE) / df), 6) AS idf FROM df JOIN stats ON df.lang = stats.lang",
    "tfidf_tf_norm": _with(DOCS, TF, "norms AS (SELECT toks.lang, toks.doc_id, sqrt(coalesce(sum(tf.tf * tf.tf), 0)) AS norm FROM toks LEFT JOIN tf ON toks.doc_id = tf.doc_id AND toks.lang = tf.lang GROUP BY ALL)", "med AS (SELECT lang, median(norm) AS m FROM norms GROUP BY lang)") + "SELECT tf.lang, tf.doc_id, term, tf, round(tf / (CAST(0.5 AS DOUBLE) * m + CAST(0.5 AS DOUBLE) * norm), 6) AS norm_tf FROM tf JOIN norms ON tf.doc_id = norms.doc_id AND tf.lang = norms.lang JOIN med ON tf.lang = med.lang",
    "tfidf_index": _with(DOCS, TF, TFIDF) + "SELECT lang, doc_id, term, tf, round(weight, 6) AS weight FROM tfidf",
    "df_filter": _with(DOCS, TF) + "SELECT df.lang, term, df FROM df JOIN stats ON df.lang = stats.lang WHERE df >= 3 AND df <= n_docs * CAST(0.5 AS DOUBLE)",
    "bm25_scores": _with(DOCS, TF, _index(), QUERIES, SCORES) + "SELECT query_id, lang, doc_id, score FROM scored",
    "bm25_top_k": _with(DOCS, TF, _index(), QUERIES, SCORES, _top("b10", "scored")) + "SELECT query_id, lang, doc_id, score, rank FROM b10",
    "bm25_top_k_padded": _with(*_B10) + "SELECT query_id, lang, doc_id, score, rank FROM b10",
    "bm25_saved_index": _with(DOCS, TF, _index(_TUNED_K1, _TUNED_B), QUERIES, SCORES, _padded("b10", "scored")) + "SELECT query_id, lang, doc_id, score, rank FROM b10",
    "bm25_match_and_eval": _with(DOCS, TF, _index(), QUERIES, SCORES, RANKS) + "SELECT query_id, lang, score, rank FROM ranks",
    "tfidf_top_k": _with(DOCS, TF, QUERIES, *_T10) + "SELECT query_id, lang, doc_id, score, rank FROM t10",
    "fused_top_k": _with(*_B10, *_T10, FUSED) + "SELECT query_id, lang, doc_id, rank FROM fused",
    "hit_list": _with(*_B10) + "SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS docids FROM b10 GROUP BY query_id",
    "scatter_results": _with(*_B10) + "SELECT q.query_id, q.lang, len(q.terms) AS n_terms, h.docids FROM q LEFT JOIN (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS docids FROM b10 GROUP BY query_id) h ON q.query_id = h.query_id",
    "accuracy_bm25": _with(*_B10) + _accuracy("b10"),
    "accuracy_tfidf": _with(DOCS, TF, QUERIES, *_T10) + _accuracy("t10"),
    "accuracy_fused": _with(*_B10, *_T10, FUSED) + _accuracy("fused"),
    "recall_at_k": _with(DOCS, TF, _index(), QUERIES, SCORES, RANKS) + "SELECT lang, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, 10 AS k FROM ranks GROUP BY lang",
    "bm25_grid": _with(DOCS, TF, _index(), QUERIES, _GRID_RECALL) + "SELECT lang, grid_pos, k1, b, recall, k FROM recall",
    "best_params": _with(DOCS, TF, _index(), QUERIES, _GRID_RECALL) + "SELECT lang, grid_pos, k1, b, recall, k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY recall DESC, grid_pos) AS n FROM recall) WHERE n = 1",
    "passage_search": _with(CORPUS, TF, _index(), _DEV, SCORES, _padded("b10", "scored")) + "SELECT query_id, lang, doc_id, score, rank FROM b10",
    "stream_passage_search": _with(CORPUS, TF, _index(), _DEV, SCORES, _padded("b10", "scored")) + "SELECT query_id, lang, doc_id, score, rank FROM b10",
    "accuracy_corpus": _with(CORPUS, TF, _index(), _DEV, SCORES, _padded("b10", "scored")) + "SELECT count(*) AS n_queries, round(avg(CASE WHEN h.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS accuracy FROM q LEFT JOIN b10 h ON q.query_id = h.query_id AND h.doc_id = q.positive_docs",
    "accuracy_first_queries": _with(CORPUS, TF, _index(), _DEV, SCORES, _padded("b10", "scored")) + "SELECT count(*) AS n_queries, round(avg(CASE WHEN h.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS accuracy FROM q LEFT JOIN b10 h ON q.query_id = h.query_id AND h.doc_id = q.positive_docs WHERE q.query_id IN (SELECT DISTINCT query_id FROM dev ORDER BY query_id LIMIT 100)",
    "bm25_full_ranking": _with(DOCS, TF, _index(), QUERIES, SCORES) + "SELECT q.query_id, q.lang, t.doc_id, coalesce(s.score, 0) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(s.score, 0) DESC, t.doc_id) AS rank FROM q JOIN toks t ON t.lang = q.lang LEFT JOIN scored s ON s.query_id = q.query_id AND s.doc_id = t.doc_id",
    "corpus_json": "SELECT DISTINCT docid, text, lang FROM corpus_df",
    "queries_csv": "SELECT DISTINCT query, lang, positive_docs, negative_docs FROM dev WHERE coalesce(query, 'x') <> '' AND coalesce(lang, 'x') <> '' AND coalesce(positive_docs, 'x') <> '' AND coalesce(negative_docs, 'x') <> ''",
    "tuning_csv": _with(DOCS, TF, _index(), QUERIES, _GRID_RECALL) + "SELECT lang, k1, b, recall FROM recall",
    "results_csv": _with(*_B10) + "SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS docids FROM b10 GROUP BY query_id",
    "stop_words_file": _with(DOCS, TF, "stop AS (SELECT list(term) AS words FROM (SELECT term FROM df WHERE lang = 'en' ORDER BY df DESC, term LIMIT 50))") + "SELECT doc_id, array_to_string(list_filter(tokens, lambda w: NOT coalesce(list_contains(words, w), false)), ' ') AS tokens FROM toks CROSS JOIN stop WHERE lang = 'en'",
    "encoder_forward": "WITH " + _encoded("e", "embeddings", "embedding") + " SELECT id AS vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS i, round(unnest(y), 4) AS x FROM e",
    "two_tower_scores": "WITH " + _encoded("e", "embeddings", "embedding") + ",\n" + _encoded("f", "embeddings", "embedding", 9) + " SELECT e.id AS vec_id, round(list_cosine_similarity(e.y, f.y), 4) AS score FROM e JOIN f ON f.id = e.id + 1",
    "language_filter": "SELECT doc_id, text FROM documents WHERE lang = 'en'",
    "split_floor": "SELECT doc_id, lang, CAST(CASE WHEN n // 4 = 0 THEN 4 ELSE least(4, 1 + rn // nullif(n // 4, 0)) END AS INTEGER) AS shard FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, count(*) OVER (PARTITION BY coalesce(lang, 'und')) AS n, row_number() OVER (PARTITION BY coalesce(lang, 'und') ORDER BY doc_id) - 1 AS rn FROM documents)",
    "split_ceil": "SELECT doc_id, CAST(1 + rn // (n // 12 + 1) AS INTEGER) AS shard FROM (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)",
    "merge_shards": "SELECT query_id, lang, 0 AS shard_no FROM train UNION ALL SELECT query_id, lang, 1 FROM dev UNION ALL SELECT query_id, lang, 2 FROM test",
    "merge_last_wins": "SELECT docid, lang, source, n_chars FROM (SELECT docid, lang, source, coalesce(length(text), 0) AS n_chars, row_number() OVER (PARTITION BY docid ORDER BY loaded_at DESC) AS n FROM corpus_df) WHERE n = 1",
    "parse_negatives": _with(_PAIRS) + "SELECT query_id, doc_id FROM pairs WHERE NOT is_positive",
    "training_pairs": _with(_PAIRS) + "SELECT query_id, lang, doc_id, is_positive FROM pairs",
    "upsample_balance": """WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang FROM documents), c AS (SELECT lang, count(*) AS n FROM d GROUP BY lang), m AS (SELECT max(n) AS most FROM c),
draws AS (SELECT lang, copy, (copy * 48271 + 7) % n AS at FROM (SELECT lang, n, unnest(range(1, most - n + 1)) AS copy FROM c, m)),
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM d)
SELECT doc_id, lang, CAST(0 AS BIGINT) AS copy FROM d UNION ALL SELECT p.doc_id, p.lang, copy FROM draws JOIN p ON p.lang = draws.lang AND p.place = draws.at""",
    "flatten_vectors": f"SELECT docid, lang, len(embeds) AS width FROM (SELECT DISTINCT docid, lang, embeds FROM doc_embeds WHERE {_VALID.format(c='embeds')})",
    "l2_normalize": "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(v[i] / n, 6) AS x FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))",
    "inner_product": f"SELECT DISTINCT em.docid, round(list_inner_product(em.v, en.v), 5) AS product FROM ({_with(_ENC)} SELECT * FROM em) em JOIN ({_with(_ENC)} SELECT * FROM en) en ON em.docid = en.docid",
    "cosine_pairs": f"SELECT DISTINCT em.docid, round(list_cosine_similarity(em.v, en.v), 6) AS cosine FROM ({_with(_ENC)} SELECT * FROM em) em JOIN ({_with(_ENC)} SELECT * FROM en) en ON em.docid = en.docid",
    "masked_mean_pool": "SELECT vec_id, CAST(i AS INTEGER) AS i, round(avg(v[p * 8 + i + 1]), 6) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, unnest(range(0, vec_id % 8 + 1)) AS p FROM embeddings), (SELECT unnest(range(0, 8)) AS i) GROUP BY vec_id, i",
    "first_position": "SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(0, 8)) AS i)",
    "doc_mean_vector": "SELECT vec_id // 4 AS doc_id, CAST(i - 1 AS INTEGER) AS i, round(avg(v[i]), 6) AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) GROUP BY ALL",
    "dense_top_k": _with(_DENSE, _top("d10", "dscored")) + "SELECT query_id, lang, doc_id, score, rank FROM d10",
    "dense_saved_index": _with(_DENSE, _top("d10", "dscored")) + "SELECT query_id, lang, doc_id, score, rank FROM d10",
    "chunk_to_doc_mean": _chunk_agg("avg"),
    "chunk_to_doc_sum": _chunk_agg("sum"),
    "chunk_to_doc_max": _chunk_agg("max"),
    "nll_loss": _with(_PAIRS, _ENC, _LOSS) + "SELECT query_id, round(loss, 6) AS loss FROM loss",
    "mean_nll_loss": _with(_PAIRS, _ENC, _LOSS) + "SELECT count(*) AS n_queries, round(avg(loss), 6) AS loss FROM loss",
}
