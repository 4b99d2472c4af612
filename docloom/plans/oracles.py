"""DuckDB SQL that states what the fixture queries return."""

from __future__ import annotations

from ..config import SECTIONS, STOP_WORDS, WEIGHTS
from .fixture import ASKED

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[а-яёa-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


DOCS = f"""
l AS (SELECT doc_id AS doc_idx, coalesce(text, '') AS text, coalesce(lang, '') AS court, coalesce(source, '') AS channel, md5(lower(trim(text, ' '))) AS case_id, CAST(2018 + doc_id % 9 AS INTEGER) AS year, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
d AS (SELECT doc_idx, text, court, channel, case_id, year, coalesce(a[1], '') AS title, coalesce(a[2], '') AS vs, coalesce(a[3], '') AS fabula, coalesce(array_to_string(a[4:], chr(10)), '') AS residual FROM l),
w0 AS (SELECT doc_idx, {tok("title")} AS lt, {tok("vs")} AS lv0, {tok("fabula")} AS lf, {tok("residual")} AS lr, {tok("court || ' ' || channel")} AS lg FROM d),
w1 AS (SELECT *, CASE WHEN len(lv0) = 0 AND len(lf) = 0 THEN lr ELSE lv0 END AS lv FROM w0),
w AS (SELECT doc_idx, lt, lf, lv, lg, list_concat(list_concat(lt, lf), list_concat(lv, lr)) AS lfull FROM w1),
sw AS (SELECT section, doc_idx, CASE WHEN len(words) = 0 THEN [''] ELSE words END AS words FROM (
  SELECT 'title' AS section, doc_idx, lt AS words FROM w UNION ALL SELECT 'fabula', doc_idx, lf FROM w UNION ALL SELECT 'vs_position', doc_idx, lv FROM w
  UNION ALL SELECT 'full', doc_idx, lfull FROM w UNION ALL SELECT 'tags', doc_idx, lg FROM w))"""

STATS = """
dl AS (SELECT section, doc_idx, len(words) AS dl FROM sw),
sz AS (SELECT section, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY section),
tf AS (SELECT section, term, doc_idx, count(*) AS tf FROM (SELECT section, doc_idx, unnest(words) AS term FROM sw) GROUP BY ALL),
df AS (SELECT section, term, count(*) AS df FROM tf GROUP BY ALL),
i0 AS (SELECT df.section, term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM df JOIN sz ON df.section = sz.section),
ep AS (SELECT section, 0.25 * avg(idf0) AS eps, avg(idf0) AS avg_idf FROM i0 GROUP BY section),
ts AS (SELECT i0.section, term, df, CASE WHEN idf0 < 0 THEN eps ELSE idf0 END AS idf FROM i0 JOIN ep ON i0.section = ep.section)"""

_Q = "q(query_id, query, vec) AS (VALUES " + ", ".join(f"({i}, '{t}', {v})" for i, t, v in ASKED) + ")"
_W = "wt(section, weight) AS (VALUES " + ", ".join(f"('{s}', CAST({WEIGHTS[s]} AS DOUBLE))" for s in SECTIONS) + ")"

LEX = f"""
{_Q}, {_W},
ql AS (SELECT query_id, {tok("query")} AS words FROM q),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(words) AS term FROM ql) GROUP BY ALL),
part AS (SELECT query_id, tf.section, tf.doc_idx, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM qt JOIN tf ON tf.term = qt.term JOIN ts ON ts.section = tf.section AND ts.term = tf.term JOIN dl ON dl.section = tf.section AND dl.doc_idx = tf.doc_idx JOIN sz ON sz.section = tf.section GROUP BY ALL),
lex AS (SELECT query_id, doc_idx, sum(weight * s) AS score FROM part JOIN wt ON wt.section = part.section GROUP BY ALL HAVING sum(weight * s) > 0)"""

SEM = """
sem AS (SELECT query_id, e.vec_id AS doc_idx, list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score
  FROM q JOIN embeddings v ON v.vec_id = q.vec, embeddings e WHERE e.vec_id IN (SELECT doc_idx FROM d)),
semp AS (SELECT * FROM sem WHERE score > 0)"""

FUSE = """
rl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM lex QUALIFY rank <= 100),
rs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM semp QUALIFY rank <= 100),
fu AS (SELECT query_id, doc_idx, sum(1.0 / (60 + rank)) * 1000 AS score, min(o) AS ord FROM (SELECT query_id, doc_idx, rank, CAST(rank AS DOUBLE) AS o FROM rl UNION ALL SELECT query_id, doc_idx, rank, 1e9 + rank FROM rs) GROUP BY ALL)"""


def _share(section: str) -> str:
    """Share of the query's neighbouring pairs that stand within three words of each other in a section."""
    at = lambda w: f"list_filter(range(1, len({section}) + 1), lambda i: {section}[i] = {w})"
    return f"len(list_filter(pairs, lambda p: len(list_filter({at('p.a')}, lambda x: len(list_filter({at('p.b')}, lambda y: abs(x - y) BETWEEN 1 AND 3)) > 0)) > 0)) / len(pairs)"


BOOST = f"""
qp AS (SELECT query_id, words, list_transform(range(1, len(words)), lambda i: {{'a': words[i], 'b': words[i + 1]}}) AS pairs FROM ql),
pr AS (SELECT fu.query_id, fu.doc_idx, CASE WHEN len(words) < 2 THEN 0.0 ELSE least(1.0, greatest(1.5 * {_share("lt")}, 1.5 * {_share("lv")}, {_share("lf")}, {_share("lfull")})) END AS prox
  FROM fu JOIN qp ON qp.query_id = fu.query_id JOIN w ON w.doc_idx = fu.doc_idx),
bo AS (SELECT fu.query_id, fu.doc_idx, ord, prox, fu.score * (1 + 0.30 * exp(-greatest(0, 2026 - year) / 4.0)) * CASE WHEN length(vs) > 0 THEN 1.10 ELSE 1.0 END * (1 + 0.5 * prox) AS score
  FROM fu JOIN pr ON pr.query_id = fu.query_id AND pr.doc_idx = fu.doc_idx JOIN d ON d.doc_idx = fu.doc_idx)"""


def sql(*ctes: str, then: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + then


_top = lambda rows: f"SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_idx, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM {rows}) WHERE rank <= 10"
_filtered = lambda cond: sql(DOCS, STATS, LEX, f"ok AS (SELECT lex.* FROM lex JOIN d ON d.doc_idx = lex.doc_idx WHERE {cond})", then=_top("ok"))

SNIPPET = """
s0 AS (SELECT doc_idx, replace(trim(coalesce(nullif(vs, ''), nullif(residual, ''), nullif(title, ''), ''), ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' ') AS b FROM d),
s1 AS (SELECT doc_idx, b, substr(b, 1, 250) AS h, instr(reverse(substr(b, 1, 250)), '.') AS back FROM s0)"""

ORACLES = {
    "tokenize_counts": sql(DOCS, then="SELECT doc_idx, CAST(len(lt) AS INTEGER) AS n_title, CAST(len(lfull) AS INTEGER) AS n_full, CAST(len(lg) AS INTEGER) AS n_tags FROM w"),
    "bm25_term_stats": sql(DOCS, STATS, then="SELECT section, term, df, round(idf, 6) AS idf FROM ts"),
    "bm25_section_stats": sql(DOCS, STATS, then="SELECT sz.section, n, round(avgdl, 6) AS avgdl, round(eps, 6) AS eps FROM sz JOIN ep ON ep.section = sz.section"),
    "bm25_topk": sql(DOCS, STATS, LEX, "one AS (SELECT query_id, doc_idx, s AS score FROM part WHERE section = 'full' AND s > 0)", then=_top("one")),
    "bm25_weighted_sections": sql(DOCS, STATS, LEX, then=_top("lex")),
    "filter_court": _filtered("contains(upper(court), 'EN')"),
    "filter_tag": _filtered("channel = 'src1'"),
    "filter_article": _filtered("contains(lower(text), 'license') OR (contains(text, '2') AND contains(text, '0'))"),
    "filter_year": _filtered("year >= 2020 AND year <= 2023"),
    "filter_listing": sql(DOCS, then="SELECT CAST(9 AS BIGINT) AS query_id, CAST(row_number() OVER (ORDER BY doc_idx) AS INTEGER) AS rank, doc_idx, 0.0 AS score FROM d WHERE channel = 'src3' QUALIFY rank <= 20"),
    "stats": sql(DOCS, then="SELECT count(*) AS total, count(*) FILTER (contains(court, 'en')) AS court_a, count(*) FILTER (contains(court, 'fr')) AS court_b, CAST(min(year) FILTER (year >= 2000) AS INTEGER) AS year_min, CAST(max(year) FILTER (year >= 2000) AS INTEGER) AS year_max, count(*) FILTER (length(vs) > 0) AS with_vs_position, count(DISTINCT nullif(case_id, '')) AS unique_cases, count(*) - count(*) FILTER (contains(court, 'en')) - count(*) FILTER (contains(court, 'fr')) AS court_other, (SELECT count(DISTINCT t) FROM (SELECT court AS t FROM d UNION ALL SELECT channel FROM d)) AS unique_tags FROM d"),
    "list_tags": sql(DOCS, then="SELECT t AS tag, count(*) AS count FROM (SELECT court AS t FROM d UNION ALL SELECT channel FROM d) GROUP BY t HAVING count(*) >= 2"),
    "unique_cases": sql(DOCS, then="SELECT count(DISTINCT case_id) AS unique_cases FROM d WHERE case_id <> ''"),
    "case_groups": sql(DOCS, then="SELECT case_id, count(*) AS n, min(doc_idx) AS first_id, max(doc_idx) AS last_id FROM d WHERE case_id IS NOT NULL GROUP BY case_id"),
    "duplicate_groups": sql(DOCS, then="SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_members FROM (SELECT count(*) AS n FROM d WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) > 1)"),
    "dedup_leader": sql(DOCS, STATS, LEX, "ranked AS (SELECT lex.*, row_number() OVER (PARTITION BY query_id, case_id ORDER BY round(score, 9) DESC, lex.doc_idx) AS r FROM lex JOIN d ON d.doc_idx = lex.doc_idx), led AS (SELECT * FROM ranked WHERE r = 1)", then=_top("led")),
    "get_case": sql(DOCS, then="SELECT doc_idx AS id, court, title, channel AS source_channel, year, vs AS vs_position FROM d WHERE doc_idx = 5"),
    "section_presence": sql(DOCS, then="SELECT count(*) AS n_docs, count(*) FILTER (fabula <> '') AS with_fabula, CAST(0 AS BIGINT) AS with_lower_courts, count(*) FILTER (vs <> '') AS with_vs_position, count(*) FILTER (residual <> '' AND fabula = '' AND vs = '') AS residual_only FROM d"),
    "snippet": sql(DOCS, SNIPPET, then="SELECT doc_idx, CASE WHEN length(b) <= 250 THEN b WHEN back > 0 AND 250 - back > 125 THEN substr(b, 1, 251 - back) ELSE h || '...' END AS snippet FROM s1"),
    "embedding_text": sql(DOCS, then="SELECT doc_idx, concat_ws(chr(10), nullif(title, ''), CASE WHEN vs <> '' THEN 'Позиция ВС: ' || vs END, CASE WHEN fabula <> '' THEN 'Фабула: ' || fabula END, CASE WHEN vs = '' AND fabula = '' THEN nullif(substr(coalesce(nullif(residual, ''), text), 1, 8000), '') END) AS embedding_text FROM d"),
    "embedding_meta": sql(DOCS, then="SELECT count(*) AS n_texts, CAST(floor(avg(length(concat_ws(chr(10), nullif(title, ''), CASE WHEN vs <> '' THEN 'Позиция ВС: ' || vs END, CASE WHEN fabula <> '' THEN 'Фабула: ' || fabula END, CASE WHEN vs = '' AND fabula = '' THEN nullif(substr(coalesce(nullif(residual, ''), text), 1, 8000), '') END)))) AS BIGINT) AS mean_length FROM d"),
    "query_hash": "SELECT item_id, sha256(regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) AS key FROM benchmark",
    "l2_normalize": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3 * CAST(x AS DOUBLE) * 3))), 5) AS norm_before, CAST(1.0 AS DOUBLE) AS norm_after FROM embeddings",
    "cosine_topk": sql(DOCS, _Q, SEM, then=_top("semp")),
    "find_similar": sql(DOCS, "sim AS (SELECT CAST(0 AS BIGINT) AS query_id, e.vec_id AS doc_idx, 100 * list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM embeddings v, embeddings e WHERE v.vec_id = 5 AND e.vec_id <> 5 AND e.vec_id IN (SELECT doc_idx FROM d))", then="SELECT CAST(rank AS INTEGER) AS rank, doc_idx AS id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_idx) AS rank FROM sim) WHERE rank <= 10"),
    "candidate_union": sql(DOCS, STATS, LEX, SEM, FUSE, then="SELECT query_id, count(*) AS n FROM (SELECT query_id, doc_idx FROM rl UNION SELECT query_id, doc_idx FROM rs) GROUP BY query_id"),
    "rrf_hybrid": sql(DOCS, STATS, LEX, SEM, FUSE, then="SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_idx, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM fu)"),
    "freshness": sql(DOCS, then="SELECT doc_idx, round(1 + 0.30 * exp(-greatest(0, 2026 - year) / 4.0), 6) AS freshness FROM d"),
    "proximity": sql(DOCS, STATS, LEX, SEM, FUSE, BOOST, then="SELECT query_id, doc_idx, round(prox, 6) AS proximity FROM bo"),
    "boosted_hybrid": sql(DOCS, STATS, LEX, SEM, FUSE, BOOST, then="SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_idx, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM bo)"),
    "cache_lookup": "SELECT item_id AS query_id, item_id % 2 = 0 AND item_id IN (SELECT vec_id FROM embeddings) AS hit FROM benchmark",
    "adjacent_pairs": f"WITH {_Q}, ql AS (SELECT query_id, {tok('query')} AS words FROM q) SELECT query_id, CAST(i - 1 AS INTEGER) AS pos, words[i] AS a, words[i + 1] AS b FROM (SELECT query_id, words, unnest(range(1, len(words))) AS i FROM ql)",
    "explain_scores": sql(DOCS, STATS, LEX, SEM, FUSE, BOOST, then="SELECT bo.query_id, CAST(row_number() OVER (PARTITION BY bo.query_id ORDER BY round(bo.score, 9) DESC, ord) AS INTEGER) AS pos, bo.doc_idx, CAST(rl.rank AS INTEGER) AS bm25_rank, round(rl.score, 5) AS bm25_score, CAST(rs.rank AS INTEGER) AS sem_rank, round(rs.score, 5) AS sem_sim, length(vs) > 0 AS structured_vs, round(1 + 0.5 * prox, 6) AS proximity_x, round(1 + 0.30 * exp(-greatest(0, 2026 - year) / 4.0), 6) AS freshness_x, round(bo.score, 5) AS final FROM bo JOIN d ON d.doc_idx = bo.doc_idx LEFT JOIN rl ON rl.query_id = bo.query_id AND rl.doc_idx = bo.doc_idx LEFT JOIN rs ON rs.query_id = bo.query_id AND rs.doc_idx = bo.doc_idx"),
    "parse_date": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso_date, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders",
    "reconcile_year": "WITH y AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS dy, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(year(o_orderdate) + o_orderkey % 5 - 2 AS INTEGER) END AS ay, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(1990 + o_orderkey % 10 AS INTEGER) END AS cy FROM orders) SELECT o_orderkey, coalesce(greatest(CASE WHEN cy IS NULL OR ay >= cy THEN ay END, CASE WHEN cy IS NULL OR dy >= cy THEN dy END), cy) AS year FROM y",
    "split_csv": "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_brand || ' ; ' || p_type || ',, ' || p_name, '[;,]'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM part",
    "id_collision": "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)",
    "next_id": "SELECT coalesce(max(doc_id), 0) + 1 AS next_id FROM documents",
    "cardinality_guard": "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS no_vector, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS no_document",
}
