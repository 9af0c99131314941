"""Checks of the lexical index, vectors, fusion, context, planning and evaluation."""

from __future__ import annotations

from corpusloom.functions import patterns as P
from oracles.ctes import CTES, EDGE, lit, normal, plain, re2, sanitized, strip
from oracles.documents import tokens

SQL: dict[str, str] = {}

CTES["questions"] = """
SELECT t.tenant_id, item_id AS query_id, concat(CASE item_id % 5
   WHEN 0 THEN concat('O que diz o art. ', cast(item_id % 7 + 1 AS varchar), ' da RDC ', cast(item_id % 400 + 1 AS varchar), '/', cast(item_id % 35 + 1990 AS varchar), '? ')
   WHEN 1 THEN 'Quais normas tratam de controle de qualidade e boas práticas? '
   WHEN 2 THEN concat('A RDC ', cast(item_id % 400 + 1 AS varchar), '/', right(cast(item_id % 35 + 1990 AS varchar), 2), ' continua vigente? ')
   WHEN 3 THEN 'Requisitos de qualidade da anvisa: ' ELSE '' END, b.text) AS question
FROM benchmark b, (SELECT DISTINCT source AS tenant_id FROM documents) t"""
CTES["toks"] = f"SELECT chunk_id, tenant_id, document_id, {tokens('text')} AS toks FROM chunks_full"
CTES["tok_rows"] = "SELECT chunk_id, tenant_id, document_id, unnest(toks) AS term FROM toks"
CTES["postings"] = "SELECT chunk_id, tenant_id, document_id, term, count(*) AS tf FROM tok_rows GROUP BY ALL"
CTES["term_sets"] = """
SELECT tenant_id, min(chunk_id) AS id, terms, len(terms) AS n FROM (SELECT tenant_id, chunk_id, list_sort(list_distinct(toks)) AS terms FROM toks WHERE len(toks) > 0) GROUP BY tenant_id, terms"""
SQL["near_duplicate_chunks"] = """
SELECT tenant_id, left_id, right_id, round(similarity, 6) AS similarity FROM (
  SELECT a.tenant_id, a.id AS left_id, b.id AS right_id, len(list_intersect(a.terms, b.terms)) AS m, m::double / (a.n + b.n - m) AS similarity
  FROM term_sets a JOIN term_sets b ON a.tenant_id = b.tenant_id AND a.id < b.id AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) - 1e-9)
WHERE similarity >= 0.9"""
SQL["class_members"] = """
SELECT tenant_id, chunk_id, min(chunk_id) OVER w AS representative, count(*) OVER w AS members
FROM (SELECT tenant_id, chunk_id, list_sort(list_distinct(toks)) AS terms FROM toks WHERE len(toks) > 0)
WINDOW w AS (PARTITION BY tenant_id, terms)"""
CTES["lens"] = "SELECT chunk_id, tenant_id, len(toks) AS doc_len FROM toks WHERE len(toks) > 0"
CTES["totals"] = "SELECT tenant_id, count(*) AS n, avg(doc_len) AS avg_len FROM lens GROUP BY ALL"
CTES["dfreq"] = "SELECT tenant_id, term, count(*) AS df FROM postings GROUP BY ALL"
CTES["q_toks"] = f"SELECT tenant_id, query_id, {tokens('question')} AS toks FROM questions"
CTES["q_terms"] = "SELECT DISTINCT tenant_id, query_id, unnest(toks) AS term FROM q_toks"
CTES["bm25"] = """
SELECT q.tenant_id, q.query_id, p.chunk_id, p.document_id,
  round(sum(ln(1 + (t.n - d.df + 0.5::double) / (d.df + 0.5::double)) * (p.tf * 2.5::double / (p.tf + 1.5::double * (0.25::double + 0.75::double * (l.doc_len / t.avg_len))))), 6) AS bm25_score
FROM q_terms q JOIN postings p USING (tenant_id, term) JOIN dfreq d USING (tenant_id, term)
JOIN lens l USING (tenant_id, chunk_id) JOIN totals t USING (tenant_id) GROUP BY ALL"""
CTES["bm25_hits"] = """
SELECT *, bm25_score / max(bm25_score) OVER (PARTITION BY tenant_id, query_id) AS lexical_score FROM (
 SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY bm25_score DESC, chunk_id) AS int) AS bm25_rank FROM bm25)
WHERE bm25_rank <= 12"""

SQL["bm25_postings"] = "SELECT chunk_id, term, tf FROM postings"
SQL["bm25_corpus_stats"] = "SELECT tenant_id, term, df, n, round(avg_len, 6) AS avg_len FROM dfreq JOIN totals USING (tenant_id)"
SQL["bm25_search"] = "SELECT tenant_id, query_id, chunk_id, bm25_score, bm25_rank FROM bm25_hits"
SQL["lexical_score"] = "SELECT tenant_id, query_id, chunk_id, round(lexical_score, 6) AS lexical_score FROM bm25_hits"
CTES["q_refs"] = f"SELECT tenant_id, query_id, list_distinct({tokens('question', False, False)}) AS refs FROM questions"
SQL["contains_any_token"] = """
SELECT DISTINCT p.tenant_id, p.chunk_id FROM postings p
JOIN (SELECT DISTINCT tenant_id, unnest(refs) AS term FROM q_refs) USING (tenant_id, term)"""
SQL["index_size"] = """
SELECT l.tenant_id, chunks, terms FROM (SELECT tenant_id, count(*) AS chunks FROM lens GROUP BY ALL) l
JOIN (SELECT tenant_id, count(DISTINCT term) AS terms FROM postings GROUP BY ALL) USING (tenant_id)"""

# ------------------------------------------------------------------ vectors


def _dense(name: str, keys: str, source: str) -> None:
    CTES[f"{name}_codes"] = f"SELECT {keys}, cast('0x' || left(md5(term), 7) AS bigint) AS code FROM (SELECT {keys}, unnest(toks) AS term FROM {source})"
    CTES[f"{name}_sparse"] = f"SELECT {keys}, code % 64 AS i, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1.0::double ELSE -1.0::double END) AS x FROM {name}_codes GROUP BY ALL"
    CTES[f"{name}_dense"] = f"""
SELECT {keys}, list(coalesce(x, 0.0::double) ORDER BY i) AS v, sqrt(sum(coalesce(x * x, 0))) AS nrm
FROM (SELECT {keys}, r.i FROM {source}, (SELECT unnest(range(64)) AS i) r) LEFT JOIN {name}_sparse USING ({keys}, i) GROUP BY {keys}"""


_dense("cv", "tenant_id, chunk_id", "toks")
_dense("qv", "tenant_id, query_id", "q_toks")
CTES["cos_all"] = """
SELECT c.tenant_id, q.query_id, c.chunk_id,
  round(greatest(0.0::double, least(1.0::double, list_inner_product(q.v, c.v) / (q.nrm * c.nrm))), 6) AS score
FROM cv_dense c JOIN qv_dense q USING (tenant_id) WHERE q.nrm > 0 AND c.nrm > 0"""
CTES["vec_hits"] = """
SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY score DESC, chunk_id) AS int) AS vector_rank FROM cos_all)
WHERE vector_rank <= 12"""
CTES["label_mean"] = """
SELECT label, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS nrm FROM (
  SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
GROUP BY label"""
CTES["label_cos"] = """
SELECT m.label AS query_id, cast(e.vec_id AS varchar) AS chunk_id, e.label,
  round(greatest(0.0::double, least(1.0::double, list_inner_product(m.v, e.v) / (m.nrm * e.nrm))), 6) AS score
FROM label_mean m, (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) AS nrm FROM embeddings) e"""
SQL["cosine_topk"] = """
SELECT cast(query_id AS bigint) AS query_id, chunk_id, score, vector_rank FROM (
 SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS int) AS vector_rank FROM label_cos)
WHERE vector_rank <= 12"""
SQL["cosine_topk_chunks"] = "SELECT tenant_id, query_id, chunk_id, score, vector_rank FROM vec_hits"
SQL["cosine_pairs"] = "SELECT chunk_id, label, score AS cosine FROM label_cos WHERE query_id = label"
SQL["score_lexical_only"] = """
SELECT b.tenant_id, b.query_id, b.chunk_id, c.score AS cosine FROM bm25_hits b
JOIN cos_all c USING (tenant_id, query_id, chunk_id) ANTI JOIN vec_hits v USING (tenant_id, query_id, chunk_id)"""
CTES["doc_toks"] = f"SELECT doc_id, {tokens('text')} AS toks FROM documents"
_dense("dv", "doc_id", "doc_toks")
SQL["embed_chunks"] = "SELECT doc_id, array_to_string(list_transform(v, lambda x: cast(cast(x AS int) AS varchar)), ',') AS vector FROM dv_dense"
SQL["embedding_model_guard"] = """
SELECT tenant_id, CASE WHEN tenant_id = 'src7' AND count(*) FILTER (page = 2) > 0 THEN 'hashing-64,other-64' ELSE 'hashing-64' END AS models,
  '64' AS sizes, tenant_id = 'src7' AND count(*) FILTER (page = 2) > 0 AS conflict FROM chunks_full GROUP BY tenant_id"""

# ------------------------------------------------------------------ fusion

_LISTS = (
    "SELECT tenant_id, query_id, chunk_id, 1 AS source, 1.0::double / (60 + vector_rank) AS share, score AS vector, NULL::double AS cosine, NULL::double AS graph, NULL::double AS lexical FROM vec_hits",
    "SELECT b.tenant_id, b.query_id, b.chunk_id, 2, 1.0::double / (60 + bm25_rank), NULL, c.score, NULL, lexical_score FROM bm25_hits b LEFT JOIN cos_all c USING (tenant_id, query_id, chunk_id)",
    "SELECT tenant_id, query_id, chunk_id, 3, 1.0::double / (60 + graph_rank), NULL, NULL, score, NULL FROM graph_hits",
)


def _fused(lists: int) -> str:
    return f"""
SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY rrf_score DESC, first_list, chunk_id) AS int) AS rank FROM (
 SELECT tenant_id, query_id, chunk_id, round(sum(share), 9) AS rrf_score,
   coalesce(max(vector), max(cosine), max(graph), 0.0::double) AS vector_score,
   coalesce(max(lexical), 0.0::double) AS lexical_score, min(source) AS first_list FROM ({" UNION ALL ".join(_LISTS[:lists])})
 GROUP BY ALL)"""


CTES["fused"] = _fused(3)
SQL["rrf_fuse"] = """
SELECT tenant_id, query_id, chunk_id, round(rrf_score, 6) AS rrf_score, vector_score, round(lexical_score, 6) AS lexical_score, rank FROM fused"""


def _candidates(fused: str) -> str:
    return f"""
SELECT f.*, c.* EXCLUDE (tenant_id, chunk_id), list_distinct(t.toks) AS tokens, list_has_any(list_distinct(t.toks), q.refs) AS exact_reference
FROM {fused} f JOIN chunks_full c USING (tenant_id, chunk_id) JOIN toks t USING (tenant_id, chunk_id) JOIN q_refs q USING (tenant_id, query_id)"""


CTES["cands"] = _candidates("fused")
SQL["exact_reference"] = "SELECT tenant_id, query_id, chunk_id, exact_reference FROM cands"
SQL["passes_relevance"] = "SELECT tenant_id, query_id, chunk_id, vector_score >= 0.45 OR (exact_reference AND lexical_score >= 0.5) AS passes FROM cands"
CTES["orders"] = """
SELECT tenant_id, query_id, CASE query_id % 4 WHEN 0 THEN [3, 1, 2, 99] WHEN 1 THEN [query_id % 20 + 1] WHEN 2 THEN []::int[] ELSE [0, 5, 4] END AS o FROM questions"""
SQL["rerank_apply"] = """
SELECT tenant_id, query_id, chunk_id, rank, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY coalesce(nullif(list_position(o, rank), 0), 1000 + rank)) AS int) AS new_rank
FROM fused JOIN orders USING (tenant_id, query_id) WHERE rank <= 20"""


def _dedup(cands: str) -> str:
    shared = "len(list_intersect(o.tokens, e[1].tokens))"
    jac = f"({shared}::double / (len(o.tokens) + len(e[1].tokens) - {shared}))"
    return f"""
SELECT tenant_id, query_id, unnest(list_transform(list_reduce(cs, lambda acc, e: CASE WHEN len(list_filter(acc, lambda o:
   {jac} >= 0.9 OR (o.document_id = e[1].document_id AND abs(o.chunk - e[1].chunk) <= 1 AND {jac} >= 0.5))) > 0
   THEN acc ELSE list_concat(acc, e) END), lambda s: s.chunk_id)) AS chunk_id
FROM (SELECT tenant_id, query_id, list([{{'chunk_id': chunk_id, 'document_id': document_id, 'chunk': chunk, 'tokens': tokens}}] ORDER BY rank) AS cs FROM {cands} GROUP BY ALL)"""


CTES["relevant"] = "SELECT * FROM cands WHERE vector_score >= 0.45 OR (exact_reference AND lexical_score >= 0.5)"
CTES["kept"] = _dedup("relevant")
CTES["selected"] = """
SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY rank) AS int) AS source_no FROM relevant JOIN kept USING (tenant_id, query_id, chunk_id))
WHERE source_no <= 4"""
CTES["reordered"] = """
SELECT c.* REPLACE (cast(row_number() OVER (PARTITION BY c.tenant_id, c.query_id ORDER BY coalesce(nullif(list_position(o, rank), 0), 1000 + rank)) AS int) AS rank)
FROM cands c JOIN orders USING (tenant_id, query_id) WHERE rank <= 20"""
CTES["fitting"] = CTES["relevant"].replace("FROM cands", "FROM reordered")
CTES["unrepeated"] = _dedup("fitting")
SQL["hybrid_retrieve_reranked"] = """
SELECT tenant_id, query_id, source_no, chunk_id FROM (SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY rank) AS int) AS source_no
FROM fitting JOIN unrepeated USING (tenant_id, query_id, chunk_id)) WHERE source_no <= 4"""
SQL["dedup_candidates"] = _dedup("cands")
SQL["select_context"] = "SELECT tenant_id, query_id, source_no, chunk_id FROM selected"
SQL["hybrid_retrieve"] = """
SELECT tenant_id, query_id, source_no, chunk_id, filename, vector_score, round(lexical_score, 6) AS lexical_score, exact_reference FROM selected"""
SQL["source_projection"] = """
SELECT tenant_id, query_id, source_no, filename AS document, page, chunk, (k // 100 + CASE WHEN k % 100 > 50 OR (k % 100 = 50 AND (k // 100) % 2 = 1) THEN 1 ELSE 0 END) / 1e4 AS score, round(lexical_score, 4) AS lexical_score,
  left(text, 600) AS excerpt, authority, regulation_number, publication_date, effective_date, status,
  CASE status WHEN 'vigente_confirmada' THEN 'Vigencia confirmada' WHEN 'revogada_confirmada' THEN 'Revogada (confirmado)' ELSE 'Vigencia nao verificada' END AS status_label,
  article, section, source_url, document_version, false AS cited FROM (SELECT *, cast(round(vector_score * 1e6) AS bigint) AS k FROM selected)"""
CTES["ctx_blocks"] = "SELECT tenant_id, query_id, source_no, concat('[Fonte ', cast(source_no AS varchar), ']', chr(10), text) AS block FROM selected"
_cb, _ = sanitized("block")
SQL["context_blocks"] = f"""
SELECT tenant_id, query_id, string_agg({_cb}, chr(10) || chr(10) ORDER BY source_no) AS context, cast(count(*) AS int) AS blocks FROM ctx_blocks GROUP BY ALL"""
_est = lambda x: f"cast(ceil(length({x}) / 3.3::double) AS int)"
_rf = lambda n: f"(CASE WHEN strpos(reverse(cut), reverse({n})) > 0 THEN length(cut) - length({n}) - strpos(reverse(cut), reverse({n})) + 1 ELSE -1 END)"
CTES["budget"] = f"""
SELECT b.*, 910 + 80 + {_est('question')} AS fixed, greatest(1945 - 450 - (910 + 80 + {_est('question')}), 0) AS available,
  {_est('block')} + 1 AS cost, sum({_est('block')} + 1) OVER (PARTITION BY tenant_id, query_id ORDER BY source_no) AS running
FROM ctx_blocks b JOIN questions USING (tenant_id, query_id)"""
CTES["cuts"] = "SELECT *, cast(floor(greatest(available, 256) * 3.3::double) AS int) AS lim, left(block, cast(floor(greatest(available, 256) * 3.3::double) AS int)) AS cut FROM budget WHERE running <= available OR source_no = 1"
CTES["fitted"] = f"""
SELECT *, running > available AS trunc, CASE WHEN running <= available OR length(block) <= lim THEN block ELSE
  regexp_replace(CASE WHEN greatest({_rf("'. '")}, {_rf("'.' || chr(10)")}, {_rf("chr(10)")}) >= lim * 0.5 THEN left(cut, greatest({_rf("'. '")}, {_rf("'.' || chr(10)")}, {_rf("chr(10)")}) + 1) ELSE cut END, '\\s+\\z', '')
  || chr(10) || '[trecho cortado para caber no contexto]' END AS kb FROM cuts"""
CTES["rel_blocks"] = """
SELECT tenant_id, query_id, '[Relações KAG — orientação; confirme sempre pelas Fontes]' || chr(10) || string_agg(concat(source_name, ' → ', edges.relation, ' → ', target_name, ' (fonte: ', filename, '; status: ', validation_status, ')'), chr(10) ORDER BY edge_rank) AS rel
FROM g_search JOIN edges USING (tenant_id, edge_id) GROUP BY ALL"""
SQL["fit_context"] = f"""
SELECT k.tenant_id, k.query_id, 2048 AS context_tokens, available AS available_tokens,
  cast(fixed + used + CASE WHEN rel IS NOT NULL AND used + {_est('rel')} + 1 <= available THEN {_est('rel')} + 1 ELSE 0 END AS bigint) AS estimated_prompt_tokens,
  kept AS kept_chunks, n - kept AS dropped_chunks, trunc AS truncated_first,
  rel IS NOT NULL AND used + {_est('rel')} + 1 > available AS relations_dropped
FROM (SELECT tenant_id, query_id, first(fixed) AS fixed, first(available) AS available, sum({_est('kb')} + 1) AS used, count(*) AS kept, bool_or(trunc) AS trunc FROM fitted GROUP BY ALL) k
JOIN (SELECT tenant_id, query_id, count(*) AS n FROM ctx_blocks GROUP BY ALL) USING (tenant_id, query_id) LEFT JOIN rel_blocks USING (tenant_id, query_id)"""
SQL["early_exit"] = """
SELECT tenant_id, query_id, CASE WHEN s.tenant_id IS NULL THEN 'no_evidence' ELSE 'answerable' END AS outcome FROM questions q
LEFT JOIN (SELECT DISTINCT tenant_id, query_id FROM selected) s USING (tenant_id, query_id)
UNION ALL SELECT 'vazio', item_id, 'empty_base' FROM benchmark"""

# ------------------------------------------------------------------ planning

_end = r"(?:$|[^\p{L}\p{N}_])"
_lref = lit(r"(?i)" + EDGE + r"(?:rdc|portaria|in|lei|decreto)\s*\d")
_mhop = lit(r"(?i)" + EDGE + r"(?:quais|relacion|revog|entre normas|e\s+tamb[eé]m)" + _end)
_part = lit(r"(?i)" + EDGE + r"(?:art(?:igo|\.)?\s*\d+|item\s*\d+(?:\.\d+)*)" + _end)
_pval = lit(r"(?i)" + EDGE + r"(?:vigente|vigencia|revogad|alterou|alteraram|derrog)[\p{L}\p{N}_]*")
_prel = lit(r"(?i)" + EDGE + r"(?:quais|relacion|entre normas|e\s+tamb[eé]m|alem da|al[eé]m da)" + _end)
_pmul = lit(r"(?i)[?;].*[?;]|" + EDGE + r"e\s+(?:qual|quais|como|quando)" + _end)
CTES["routed"] = f"""
SELECT *, reason <> 'literal_ref' AS use_graph FROM (SELECT *, CASE WHEN regexp_matches(question, {_mhop}) THEN 'multi_hop'
  WHEN regexp_matches(question, {_lref}) THEN 'literal_ref' ELSE 'default' END AS reason FROM questions)"""
SQL["route_queries"] = "SELECT tenant_id, query_id, reason, true AS use_vector, true AS use_bm25, use_graph FROM routed"
_strategy = "CASE category " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in P.STRATEGIES.items()) + " END"
CTES["classed"] = f"""
SELECT *, {_strategy} AS strategy, CASE WHEN category IN ('article', 'exact_term') THEN 'high' WHEN category = 'conceptual' THEN 'low' ELSE 'medium' END AS confidence
FROM (SELECT *, CASE WHEN regexp_matches(question, {_pmul}) THEN 'multi_question' WHEN regexp_matches(question, {_prel}) THEN 'relationship'
  WHEN regexp_matches(question, {_pval}) THEN 'validity' WHEN regexp_matches(question, {_part}) THEN 'article'
  WHEN regexp_matches(question, {_lref}) THEN 'exact_term' ELSE 'conceptual' END AS category FROM routed)"""
SQL["classify_queries"] = "SELECT tenant_id, query_id, category, strategy, confidence FROM classed"
SQL["plan_queries"] = """
SELECT tenant_id, query_id, CASE WHEN category IN ('article', 'exact_term', 'relationship', 'validity') THEN concat(reason, '+', category) ELSE reason END AS reason,
  true AS use_vector, true AS use_bm25, use_graph OR category IN ('relationship', 'validity') AS use_graph, category, strategy, confidence FROM classed"""
_rw = "[" + ", ".join(lit(s) for s in P.REWRITE_STOPWORDS) + "]"
_words = "list_filter(regexp_extract_all(replace(lower(question), 'ß', 'ss'), '[\\p{L}\\p{N}\\p{M}_]+'), lambda w: length(w) > 1 AND NOT list_contains(" + _rw + ", w))"
_refx = lit(r"(?i)((?:^|[^\p{L}\p{N}_]))((?:rdc|portaria|in|lei|decreto)\s*\d+(?:/\d{2,4})?)" + r"($|[^\p{L}\p{N}_])")
_g = lambda i: f"regexp_extract(p, {lit('(?i)^(rdc|portaria|in|lei|decreto)' + chr(92) + 's*(' + chr(92) + 'd+)(?:/(' + chr(92) + 'd{2,4}))?$')}, {i})"
_base = f"(upper({_g(1)}) || ' ' || {_g(2)})"
_variants = f"""CASE WHEN {_g(3)} = '' THEN {_base} WHEN length({_g(3)}) = 2 THEN {_base} || '/' || {_g(3)} || ' ' || {_base} || '/' || CASE WHEN cast({_g(3)} AS int) >= 50 THEN '19' ELSE '20' END || {_g(3)}
 WHEN length({_g(3)}) = 4 THEN {_base} || '/' || {_g(3)} || ' ' || {_base} || '/' || right({_g(3)}, 2) ELSE {_base} || '/' || {_g(3)} END"""
CTES["expanded"] = f"""
SELECT tenant_id, query_id, question, array_to_string(list_transform(string_split(regexp_replace(question, {_refx}, '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)),
  lambda p, i: CASE WHEN i % 2 = 0 THEN {_variants} ELSE p END), '') AS x FROM questions"""
CTES["split_words"] = "SELECT tenant_id, query_id, unnest(ws) AS wd, generate_subscripts(ws, 1) AS pos FROM (SELECT *, regexp_split_to_array(CASE WHEN x = question THEN question ELSE question || ' ' || x END, '\\s+') AS ws FROM expanded)"
SQL["rewrite_queries"] = f"""
SELECT q.tenant_id, q.query_id, e.y AS expand_refs, coalesce(nullif(array_to_string({_words}, ' '), ''), question) AS drop_stopwords
FROM questions q JOIN (SELECT tenant_id, query_id, string_agg(wd, ' ' ORDER BY pos) AS y FROM (SELECT tenant_id, query_id, wd, min(pos) AS pos FROM split_words WHERE wd <> '' GROUP BY ALL) GROUP BY ALL) e USING (tenant_id, query_id)"""


def _assess(min_chunks: int, exact: bool) -> str:
    un = f"n > 0 AND n >= {min_chunks} AND {str(exact).lower()} AND category IN ('article', 'exact_term') AND NOT ex"
    return f"""
SELECT tenant_id, query_id, n AS selected_count, ex AS has_exact_reference, un AS unverified_count, n > 0 AND un > 0 AND fo > 0 AS conflict_suspected,
  array_to_string(list_filter([CASE WHEN n = 0 THEN 'no_chunks_selected' END, CASE WHEN n > 0 AND un > 0 THEN 'validity_unverified_in_selection' END,
    CASE WHEN n > 0 AND un > 0 AND fo > 0 THEN 'conflicting_validity_metadata' END, CASE WHEN n > 0 AND n < {min_chunks} THEN 'below_min_chunks' END,
    CASE WHEN {un} THEN 'literal_ref_without_exact_match' END], lambda g: g IS NOT NULL), ',') AS gaps,
  n > 0 AND n >= {min_chunks} AND NOT ({un}) AS sufficient
FROM (SELECT c.tenant_id, c.query_id, category, coalesce(n, 0) AS n, coalesce(ex, false) AS ex, coalesce(un, 0) AS un, coalesce(fo, 0) AS fo FROM classed c LEFT JOIN
 (SELECT tenant_id, query_id, count(*) AS n, bool_or(exact_reference) AS ex, count(*) FILTER (status <> 'vigente_confirmada') AS un, count(*) FILTER (status = 'vigente_confirmada') AS fo FROM selected GROUP BY ALL) USING (tenant_id, query_id))"""


SQL["assess_evidence"] = _assess(2, True)
SQL["merge_document_lists"] = """
SELECT tenant_id, query_id, cast(position AS int) AS position, document FROM (
 SELECT *, row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY l, rank) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, query_id, lower(document) ORDER BY l, rank) AS rn FROM (
   SELECT b.tenant_id, query_id, bm25_rank AS rank, filename AS document, 0 AS l FROM bm25_hits b JOIN chunks_full USING (tenant_id, chunk_id)
   UNION ALL SELECT v.tenant_id, query_id, vector_rank, upper(filename), 1 FROM vec_hits v JOIN chunks_full USING (tenant_id, chunk_id))) WHERE rn = 1)
WHERE position <= 12"""
SQL["query_trace"] = """
SELECT c.tenant_id, c.query_id, left(sha256(question), 16) AS query_hash, category AS query_category, strategy AS retrieval_strategy,
  coalesce(docs, '') AS retrieved_documents, coalesce(ids, '') AS retrieved_chunks, CASE WHEN ids IS NULL THEN 'insufficient' ELSE 'sufficient' END AS validation_status
FROM classed c LEFT JOIN (SELECT tenant_id, query_id, string_agg(filename, ',' ORDER BY source_no) AS docs, string_agg(chunk_id, ',' ORDER BY source_no) AS ids FROM selected GROUP BY ALL) USING (tenant_id, query_id)"""

# ------------------------------------------------------------------ evaluation

CTES["gold"] = """
SELECT DISTINCT d.source AS tenant_id, b.item_id AS query_id, concat('doc', cast(d.doc_id AS varchar), '.md') AS gold
FROM documents d, benchmark b WHERE contains(d.text, b.text)"""


def _metrics(name: str, retrieved: str) -> None:
    CTES[f"{name}_match"] = f"""
SELECT DISTINCT r.tenant_id, r.query_id, rank, gold FROM {retrieved} r JOIN gold USING (tenant_id, query_id)
WHERE rank <= 5 AND contains({normal('document')}, {normal('gold')})"""
    CTES[f"{name}_metrics"] = f"""
SELECT q.tenant_id, q.query_id,
  CASE WHEN golds IS NOT NULL THEN round(coalesce(found, 0) / golds, 6) END AS recall,
  CASE WHEN golds IS NOT NULL THEN round(coalesce(hits / returned, 0), 6) END AS precision,
  CASE WHEN golds IS NOT NULL THEN CASE WHEN best IS NULL THEN 0.0::double ELSE 1.0::double END END AS hit_rate,
  CASE WHEN golds IS NOT NULL THEN round(coalesce(1.0::double / best, 0), 6) END AS mrr,
  CASE WHEN golds IS NOT NULL THEN round(coalesce(dcg / list_sum(list_transform(range(1, least(golds, 5) + 1), lambda i: 1.0::double / log2(i + 1.0::double))), 0), 6) END AS ndcg
FROM questions q
LEFT JOIN (SELECT tenant_id, query_id, count(*) AS golds FROM gold GROUP BY ALL) USING (tenant_id, query_id)
LEFT JOIN (SELECT tenant_id, query_id, count(DISTINCT gold) AS found, min(rank) AS best FROM {name}_match GROUP BY ALL) USING (tenant_id, query_id)
LEFT JOIN (SELECT tenant_id, query_id, count(*) AS hits, sum(1.0::double / log2(rank + 1.0::double)) AS dcg FROM (SELECT DISTINCT tenant_id, query_id, rank FROM {name}_match) GROUP BY ALL) USING (tenant_id, query_id)
LEFT JOIN (SELECT tenant_id, query_id, count(*) AS returned FROM {retrieved} WHERE rank <= 5 GROUP BY ALL) USING (tenant_id, query_id)"""


CTES["bm_ranked"] = "SELECT b.tenant_id, query_id, bm25_rank AS rank, filename AS document FROM bm25_hits b JOIN chunks_full USING (tenant_id, chunk_id)"
_metrics("bm", "bm_ranked")
for _n, _c in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("hit_rate_at_k", "hit_rate"), ("mrr", "mrr"), ("ndcg_at_k", "ndcg")):
    SQL[_n] = f"SELECT tenant_id, query_id, {_c} FROM bm_metrics"
SQL["normalize_cases"] = """
SELECT concat(CASE item_id % 5 WHEN 0 THEN 'multi-' WHEN 1 THEN 'recusa-' WHEN 2 THEN 'art-' ELSE 'q-' END, cast(item_id AS varchar)) AS id, text AS question,
  item_id % 3 <> 0 AS should_answer, CASE WHEN item_id % 2 = 0 THEN concat('doc', cast(item_id AS varchar), '.md') END AS expected_document,
  CASE WHEN item_id % 4 = 2 THEN 'a.md,b.md' WHEN item_id % 2 = 0 THEN concat('doc', cast(item_id AS varchar), '.md') ELSE '' END AS expected_document_ids,
  '' AS expected_evidence_ids, NULL::varchar AS expected_article,
  CASE WHEN item_id % 2 = 1 THEN array_to_string(string_split(text, ' ')[1:2], ',') ELSE '' END AS expected_keywords,
  NULL::varchar AS reference_answer,
  CASE WHEN item_id % 8 = 4 THEN 'validity' WHEN item_id % 5 = 0 THEN 'relationship' WHEN item_id % 5 = 1 THEN 'abstention' WHEN item_id % 5 = 2 OR contains(lower(text), 'art.') THEN 'article'
    WHEN item_id % 3 = 0 THEN 'abstention' ELSE 'regulatory' END AS category,
  NULL::varchar AS difficulty, item_id % 6 = 0 AS requires_current_validity, CASE WHEN item_id % 9 = 0 THEN 'approved' ELSE 'seeded_from_dataset_json' END AS review_status
FROM benchmark"""
CTES["outcomes"] = """
SELECT event_id % 3 AS position, CASE event_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'hybrid' ELSE 'hybrid_kag' END AS variant, event_type <> 'signup' AS should_answer,
  CASE WHEN event_type <> 'view' THEN value > 20 END AS hit, CASE WHEN event_type <> 'view' THEN round(1.0::double / (event_id % 5 + 1), 6) END AS rr,
  event_id % 5 AS sel, cast(floor(value * 10) AS bigint) AS ms, event_type = 'error' AS err FROM events"""
CTES["summaries"] = """
SELECT cast(position AS int) AS position, variant, count(*) AS cases_total, count(*) FILTER (err) AS cases_errored,
  round(avg(CASE WHEN hit THEN 1.0::double ELSE 0.0::double END) FILTER (should_answer AND NOT err AND hit IS NOT NULL), 3) AS recall_at_5,
  count(*) FILTER (should_answer AND NOT err AND hit IS NOT NULL) AS recall_evaluated,
  round(avg(rr) FILTER (should_answer AND NOT err), 3) AS mrr, round(avg(sel) FILTER (should_answer AND NOT err), 2) AS selected_mean,
  coalesce(round(quantile_cont(ms::double, 0.5) FILTER (NOT err), 2), 0) AS p50, coalesce(round(quantile_cont(ms::double, 0.95) FILTER (NOT err), 2), 0) AS p95,
  round(avg(ms) FILTER (NOT err), 2) AS mean FROM outcomes GROUP BY ALL"""
SQL["variant_summary"] = "SELECT * FROM summaries"
SQL["compare_variants"] = """
SELECT f AS from_variant, variant AS to_variant, round(recall_at_5 - p, 3) AS recall_delta FROM (
 SELECT *, lag(variant) OVER (ORDER BY position) AS f, lag(recall_at_5) OVER (ORDER BY position) AS p FROM summaries) WHERE f IS NOT NULL"""

for _i, _v in enumerate(("va", "vb", "vc")):
    CTES[f"{_v}_fused"] = _fused(_i + 1)
    CTES[f"{_v}_cands"] = _candidates(f"{_v}_fused")
    CTES[f"{_v}_rel"] = f"SELECT * FROM {_v}_cands WHERE vector_score >= 0.45 OR (exact_reference AND lexical_score >= 0.5)"
    CTES[f"{_v}_kept"] = _dedup(f"{_v}_rel")
    CTES[f"{_v}_sel"] = f"""
SELECT * FROM (SELECT tenant_id, query_id, filename AS document, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY rank) AS int) AS rank
FROM {_v}_rel JOIN {_v}_kept USING (tenant_id, query_id, chunk_id)) WHERE rank <= 4"""
    _metrics(_v, f"{_v}_sel")
SQL["ablation"] = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{n}' AS variant, count(*) AS cases_total, 0 AS cases_errored, round(avg((hit_rate > 0)::int), 3) AS recall_at_5,
  count(hit_rate) AS recall_evaluated, round(avg(mrr), 3) AS mrr, round(avg(coalesce(k, 0)), 2) AS selected_mean
FROM {v}_metrics LEFT JOIN (SELECT tenant_id, query_id, count(*) AS k FROM {v}_sel GROUP BY ALL) USING (tenant_id, query_id)"""
    for i, (n, v) in enumerate((("vector", "va"), ("hybrid", "vb"), ("hybrid_kag", "vc")))
)
from oracles.ctes import _chunks, _pieces  # noqa: E402

_cells = [(c, o) for c in (1400, 1900, 2400) for o in (200, 285, 400)]
for _c, _o in _cells:
    CTES[f"s_pieces_{_c}_{_o}"] = _pieces("blocks", _c, _o)
    CTES[f"s_chunks_{_c}_{_o}"] = _chunks(f"s_pieces_{_c}_{_o}")
_made = " UNION ALL ".join(
    f"SELECT {c} AS c, {o} AS o, count(*) AS n, max(length(body)) AS m FROM s_chunks_{c}_{o}" for c, o in _cells
)
_judged = " UNION ALL ".join(
    f"SELECT {s}::double AS s, count(DISTINCT tenant_id || '|' || query_id) AS a FROM cands WHERE vector_score >= {s} OR (exact_reference AND lexical_score >= 0.5)"
    for s in (0.35, 0.45, 0.55, 0.65)
)
SQL["parameter_sweep"] = f"""
SELECT s AS min_relevance_score, c AS chunk_chars, o AS chunk_overlap_chars, concat('sweep_', c, '_', o, '_', cast(trunc(s * 100) AS int)) AS collection_name,
  n AS chunks, cast(m AS int) AS longest, a AS answerable FROM ({_made}), ({_judged})"""
