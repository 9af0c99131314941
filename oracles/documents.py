"""Checks of scans, filters, preparation and structure."""

from __future__ import annotations

from corpusloom.functions import patterns as P
from oracles.ctes import CTES, lit, normal, plain, re2, sanitized, strip

SQL: dict[str, str] = {}

SQL["scan_corpus_parquet"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
SQL["tenant_scope"] = "SELECT doc_id, tenant_id, filename FROM raw_docs WHERE tenant_id = 'src3'"
SQL["page_text_gate"] = "SELECT doc_id, page, cast(length(text) AS int) AS chars FROM raw_pages WHERE length(text) >= 40"
SQL["extraction_quality"] = """
SELECT tenant_id, document_id, count(*) AS total_pages, count(*) FILTER (length(text) >= 40) AS pages_with_text,
  cast(sum(length(text)) AS bigint) AS total_chars,
  round(count(*) FILTER (length(text) >= 40) / count(*), 6) AS extraction_ratio,
  CASE WHEN count(*) FILTER (length(text) >= 40) = 0 THEN 'empty'
       WHEN count(*) FILTER (length(text) >= 40) / count(*) < 0.2 THEN 'needs_ocr' ELSE 'ok' END AS verdict
FROM corpus_pages GROUP BY ALL"""
SQL["question_filter"] = f"SELECT item_id, {strip('text')} AS question FROM benchmark WHERE length(text) BETWEEN 3 AND 2000"
SQL["flag_injection"] = f"""
SELECT tenant_id, count(*) AS pages, count(*) FILTER (regexp_matches(lower(text), {re2(P.INJECTION)})) AS flagged_pages
FROM raw_pages GROUP BY tenant_id"""
SQL["drop_empty_metadata"] = """
SELECT tenant_id, document_id, string_agg(k, ',' ORDER BY k) AS keys, string_agg(v, ',' ORDER BY v) AS values FROM (
  SELECT tenant_id, document_id, unnest(['authority', 'effective_date', 'source_url', 'document_version', 'status']) AS k,
    unnest([authority, effective_date, source_url, document_version, status]) AS v FROM meta)
WHERE v IS NOT NULL AND v <> '' GROUP BY ALL"""
SQL["status_label"] = """
SELECT tenant_id, document_id, status, CASE status WHEN 'vigente_confirmada' THEN 'Vigencia confirmada'
  WHEN 'revogada_confirmada' THEN 'Revogada (confirmado)' ELSE 'Vigencia nao verificada' END AS label FROM meta"""
SQL["content_identity"] = "SELECT doc_id, tenant_id, content_hash, document_id FROM raw_docs"
SQL["exact_duplicate_docs"] = "SELECT tenant_id, document_id, doc_id, filename FROM uniq_docs"
SQL["normalize_text"] = f"SELECT doc_id, {normal('text')} AS normalized FROM documents"
SQL["normalize_lines"] = """
SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS normalized
FROM n_lines GROUP BY doc_id, page"""
SQL["frontmatter_split"] = """
SELECT doc_id, 'CFF' AS authority, CASE WHEN doc_id % 2 = 0 THEN 'vigente_confirmada' END AS status,
  concat('v', cast(doc_id AS varchar)) AS document_version, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS fields,
  sha256(text) AS body_hash FROM documents"""
_c, _r = sanitized("text")
SQL["sanitize_text"] = f"SELECT doc_id, page, {_c} AS clean_text, cast({_r} AS int) AS removed_sentences FROM raw_pages"
SQL["extract_authority"] = "SELECT tenant_id, document_id, authority FROM derived_meta"
SQL["extract_regulation_number"] = "SELECT tenant_id, document_id, regulation_number FROM derived_meta"
SQL["extract_dates"] = "SELECT tenant_id, document_id, publication_date FROM derived_meta"
SQL["extract_effective_date"] = "SELECT tenant_id, document_id, effective_date FROM derived_meta"
SQL["extract_title_url_version"] = "SELECT tenant_id, document_id, document_title, source_url, document_version FROM derived_meta"
SQL["document_metadata"] = "SELECT * EXCLUDE (head_text) FROM derived_meta"
SQL["confirmed_overlay"] = "SELECT * EXCLUDE (head_text) FROM meta"

_stop = "[" + ", ".join(lit(s) for s in P.STOPWORDS) + "]"


def tokens(x: str, bare_year: bool = True, words: bool = True) -> str:
    """Terms of a text as one list."""
    low = plain(f"lower({x})")
    ny = f"regexp_extract_all({low}, '\\d{{1,6}}(?:\\.\\d{{3}})*\\s*[/-]\\s*\\d{{2,4}}')"
    num = "replace(regexp_extract(m, '^(\\d{1,6}(?:\\.\\d{3})*)\\s*[/-]', 1), '.', '')"
    year = "regexp_extract(m, '(\\d{2,4})$', 1)"
    full = f"(CASE WHEN cast({year} AS int) > 50 THEN '19' ELSE '20' END || {year})"
    bare = f", {full}" if bare_year else ""
    pairs = f"""flatten(list_transform({ny}, lambda m: CASE length({year}) WHEN 2 THEN [{num} || '/' || {year}, {num} || '/' || {full}{bare}]
      WHEN 4 THEN [{num} || '/' || {year}, {num} || '/' || right({year}, 2)] ELSE [{num} || '/' || {year}] END))"""
    arts = f"list_transform(regexp_extract_all({low}, '(?:^|[^\\p{{L}}\\p{{N}}_])art(?:igo)?\\.?\\s*\\d{{1,4}}(?:\\s*-\\s*[a-z])?'), lambda m: 'art' || regexp_extract(m, '(\\d{{1,4}})', 1) || regexp_extract(m, '\\d\\s*-\\s*([a-z])$', 1))"
    parts = f"list_concat({pairs}, {arts})"
    if words:
        parts = f"list_concat(list_filter(regexp_extract_all({low}, '[a-z0-9]+'), lambda w: NOT list_contains({_stop}, w)), {parts})"
    return parts


SQL["tokenize_corpus"] = f"""
SELECT doc_id, cast(len(t) AS int) AS terms, array_to_string(list_sort(t), ' ') AS sorted_terms
FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)"""
SQL["reference_tokens"] = f"""
SELECT doc_id, page, coalesce(array_to_string(list_sort(list_distinct({tokens('text', False, False)})), ' '), '') AS refs FROM raw_pages"""
SQL["estimate_tokens"] = "SELECT doc_id, cast(ceil(length(text) / 3.3::double) AS int) AS tokens FROM documents"

_KEY = "tenant_id, document_id, page"
_FIELDS = "title, annex, chapter, section, article, paragraph, inciso, alinea"
SQL["classify_lines"] = f"SELECT {_KEY}, line_no, kind, label FROM classified"
SQL["carry_context"] = f"SELECT {_KEY}, line_no, {_FIELDS} FROM carried"
SQL["segment_blocks"] = f"SELECT {_KEY}, block_no, block, {_FIELDS} FROM blocks"
SQL["split_oversized"] = f"SELECT {_KEY}, block_no, piece_no, piece FROM pieces"
SQL["assemble_chunks"] = f"SELECT {_KEY}, body, {_FIELDS} FROM chunks"
SQL["item_label"] = "SELECT chunk_id, nullif(concat_ws(', ', article, paragraph, inciso, alinea), '') AS label FROM chunks"
SQL["number_chunks"] = f"SELECT chunk_id, {_KEY}, chunk FROM chunks"
SQL["chunk_headers"] = "SELECT * EXCLUDE (body) FROM chunks_full"
SQL["chunk_stats"] = """
SELECT tenant_id, document_id, count(*) AS chunks, round(avg(length(body)), 6) AS mean_length,
  cast(max(length(body)) AS int) AS max_length FROM chunks GROUP BY ALL"""
CTES["n_pages"] = "SELECT tenant_id, cast(doc_id AS varchar) AS document_id, page, text FROM raw_pages"
from oracles.ctes import _lines  # noqa: E402

CTES["n_lines"] = _lines("n_pages").replace("SELECT tenant_id, document_id, page, line_no", "SELECT cast(document_id AS bigint) AS doc_id, page, line_no", 1)
