"""Checks of store and graph maintenance, files and streams of documents."""

from __future__ import annotations

from oracles.ctes import CTES
from oracles.documents import tokens

SQL: dict[str, str] = {}

CTES["unwanted"] = "SELECT DISTINCT tenant_id, document_id FROM raw_docs JOIN labels USING (doc_id) WHERE quality = 0"
CTES["renewed"] = "SELECT k.* REPLACE (text || chr(10) || 'Nova versao.' AS text) FROM chunks_full k SEMI JOIN unwanted USING (tenant_id, document_id) WHERE chunk <= 2"
SQL["upsert_chunks"] = """
SELECT chunk_id, tenant_id, sha256(text) AS text_hash FROM (SELECT * FROM chunks_full ANTI JOIN renewed USING (chunk_id) UNION ALL SELECT * FROM renewed)"""
SQL["stale_chunks"] = "SELECT tenant_id, chunk_id, document_id FROM chunks_full SEMI JOIN unwanted USING (tenant_id, document_id) WHERE chunk > 2"
SQL["delete_documents"] = "SELECT chunk_id, tenant_id, document_id FROM chunks_full ANTI JOIN unwanted USING (tenant_id, document_id)"
SQL["fetch_chunks"] = "SELECT chunk_id, tenant_id, filename FROM chunks_full WHERE chunk = 1"
CTES["upd"] = "SELECT tenant_id, document_id, CASE doc_id % 4 WHEN 0 THEN 'vigente_confirmada' WHEN 1 THEN 'revogada_confirmada' ELSE 'vigencia_nao_verificada' END AS st FROM uniq_docs WHERE doc_id % 4 < 3"
SQL["apply_status_updates"] = """
SELECT chunk_id, coalesce(st, status) AS status, CASE WHEN st <> 'vigencia_nao_verificada' THEN 'revisor' END AS validated_by,
  CASE WHEN st <> 'vigencia_nao_verificada' THEN '2024-01-16T00:00:00Z' END AS validated_at, CASE WHEN st <> 'vigencia_nao_verificada' THEN 'confirmacao_manual_na_aplicacao' END AS validation_method,
  sha256(CASE WHEN st IS NULL THEN text ELSE regexp_replace(text, '(?m)^Status informado:.*$', 'Status informado: ' || CASE st WHEN 'vigente_confirmada' THEN 'Vigencia confirmada' WHEN 'revogada_confirmada' THEN 'Revogada (confirmado)' ELSE 'Vigencia nao verificada' END, 'g') END) AS text_hash
FROM chunks_full LEFT JOIN upd USING (tenant_id, document_id)"""
SQL["list_documents"] = """
SELECT tenant_id, document_id, filename, count(*) AS chunks, first(authority ORDER BY chunk) AS authority, first(regulation_number ORDER BY chunk) AS regulation_number,
  first(status ORDER BY chunk) AS status, first(publication_date ORDER BY chunk) AS publication_date FROM chunks_full GROUP BY ALL"""
SQL["knowledge_base_status"] = """
SELECT coalesce(tenant_id, '*') AS tenant_id, count(DISTINCT document_id || tenant_id) AS documents, count(*) AS chunks, count(*) AS bm25_index_size,
  count(DISTINCT document_id || tenant_id) FILTER (status <> 'vigente_confirmada') AS unverified_documents, true AS ready FROM chunks_full GROUP BY ROLLUP (tenant_id)"""
SQL["tenant_ids"] = "SELECT DISTINCT tenant_id FROM chunks_full"
CTES["used"] = "SELECT tenant_id, cast(sum(strlen(text)) AS bigint) AS stored_bytes FROM chunks_full GROUP BY ALL"
SQL["tenant_quota"] = "SELECT tenant_id, stored_bytes, stored_bytes > 2147483648 AS over_quota FROM used"
SQL["upload_admission"] = "SELECT d.tenant_id, filename, cast(strlen(text) AS int) AS size_bytes, coalesce(stored_bytes, 0) AS stored_bytes, coalesce(stored_bytes, 0) + strlen(text) <= 400000 AS admitted FROM raw_docs d LEFT JOIN used USING (tenant_id)"

SQL["graph_sync"] = """
SELECT edge_id, tenant_id, document_id, relation, source_span FROM edges ANTI JOIN unwanted USING (tenant_id, document_id)
UNION ALL SELECT edge_id, tenant_id, document_id, relation, source_span FROM edges SEMI JOIN unwanted USING (tenant_id, document_id) WHERE emit_order < 1000"""
SQL["forget_document_edges"] = "SELECT edge_id, tenant_id, document_id, relation FROM edges ANTI JOIN unwanted USING (tenant_id, document_id)"
SQL["orphan_entities"] = """
SELECT tenant_id, kind, name_normalized FROM ents e WHERE NOT EXISTS (SELECT 1 FROM edges x ANTI JOIN unwanted USING (tenant_id, document_id) WHERE x.tenant_id = e.tenant_id AND (x.source_id = e.entity_id OR x.target_id = e.entity_id))"""
SQL["list_relations"] = """
SELECT x.tenant_id, position, edge_id, s.name AS subject, relation, o.name AS object FROM (
 SELECT *, cast(row_number() OVER (PARTITION BY tenant_id ORDER BY emit_order DESC, edge_id) AS int) AS position FROM edges WHERE validation_status = 'pendente_de_validacao') x
JOIN ents s ON s.tenant_id = x.tenant_id AND s.entity_id = x.source_id JOIN ents o ON o.tenant_id = x.tenant_id AND o.entity_id = x.target_id WHERE position <= 50"""
SQL["validate_relations"] = """
SELECT edge_id, CASE WHEN relation NOT IN ('regula', 'relacionado_a') THEN validation_status WHEN confidence < 1 THEN 'rejeitada' ELSE 'validada' END AS validation_status,
  CASE WHEN relation NOT IN ('regula', 'relacionado_a') THEN NULL WHEN confidence < 1 THEN 'rui' ELSE 'ana' END AS validated_by,
  CASE WHEN relation NOT IN ('regula', 'relacionado_a') THEN NULL WHEN confidence < 1 THEN '2024-01-12' ELSE '2024-01-10' END AS validated_at FROM edges"""
SQL["relation_prompt_lines"] = "SELECT edge_id, concat(source_name, ' → ', relation, ' → ', target_name, ' (fonte: ', filename, '; status: ', validation_status, ')') AS line FROM edges"
SQL["ingest_model_relations"] = """
SELECT tenant_id, doc_id, 'Art. 1' AS source_span, e.n AS edge_no, e.relation, e.target_kind, CASE e.n WHEN 1 THEN filename WHEN 2 THEN concat('RDC ', cast(doc_id % 400 + 1 AS varchar)) ELSE 'a' END AS target_name,
  CASE WHEN e.n = 2 THEN 'norma' END AS source_kind, CASE WHEN e.n = 2 THEN tenant_id END AS source_name,
  CASE WHEN e.n = 1 THEN least(0.85::double, greatest(0.1::double, round((doc_id % 20) / 10.0::double - 0.3::double, 2))) ELSE 0.55::double END AS confidence, 'llm' AS extracted_by
FROM raw_docs, (VALUES (1, 'regula', 'tema'), (2, 'revoga', 'tema'), (3, 'trata_de', 'conceito')) e(n, relation, target_kind)"""

SQL["reject_bad_content"] = """
SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'pdf' WHEN 0 THEN 'md' ELSE 'exe' END AS ext, CASE doc_id % 3 WHEN 0 THEN doc_id % 9 <> 0 WHEN 1 THEN doc_id % 9 = 1 OR regexp_matches(text, '^\\s*%PDF-') ELSE false END AS accepted FROM documents"""
SQL["scan_sidecars"] = "SELECT filename, status, document_version FROM (SELECT * REPLACE (CASE WHEN document_version IS NOT NULL THEN ' ' || document_version END AS document_version) FROM sidecars) WHERE substring(filename, 4, 1) <> '3'"
_case = """
SELECT concat(CASE item_id % 5 WHEN 0 THEN 'multi-' WHEN 1 THEN 'recusa-' WHEN 2 THEN 'art-' ELSE 'q-' END, cast(item_id AS varchar)) AS id, text AS question,
  CASE item_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS should_answer, CASE WHEN item_id % 2 = 0 THEN concat('doc', cast(item_id AS varchar), '.md') END AS expected_document,
  CASE WHEN item_id % 4 = 2 THEN ['a.md', 'b.md'] END AS expected_document_ids, cast(NULL AS varchar[]) AS expected_evidence_ids,
  CASE WHEN item_id % 7 = 0 THEN '' END AS expected_article, CASE WHEN item_id % 2 = 1 THEN string_split(text, ' ')[1:2] END AS expected_keywords,
  cast(NULL AS varchar) AS reference_answer, CASE WHEN item_id % 8 = 4 THEN 'validity' END AS category, cast(NULL AS varchar) AS difficulty,
  CASE WHEN item_id % 6 = 0 THEN true END AS requires_current_validity, CASE WHEN item_id % 9 = 0 THEN 'approved' END AS review_status FROM benchmark"""
SQL["scan_text_files"] = """
SELECT concat('doc', cast(doc_id AS varchar), '.md') AS document, 'txt' AS ext, length(t)::int AS chars, sha256(t) AS text_hash
FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)"""
SQL["scan_eval_json"] = _case
SQL["scan_eval_jsonl"] = _case
SQL["write_chunk_snapshot"] = "SELECT chunk_id, tenant_id, document_id, chunk FROM chunks_full WHERE tenant_id <> 'src3' OR chunk = 1"
SQL["write_report"] = """
SELECT 'evaluation' AS harness_mode, true AS measured, tenant_id, count(DISTINCT document_id || tenant_id) AS documents, count(*) AS chunks FROM chunks_full GROUP BY ROLLUP (tenant_id)"""

# A stream of the raw documents: files under forty characters are turned away.
CTES["plain_text"] = f"""
SELECT c.*, regexp_replace(c.text, '(?m)^Status informado:.*$', 'Status informado: Vigencia nao verificada') AS plain FROM chunks_full c"""
CTES["taken"] = "SELECT tenant_id, document_id FROM uniq_docs WHERE length(text) >= 40 AND NOT contains(left(text, 8192), chr(0))"
SQL["stream_ingest"] = """
SELECT chunk_id, tenant_id, document_id, chunk, sha256(plain) AS text_hash FROM plain_text SEMI JOIN taken USING (tenant_id, document_id)"""
SQL["stream_index_refresh"] = f"""
SELECT tenant_id, count(*) AS n, round(avg(len({tokens('plain')})), 6) AS avg_len FROM plain_text SEMI JOIN taken USING (tenant_id, document_id) GROUP BY ALL"""
SQL["stream_index_frequencies"] = f"""
SELECT tenant_id, term, count(*) AS df FROM (
  SELECT tenant_id, unnest(list_distinct({tokens('plain')})) AS term FROM plain_text SEMI JOIN taken USING (tenant_id, document_id)) GROUP BY ALL"""
# Stores in versions hold what the operators give.
SQL["vector_store_upsert"] = SQL["upsert_chunks"]
SQL["vector_store_delete"] = SQL["delete_documents"]
SQL["vector_store_before_delete"] = "SELECT chunk_id, tenant_id, document_id FROM chunks_full"
SQL["graph_store_sync"] = SQL["graph_sync"]
