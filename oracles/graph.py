"""Checks of the knowledge graph."""

from __future__ import annotations

from corpusloom.functions import patterns as P
from oracles.ctes import CTES, _FIELDS, lit, normal

SQL: dict[str, str] = {}

_norm = "coalesce(regulation_number, document_title, filename)"
CTES["edge_meta"] = f"""
SELECT tenant_id, document_id, filename, status, 1 AS emit_order, 'identifica' AS relation, 'documento' AS source_kind, filename AS source_name, 'norma' AS target_kind, {_norm} AS target_name, 'cabeçalho' AS source_span, 1.0::double AS confidence FROM meta
UNION ALL SELECT tenant_id, document_id, filename, status, 2, 'emitida_por', 'norma', {_norm}, 'fonte', authority, 'cabeçalho', 1.0 FROM meta WHERE authority IS NOT NULL
UNION ALL SELECT tenant_id, document_id, filename, status, 3, 'emitida_por', 'norma', {_norm}, 'orgao', authority, 'cabeçalho', 1.0 FROM meta WHERE authority IS NOT NULL
UNION ALL SELECT tenant_id, document_id, filename, status, 4, 'possui_status', 'norma', {_norm}, 'vigencia', status, 'cabeçalho', 1.0 FROM meta"""
_hit = " UNION ALL ".join(
    f"SELECT *, {i} AS i, {lit(name)} AS topic FROM g_chunks WHERE "
    + " OR ".join(f"contains(lower(body), {lit(a)})" for a in aliases)
    for i, (name, aliases) in enumerate(P.TOPICS)
)
CTES["hits"] = f"""
SELECT h.tenant_id, h.document_id, h.chunk, h.i, h.topic, m.filename, m.status, {_norm.replace('regulation_number', 'm.regulation_number').replace('document_title', 'm.document_title').replace('filename', 'm.filename')} AS norma,
  coalesce(nullif(concat_ws(', ', h.article, h.paragraph, h.inciso, h.alinea), ''), h.section, h.chapter, h.title, 'trecho') AS span
FROM ({_hit}) h JOIN meta m USING (tenant_id, document_id)"""
CTES["edge_topics"] = """
SELECT tenant_id, document_id, filename, status, chunk * 1000 + i * 3 AS emit_order, 'trata_de' AS relation, 'documento' AS source_kind, filename AS source_name, 'tema' AS target_kind, topic AS target_name, span AS source_span, 1.0::double AS confidence FROM hits
UNION ALL SELECT tenant_id, document_id, filename, status, chunk * 1000 + i * 3 + 1, 'regula', 'norma', norma, 'assunto', topic, span, 1.0 FROM hits
UNION ALL SELECT tenant_id, document_id, filename, status, chunk * 1000 + i * 3 + 2, 'evidencia_vem_de', 'evidencia', concat(filename, '::', span), 'documento', filename, span, 1.0 FROM hits"""
CTES["edge_pairs"] = """
SELECT a.tenant_id, a.document_id, a.filename, a.status, a.chunk * 1000 + 500 + a.i * 10 + b.i AS emit_order, 'relacionado_a' AS relation, 'conceito' AS source_kind, a.topic AS source_name,
  'conceito' AS target_kind, b.topic AS target_name, a.span AS source_span, 0.6::double AS confidence
FROM hits a JOIN hits b ON a.tenant_id = b.tenant_id AND a.document_id = b.document_id AND a.chunk = b.chunk AND a.i < b.i"""
CTES["edges_raw"] = "SELECT * FROM edge_meta UNION ALL SELECT * FROM edge_topics UNION ALL SELECT * FROM edge_pairs"
CTES["edges_named"] = f"SELECT *, {normal('source_name')} AS source_norm, {normal('target_name')} AS target_norm FROM edges_raw"
CTES["edges_ids"] = """
SELECT *, sha256(concat_ws('|', tenant_id, document_id, source_id, relation, target_id)) AS edge_id FROM (
 SELECT *, sha256(concat_ws('|', tenant_id, source_kind, source_norm)) AS source_id, sha256(concat_ws('|', tenant_id, target_kind, target_norm)) AS target_id FROM edges_named)"""
CTES["edges"] = """
SELECT *, CASE WHEN status IN ('vigente_confirmada', 'revogada_confirmada') AND confidence >= 1 THEN 'validada' ELSE 'pendente_de_validacao' END AS validation_status
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, document_id, edge_id ORDER BY emit_order) AS rn FROM edges_ids) WHERE rn = 1"""
CTES["ents"] = """
SELECT tenant_id, entity_id, kind, name_normalized, first(name ORDER BY document_id, emit_order, e) AS name FROM (
 SELECT tenant_id, document_id, emit_order, 0 AS e, source_id AS entity_id, source_kind AS kind, source_norm AS name_normalized, source_name AS name FROM edges
 UNION ALL SELECT tenant_id, document_id, emit_order, 1, target_id, target_kind, target_norm, target_name FROM edges) GROUP BY ALL"""
_rows = ", ".join(
    f"({lit(n)}, {i}, {lit(a)})" for n, al in P.ENTITY_ALIASES.items() for i, a in enumerate(al)
)
CTES["alias_list"] = f"SELECT *, {normal('alias')} AS alias_normalized FROM (VALUES {_rows}) t(name_normalized, position, alias)"
CTES["aliases"] = """
SELECT tenant_id, entity_id, kind, alias, alias_normalized FROM (
 SELECT *, row_number() OVER (PARTITION BY tenant_id, alias_normalized ORDER BY entity_id, position) AS rn
 FROM ents JOIN alias_list USING (name_normalized) WHERE alias_normalized <> name_normalized) WHERE rn = 1"""

_out = "tenant_id, document_id, emit_order, relation, source_kind, source_name, target_kind, target_name, source_span"
SQL["edges_from_metadata"] = f"SELECT {_out} FROM edge_meta"
SQL["edges_from_topics"] = f"SELECT {_out} FROM edge_topics"
SQL["topic_cooccurrence"] = f"SELECT {_out}, confidence FROM edge_pairs"
SQL["edge_dedup"] = f"SELECT edge_id, {_out} FROM edges"
SQL["edge_status"] = "SELECT tenant_id, edge_id, validation_status FROM edges"
SQL["resolve_entities"] = "SELECT tenant_id, entity_id, kind, name_normalized, name FROM ents"
SQL["expand_aliases"] = "SELECT * FROM aliases"

CTES["g_words"] = f"""
SELECT DISTINCT tenant_id, query_id, word FROM (SELECT tenant_id, query_id, {normal('w')} AS word FROM (
 SELECT tenant_id, query_id, unnest(regexp_split_to_array(question, '\\s+')) AS w FROM routed WHERE use_graph)) WHERE length(word) >= 3"""
CTES["g_names"] = """
SELECT DISTINCT tenant_id, source_id AS id, source_norm AS name FROM edges UNION SELECT DISTINCT tenant_id, target_id, target_norm FROM edges
UNION SELECT tenant_id, entity_id, alias_normalized FROM aliases"""
CTES["g_found"] = "SELECT DISTINCT w.tenant_id, w.query_id, n.id FROM g_words w JOIN g_names n ON w.tenant_id = n.tenant_id AND contains(n.name, w.word)"
CTES["g_search"] = """
SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY tenant_id, query_id ORDER BY edge_id) AS int) AS edge_rank FROM (
 SELECT DISTINCT f.tenant_id, f.query_id, e.edge_id, e.document_id, e.relation, e.source_span FROM g_found f JOIN edges e ON e.tenant_id = f.tenant_id AND (e.source_id = f.id OR e.target_id = f.id)
 WHERE e.validation_status <> 'rejeitada')) WHERE edge_rank <= 8"""
SQL["graph_search"] = "SELECT tenant_id, query_id, edge_id, relation, edge_rank FROM g_search"
CTES["g_scored"] = """
SELECT s.tenant_id, s.query_id, s.edge_rank, list(c.chunk_id ORDER BY
   CASE WHEN s.source_span <> '' AND (contains(coalesce(c.article, ''), s.source_span) OR contains(s.source_span, coalesce(c.article, ''))) THEN 2 ELSE 1 END DESC, c.chunk) AS ids
FROM g_search s JOIN chunks_full c USING (tenant_id, document_id) GROUP BY ALL"""
CTES["g_lists"] = """
SELECT tenant_id, query_id, list_reduce(list_concat([[]::varchar[]], list(ids ORDER BY edge_rank)), lambda acc, e: list_concat(acc, list_filter(e, lambda x: NOT list_contains(acc, x))[1:2]))[1:12] AS l
FROM g_scored GROUP BY ALL"""
CTES["graph_hits"] = "SELECT tenant_id, query_id, unnest(l) AS chunk_id, cast(generate_subscripts(l, 1) AS int) AS graph_rank, 0.5::double AS score FROM g_lists"
SQL["graph_to_chunks"] = "SELECT tenant_id, query_id, chunk_id, graph_rank, score FROM graph_hits"
