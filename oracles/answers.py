"""Checks of the answer audit, audit log and telemetry."""

from __future__ import annotations

from corpusloom.functions import patterns as P
from oracles.ctes import CTES, EDGE, lit, normal, strip

SQL: dict[str, str] = {}

CTES["ans"] = """
SELECT d.tenant_id, c.conv_id * 1000 + c.turn AS answer_id, d.document_id, c.conv_id,
  concat(c.text, CASE c.conv_id % 4 WHEN 0 THEN ' [Fonte 1].' WHEN 1 THEN ' [Fontes 1, 3]. O estabelecimento deve manter registro.' WHEN 2 THEN ' Conforme [Fonte 9].' ELSE '' END) AS answer,
  CASE WHEN c.conv_id % 6 = 0 THEN 'length' ELSE 'stop' END AS done_reason, 3000 + (c.conv_id * 37 + c.turn * 11) % 1200 AS used
FROM conversations c JOIN raw_docs d ON d.doc_id = c.conv_id WHERE c.role = 'assistant'"""
CTES["ctx"] = """
SELECT a.tenant_id, a.answer_id, k.chunk AS source_no, round(0.4::double + 0.1::double * ((a.conv_id + k.chunk) % 6), 6) AS score, k.status,
  CASE WHEN k.chunk = 3 THEN concat('Lei ', cast(a.conv_id AS varchar)) ELSE k.regulation_number END AS norm, CASE WHEN a.conv_id % 5 = 0 THEN 'Art. 1' ELSE k.article END AS article, k.filename
FROM ans a JOIN chunks_full k USING (tenant_id, document_id) WHERE k.chunk <= 4"""
_cit = r"[\[(]\s*fontes?\s*([0-9]+(?:\s*(?:,|e|;|-)\s*[0-9]+)*)\s*[\])]"
CTES["cites"] = f"""
SELECT tenant_id, answer_id, n, min(pos) AS pos FROM (SELECT tenant_id, answer_id, cast(unnest(ns) AS int) AS n, generate_subscripts(ns, 1) AS pos FROM (
  SELECT tenant_id, answer_id, flatten(list_transform(regexp_extract_all(answer, {lit('(?i)' + _cit)}, 1), lambda s: regexp_extract_all(s, '\\d+'))) AS ns FROM ans)) GROUP BY ALL"""
SQL["extract_citations"] = """
SELECT a.tenant_id, a.answer_id, coalesce(string_agg(cast(n AS varchar), ',' ORDER BY pos), '') AS cited FROM ans a LEFT JOIN cites USING (tenant_id, answer_id) GROUP BY ALL"""
CTES["n_src"] = "SELECT tenant_id, answer_id, count(*) AS total FROM ctx GROUP BY ALL"
CTES["judged"] = """
SELECT c.*, coalesce(total, 0) AS total, n >= 1 AND n <= coalesce(total, 0) AS valid FROM cites c LEFT JOIN n_src USING (tenant_id, answer_id)"""
SQL["citation_validity"] = """
SELECT a.tenant_id, a.answer_id, coalesce(string_agg(cast(n AS varchar), ',' ORDER BY pos) FILTER (valid), '') AS valid,
  coalesce(string_agg(cast(n AS varchar), ',' ORDER BY pos) FILTER (NOT valid), '') AS invalid FROM ans a LEFT JOIN judged USING (tenant_id, answer_id) GROUP BY ALL"""
CTES["cited_src"] = "SELECT j.pos, x.* FROM judged j JOIN ctx x ON x.tenant_id = j.tenant_id AND x.answer_id = j.answer_id AND x.source_no = j.n WHERE j.valid"
CTES["conflicted"] = """
SELECT DISTINCT tenant_id, answer_id FROM (SELECT tenant_id, answer_id, lower(trim(article)) AS a FROM cited_src WHERE trim(coalesce(article, '')) <> '' AND trim(coalesce(norm, '')) <> ''
GROUP BY ALL HAVING count(DISTINCT trim(norm)) > 1)"""
SQL["citation_conflicts"] = "SELECT a.tenant_id, a.answer_id, c.answer_id IS NOT NULL AS conflict FROM ans a LEFT JOIN conflicted c USING (tenant_id, answer_id)"
CTES["src_facts"] = "SELECT tenant_id, answer_id, bool_or(coalesce(status, '') <> 'vigente_confirmada') AS unverified, max(score) AS best FROM cited_src GROUP BY ALL"
SQL["unverified_citations"] = "SELECT a.tenant_id, a.answer_id, coalesce(unverified, false) AS unverified FROM ans a LEFT JOIN src_facts USING (tenant_id, answer_id)"
SQL["borderline_score"] = "SELECT a.tenant_id, a.answer_id, coalesce(best, 0) AS best_score, coalesce(best, 0) < 0.45::double + 0.1::double AS borderline FROM ans a LEFT JOIN src_facts USING (tenant_id, answer_id)"


def _worded(pattern: str) -> str:
    body = pattern[pattern.index(")") + 1:]
    assert body.startswith(r"\b") and body.endswith(r"\b")
    return lit("(?i)" + EDGE + body[2:-2] + r"(?:$|[^\p{L}\p{N}_])")


CTES["sents"] = f"""
SELECT tenant_id, answer_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM (
 SELECT tenant_id, answer_id, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '') AS ps FROM ans)"""
CTES["sents2"] = f"""
SELECT *, lead(leads) OVER (PARTITION BY tenant_id, answer_id ORDER BY i) AS nxt FROM (
 SELECT *, CASE WHEN leads THEN {strip("regexp_replace(s, " + lit('(?i)^' + _cit) + ", '')")} ELSE s END AS t FROM (
  SELECT *, i > 1 AND regexp_matches(s, {lit('(?i)^' + _cit)}) AS leads FROM sents))"""
CTES["unsup"] = f"""
SELECT tenant_id, answer_id, count(*) AS n FROM sents2 WHERE t <> '' AND NOT regexp_matches(t, {lit('(?i)' + _cit)}) AND NOT coalesce(nxt, false)
 AND (regexp_matches(t, {_worded(P.ASSERTION)}) OR regexp_matches(t, {_worded(P.HEDGE)})) GROUP BY ALL"""
SQL["unsupported_assertions"] = "SELECT a.tenant_id, a.answer_id, cast(coalesce(n, 0) AS int) AS unsupported FROM ans a LEFT JOIN unsup USING (tenant_id, answer_id)"
CTES["audited"] = f"""
SELECT a.*, grounded, list_filter([
  CASE WHEN inv IS NOT NULL THEN {lit(P.REASON_INVALID)} || inv END, CASE WHEN NOT grounded THEN {lit(P.REASON_NONE_VALID)} END,
  CASE WHEN grounded AND cf THEN {lit(P.REASON_CONFLICT)} END, CASE WHEN grounded AND uv THEN {lit(P.REASON_UNVERIFIED)} END,
  CASE WHEN grounded AND un > 0 THEN cast(un AS varchar) || {lit(P.REASON_UNSUPPORTED)} END, CASE WHEN grounded AND best < 0.45::double + 0.1::double THEN {lit(P.REASON_BORDERLINE)} END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT a.*, coalesce(v.n, 0) > 0 AS grounded, v.inv, c.answer_id IS NOT NULL AS cf, coalesce(f.unverified, false) AS uv, coalesce(f.best, 0) AS best, coalesce(u.n, 0) AS un, coalesce(s.total, 0) AS total
 FROM ans a LEFT JOIN (SELECT tenant_id, answer_id, count(*) FILTER (valid) AS n, string_agg(cast(n AS varchar), ', ' ORDER BY pos) FILTER (NOT valid) AS inv FROM judged GROUP BY ALL) v USING (tenant_id, answer_id)
 LEFT JOIN conflicted c USING (tenant_id, answer_id) LEFT JOIN src_facts f USING (tenant_id, answer_id) LEFT JOIN unsup u USING (tenant_id, answer_id) LEFT JOIN n_src s USING (tenant_id, answer_id)) a"""
SQL["audit_answers"] = "SELECT tenant_id, answer_id, grounded, len(reasons) > 0 AS requires_review, array_to_string(reasons, ' | ') AS reasons FROM audited"
SQL["final_answers"] = f"""
SELECT a.tenant_id, a.answer_id, CASE WHEN grounded THEN answer ELSE {lit(P.NO_EVIDENCE_ANSWER)} END AS final_answer, coalesce(fs, '') AS cited_sources
FROM audited a LEFT JOIN (SELECT tenant_id, answer_id, string_agg(filename, ',' ORDER BY pos) AS fs FROM cited_src GROUP BY ALL) USING (tenant_id, answer_id)"""
CTES["flagged"] = f"""
SELECT *, list_filter([CASE WHEN done_reason = 'length' THEN 'truncated_output' END, CASE WHEN used >= 4014 THEN 'context_full' END, CASE WHEN used < 4014 AND used + 450 > 4096 THEN 'context_tight' END], lambda x: x IS NOT NULL) AS flags,
  list_concat(reasons, list_filter([CASE WHEN done_reason = 'length' THEN {lit(P.REASON_CUT)} END, CASE WHEN used >= 4014 THEN {lit(P.REASON_FULL)} END], lambda x: x IS NOT NULL)) AS all_reasons FROM audited"""
SQL["generation_flags"] = "SELECT tenant_id, answer_id, array_to_string(flags, ',') AS flags, len(all_reasons) > 0 AS requires_review, array_to_string(all_reasons, ' | ') AS reasons FROM flagged"
CTES["outcomes_a"] = "SELECT *, CASE WHEN total = 0 THEN 'no_context' WHEN grounded AND len(all_reasons) = 0 THEN 'grounded' ELSE 'needs_review' END AS outcome FROM flagged"
SQL["answer_outcome"] = "SELECT tenant_id, answer_id, outcome FROM outcomes_a"
_abst = " OR ".join(f"contains({normal('fa')}, {lit(m)})" for m in P.ABSTENTION_MARKERS)
SQL["detect_abstention"] = f"SELECT tenant_id, answer_id, {_abst} AS abstained FROM (SELECT tenant_id, answer_id, CASE WHEN grounded THEN answer ELSE {lit(P.NO_EVIDENCE_ANSWER)} END AS fa FROM audited)"
SQL["keyword_coverage"] = f"""
SELECT a.tenant_id, a.answer_id, CASE WHEN len(ks) > 0 THEN round(len(list_filter(ks, lambda k: contains({normal('answer')}, {normal('k')}))) / len(ks), 3) END AS keyword_coverage
FROM ans a LEFT JOIN (SELECT conv_id, string_split(first(text ORDER BY turn), ' ')[1:5] AS ks FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (conv_id)"""
_mean = lambda x, f="true": f"round(avg({x}) FILTER ({f}), 2)"
SQL["generation_summary"] = f"""
SELECT event_type AS "group", count(*) AS cases_total, count(*) FILTER (ok) AS cases_ok, count(*) FILTER (NOT ok) AS cases_failed,
  round(avg(hit::int) FILTER (ask AND hit IS NOT NULL), 3) AS recall_at_5, count(*) FILTER (ask AND hit IS NOT NULL) AS recall_evaluated,
  round(avg((event_id % 5 > 0)::int) FILTER (ask AND ok AND gr), 3) AS citation_precision, round(avg(gr::int) FILTER (ask AND ok), 3) AS grounded_rate,
  round(avg((ok AND (event_id % 6 = 0 OR NOT gr))::int) FILTER (NOT ask), 3) AS abstention_accuracy, round(avg(kc) FILTER (ask), 3) AS keyword_coverage,
  coalesce(round(quantile_cont(ms::double, 0.5) FILTER (ok), 2), 0) AS p50, coalesce(round(quantile_cont(ms::double, 0.95) FILTER (ok), 2), 0) AS p95, {_mean('ms', 'ok')} AS mean,
  {_mean('event_id % 9', 'ok AND event_id % 9 <> 0')} AS embedding_mean, {_mean('event_id % 11', 'ok AND event_id % 11 <> 0')} AS model_load_mean,
  {_mean('floor(value)', 'ok AND floor(value) <> 0')} AS generation_mean, {_mean('value', 'ok AND value <> 0')} AS tokens_per_second_mean
FROM (SELECT *, event_id % 4 <> 0 AS ask, event_id % 10 <> 0 AS ok, event_id % 3 <> 0 AS gr, CASE WHEN event_id % 7 <> 0 THEN value > 20 END AS hit,
  CASE WHEN event_id % 2 = 0 THEN round(user_id / 150.0::double, 3) END AS kc, cast(floor(value * 10) AS bigint) AS ms FROM events) GROUP BY event_type"""

# ------------------------------------------------------------------ telemetry

CTES["log"] = """
SELECT event_id, concat(cast(user_id AS varchar), '-', strftime(ts, '%Y%m%d')) AS request_id, concat('src', cast(user_id % 20 AS varchar)) AS tenant_id,
  CASE event_type WHEN 'view' THEN 'chat.requested' WHEN 'click' THEN 'chat.completed' WHEN 'purchase' THEN 'document.upload.requested' WHEN 'signup' THEN 'document.upload.completed' ELSE 'chat.failed' END AS action,
  props AS query_text, ts AS created_at, value AS duration_ms FROM events"""
_pseudo = "concat('sha256:', sha256(query_text), ':len=', cast(length(query_text) AS varchar))"
SQL["pseudonymize_queries"] = f"SELECT event_id, {_pseudo} AS query_text FROM log"
SQL["prune_expired"] = "SELECT event_id, tenant_id FROM log WHERE created_at >= TIMESTAMP '2024-01-16 00:00:00'"
SQL["recent_audit"] = """
SELECT tenant_id, position, event_id, action FROM (SELECT *, cast(row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, event_id DESC) AS int) AS position FROM log) WHERE position <= 100"""
_bounds = ", ".join(f"('{float(b)}', {b}::double)" for b in P.STAGE_BUCKETS)
SQL["stage_histogram"] = f"""
SELECT e.event_type AS stage, b.le, count(*) FILTER (greatest(value / 1000.0::double, 0) <= b.v) AS cumulative, count(*) AS count, round(sum(value / 1000.0::double), 6) AS sum
FROM events e, (VALUES {_bounds}, ('+Inf', 'infinity'::double)) b(le, v) GROUP BY ALL"""
SQL["outcome_counts"] = """
SELECT metric, label, count(*) AS total FROM (SELECT 'outcome' AS metric, outcome AS label FROM outcomes_a UNION ALL SELECT 'flag', unnest(flags) FROM outcomes_a
UNION ALL SELECT 'trim', 'context' FROM outcomes_a WHERE conv_id % 3 = 0) GROUP BY ALL"""
SQL["model_throughput"] = """
SELECT event_id, td // 1000000 AS total_duration_ms, coalesce(ld // 1000000, 0) AS load_duration_ms, ed // 1000000 AS eval_duration_ms,
  CASE WHEN ed // 1000000 > 0 AND n > 0 THEN round(n / ((ed // 1000000) / 1000.0::double), 2) ELSE 0.0 END AS tokens_per_second
FROM (SELECT event_id, cast(trunc(value * 1000000000) AS bigint) AS td, CASE WHEN event_id % 3 > 0 THEN cast(trunc(value * 1000000) AS bigint) END AS ld, event_id % 5 * 400000 AS ed,
 CASE WHEN event_id % 7 > 0 THEN user_id ELSE 0 END AS n FROM events)"""
_calls = SQL["model_throughput"].replace("SELECT event_id, td", "SELECT n AS eval_count, event_id, td")
_made = "\nUNION ALL ".join(
    f"""SELECT '{metric}' AS metric, b.le, count(*) FILTER ({value} <= b.v) AS cumulative, count(*) AS count, round(sum({value}), 6)::double AS sum
FROM ({_calls}) c, (VALUES {", ".join(f"('{float(b)}', {b}::double)" for b in bounds)}, ('+Inf', 'infinity'::double)) b(le, v)
WHERE eval_count > 0 AND {value} > 0 GROUP BY ALL"""
    for metric, value, bounds in (
        ("tokens_per_second", "tokens_per_second", P.SPEED_BUCKETS),
        ("answer_tokens", "eval_count", P.LENGTH_BUCKETS),
    )
)
SQL["generation_histograms"] = _made
SQL["feedback_join"] = """
SELECT event_type AS stage, count(*) AS requests, count(quality) AS rated, round(avg((quality = 1)::int), 6) AS useful_rate
FROM events LEFT JOIN labels ON doc_id = event_id GROUP BY event_type"""
SQL["request_pairs"] = """
SELECT event_id, request_id, action FROM log l WHERE action LIKE '%.requested' AND NOT EXISTS (
  SELECT 1 FROM log c WHERE c.request_id = l.request_id AND c.action = replace(l.action, '.requested', '.completed'))"""
SQL["parse_json_logs"] = """
SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS ts, 'INFO' AS level, action AS msg, request_id, tenant_id, cast(floor(duration_ms) AS bigint) AS duration_ms FROM log"""

SQL["parse_log_variants"] = """
SELECT action AS msg, tenant_id, cast(floor(duration_ms) AS bigint) AS duration_ms, cast(event_id AS varchar) AS event FROM log"""

# ------------------------------------------------------------------ streams

CTES["gaps"] = """
SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"""
CTES["sess"] = "SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS events FROM gaps GROUP BY user_id, s"
_ms = lambda c: f"epoch_us({c})"
SQL["sessions_batch"] = f"SELECT user_id, {_ms('a')} AS start_us, {_ms('b')} AS last_us, events FROM sess"
SQL["stream_answers_early"] = """
SELECT * FROM (WITH told AS (
  SELECT *, concat(cast(user_id AS varchar), '-', strftime(ts, '%Y%m%d')) AS request_id FROM events
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS pos FROM told
), cut AS (
  SELECT request_id, min(pos) FILTER (event_type IN ('purchase', 'error')) AS stop FROM placed GROUP BY request_id
)
SELECT request_id, coalesce(trim(string_agg(' ' || cast(event_id AS varchar), '' ORDER BY event_id) FILTER (event_type IN ('view', 'click'))), '') AS answer,
  CASE max(CASE WHEN pos = stop THEN event_type END) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END AS status, count(*) AS events
FROM placed JOIN cut USING (request_id) WHERE pos <= coalesce(stop, pos) GROUP BY request_id)"""
# A request takes its slot if it is the first since the last completion, or six hours after the one that holds it.
SQL["stream_admitted_uploads"] = """
SELECT * FROM (WITH RECURSIVE moves AS (
  SELECT concat('src', cast(user_id % 20 AS varchar)) AS tenant_id, json_extract_string(props, '$.k') AS document_id, ts, event_id AS seq, event_type
  FROM events WHERE event_type IN ('purchase', 'signup')
), rounds AS (
  SELECT *, sum((event_type = 'signup')::int) OVER (PARTITION BY tenant_id, document_id ORDER BY ts, seq) AS round FROM moves
), asks AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, document_id, round ORDER BY ts, seq) AS n FROM rounds WHERE event_type = 'purchase'
), taken AS (
  SELECT * FROM asks WHERE n = 1
  UNION ALL
  SELECT * FROM (
    SELECT a.* FROM taken t JOIN asks a ON a.tenant_id = t.tenant_id AND a.document_id = t.document_id AND a.round = t.round
      AND a.ts >= t.ts + INTERVAL 6 HOUR
    QUALIFY row_number() OVER (PARTITION BY t.tenant_id, t.document_id, t.round, t.seq ORDER BY a.ts, a.seq) = 1)
)
SELECT tenant_id, document_id, seq FROM taken)"""
SQL["stream_sessions"] = f"SELECT user_id, {_ms('a')} AS start_us, {_ms('b')} AS last_us, events FROM sess"
SQL["stream_stage_metrics"] = """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, stage, count(*) AS n, round(sum(v), 6) AS seconds, round(max(v), 6) AS slowest
FROM (SELECT date_trunc('hour', ts) AS s, event_type AS stage, value / 1000.0::double AS v FROM events) GROUP BY ALL"""
SQL["stream_stage_metrics_sliding"] = """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, stage, count(*) AS n, round(sum(v), 6) AS seconds
FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - unnest([0, 30]) * INTERVAL 1 MINUTE AS s, event_type AS stage, value / 1000.0::double AS v FROM events) GROUP BY ALL"""
SQL["stream_audit_sink"] = f"SELECT event_id, tenant_id, request_id, action, {_pseudo} AS query_text FROM log"
SQL["append_audit"] = "SELECT event_id, tenant_id, request_id, action FROM log"
SQL["write_ndjson_events"] = "SELECT event_id, request_id, action FROM log"
SQL["stream_dedup_inflight"] = "SELECT DISTINCT concat('src', cast(user_id % 20 AS varchar)) AS tenant_id, json_extract_string(props, '$.k') AS document_id FROM events"
SQL["stream_assemble_answers"] = """
SELECT request_id, coalesce(trim(string_agg(' ' || cast(event_id AS varchar), '' ORDER BY event_id) FILTER (event_type IN ('view', 'click'))), '') AS answer,
  CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'completed' ELSE 'cancelled' END AS status, count(*) AS events
FROM (SELECT *, concat(cast(user_id AS varchar), '-', strftime(ts, '%Y%m%d')) AS request_id FROM events) GROUP BY request_id"""
