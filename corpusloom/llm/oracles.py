"""SQL (DuckDB) for those registered queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.preferences import BREAK, END, START


def _rendered(turns: str) -> str:
    text = f"'{START}' || t.role || chr(10) || t.text || '{END}' || chr(10)"
    return f"coalesce(list_aggregate(list_transform({turns}, lambda t: {text}), 'string_agg', ''), '')"


def _mask(turns: str) -> str:
    head = f"(length('{START}' || t.role) + 1)::varchar || ':0,'"
    said = f"(length(t.text) + {len(END)})::varchar || CASE WHEN t.role = 'assistant' THEN ':1,' ELSE ':0,' END"
    return f"coalesce(list_aggregate(list_transform({turns}, lambda t: {head} || {said} || '{len(BREAK)}:0'), 'string_agg', ','), '')"


OP3 = f"""
WITH last AS (
  SELECT conv_id, max(turn) AS at, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), swapped AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = l.at THEN o.reply ELSE c.text END AS text
  FROM conversations c LEFT JOIN last l USING (conv_id) LEFT JOIN last o ON o.conv_id = xor(c.conv_id, 1)
  WHERE NOT (c.role = 'assistant' AND c.turn = l.at AND o.conv_id IS NULL) OR l.at IS NULL
), c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS c FROM conversations GROUP BY conv_id
), r AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS r FROM swapped GROUP BY conv_id
), both_sides AS (
  SELECT conv_id, c, coalesce(r, []) AS r, least(len(c), len(coalesce(r, []))) AS most FROM c LEFT JOIN r USING (conv_id)
), cut AS (
  SELECT conv_id, c, r, coalesce(list_position(list_transform(range(1, most + 1), lambda i: c[i] = r[i]), false) - 1, most)::int AS n
  FROM both_sides
)
SELECT conv_id AS pair_id, n AS prompt_turns, {_rendered("c[1:n]")} AS prompt,
  {_rendered("c[n + 1:]")} AS chosen, {_rendered("r[n + 1:]")} AS rejected,
  {_mask("c[n + 1:]")} AS chosen_mask, {_mask("r[n + 1:]")} AS rejected_mask
FROM cut
"""

OP6 = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(digits, {5 * part + 1}, 5))::bigint >> {shift}) & 31)::int + 1, 1)"
    for part in range(8)
    for shift in (15, 10, 5, 0)
)

OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::bigint AS payload_bytes, sha1(html) AS digits, min(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM h
"""


def _crc32(text: str) -> str:
    """Checksum of a short ASCII text, bit by bit."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::ubigint)"
    shifted = "list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda x, k: xor(x >> 1, 3988292384::ubigint * (x & 1)))"
    return f"xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, {codes}), lambda c, b: {shifted}))"


OP12 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(strlen(role)::varchar || ':' || role || text)) AS turns,
    ({_crc32("conv_id::varchar")} % 6)::bigint AS h
  FROM t GROUP BY conv_id
), grown AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM grown)
), node AS (
  SELECT prefix, d, min(conv_id) AS conv, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
  FROM prefixes GROUP BY prefix, d
), child AS (
  SELECT prefix[1:d - 1] AS prefix, count(*) AS children FROM node WHERE d > 0 GROUP BY 1
), valued AS (
  SELECT n.*, coalesce(c.children, 0) AS children,
    CASE WHEN n.d > 0 THEN (n.n - 1) * length(n.prefix[n.d].text) ELSE 0 END AS saved
  FROM node n LEFT JOIN child c ON c.prefix = n.prefix
), under AS (
  SELECT prefix[1:up] AS prefix, sum(saved)::bigint AS saved, sum((children = 0)::int)::bigint AS leaves
  FROM (SELECT prefix, saved, children, unnest(range(0, d + 1)) AS up FROM valued) GROUP BY 1
)
SELECT v.conv AS conv_id, v.d AS depth, p.conv AS parent_conv_id, v.n AS n_convs, v.children AS n_children,
  u.leaves AS n_leaves, u.saved AS saved_tokens, v.ends AS ends_sha256
FROM valued v JOIN under u ON u.prefix = v.prefix LEFT JOIN node p ON v.d > 0 AND p.prefix = v.prefix[1:v.d - 1]
"""


def _leaf(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in columns) + ")"


def _levels(name: str, start: str) -> str:
    """All nodes above ``start`` (grp, level, pos, n, h), and each node's siblings to the left and right."""
    return f"""{name} AS (
  SELECT grp, 0::bigint AS level, pos, n, h FROM {start}
  UNION ALL
  SELECT grp, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 3, n
), {name}_sides AS (
  SELECT grp, level, pos, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY grp, level, pos // 3 ORDER BY pos)
)"""


def _folded(name: str, start: str, sides: str) -> str:
    """Rows of ``start`` (grp, row, at, h, proof) taken level by level to the top of their group."""
    return f"""{name} AS (
  SELECT *, 0::bigint AS level FROM {start}
  UNION ALL
  SELECT f.grp, f.row, f.at // 3, sha256(s.l || f.h || s.r), f.proof || s.l || s.r, f.level + 1
  FROM {name} f JOIN {sides} s ON s.grp = f.grp AND s.level = f.level AND s.pos = f.at
), {name}_top AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY grp, row ORDER BY level DESC) = 1)"""


OP13 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    {_leaf("doc_id", "source", "lang", "n_chars", "bare")} AS presented
  FROM (SELECT *, CASE WHEN {_crc32("doc_id::varchar")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bare FROM documents)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaf
), bottom AS (SELECT grp, pos, n, leaf AS h FROM placed),
{_levels("node", "bottom")},
subroot AS (
  SELECT '' AS grp, grp AS member, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
),
{_levels("top", "subroot")},
presented AS (SELECT grp, pos AS row, pos AS at, presented AS h, '' AS proof FROM placed),
{_folded("inner_fold", "presented", "node_sides")},
lifted AS (
  SELECT '' AS grp, f.grp || ' ' || f.row AS row, s.pos AS at, f.h, f.proof FROM inner_fold_top f JOIN subroot s ON s.member = f.grp
),
{_folded("outer_fold", "lifted", "top_sides")}
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroot s ON s.member = p.grp JOIN (SELECT h FROM top WHERE n = 1) t ON true
  JOIN outer_fold_top f ON f.row = p.grp || ' ' || p.pos
"""

ORACLES = {
    "op3_preference_format": OP3,
    "op6_impact_search": OP6,
    "op10_warc_revisits": OP10,
    "op12_prefix_trie": OP12,
    "op13_merkle_manifest": OP13,
}
