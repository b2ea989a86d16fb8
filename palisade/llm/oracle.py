"""DuckDB statements for the queries that SQL can tell, written in another way than the jobs."""

HARD_NEGATIVES = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM part a JOIN part b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id)::INT AS rank,
       s.row_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id) <= 5
"""

PREFIX_TRIE = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, (xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1),
             lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 4) AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), rebuilt AS (
  SELECT h.conv_id, o.nth, o.t FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.nth <= h.h
  UNION ALL
  SELECT h.conv_id, o.nth, o.t FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.nth > h.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY nth) AS depth, t FROM rebuilt
), paths AS (
  SELECT conv_id, depth, t, list(t) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, NULL, [] FROM heads
), lengths AS (
  SELECT conv_id, max(depth) AS last FROM paths GROUP BY conv_id
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256,
         any_value(CASE WHEN depth = 0 THEN 0
           ELSE len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')) END) AS words
  FROM paths JOIN lengths USING (conv_id) GROUP BY path
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
), subtree AS (
  SELECT n.path, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.words)::BIGINT AS saved_tokens
  FROM linked n JOIN linked d ON d.depth >= n.depth AND d.path[:n.depth] = n.path GROUP BY n.path
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM linked JOIN subtree USING (path)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_rows(name: str, table: str, key: str) -> str:
    """CTEs: ``name`` (key, n, g) has a row for each distinct 5-word shingle of each text."""
    return f"""
{name}_words AS (
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {table}
), {name}_sets AS (
  SELECT {key}, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM {name}_words
), {name} AS (SELECT {key}, len(s) AS n, unnest(s) AS g FROM {name}_sets)"""


DECONTAMINATION = f"""
WITH {shingle_rows("held", "documents", "doc_id")}, {shingle_rows("asked", "benchmark", "item_id")}
SELECT doc_id, item_id, any_value(a.n)::BIGINT AS n_item_shingles, count(*) AS n_shared
FROM held h JOIN asked a USING (g) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(a.n)
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE {shingle_rows("held", "documents", "doc_id")}, links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM held_sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x) USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), told AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*\|')) AS text_chars,
    length(marked) + len(regexp_extract_all(marked, '<\\*\|')) AS role_chars
  FROM (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS marked FROM given)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>') + role_chars + 1 + text_chars + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""

ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op3_ngram_jaccard": NGRAM_JACCARD,
    "op4_chat_format": CHAT_FORMAT,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_prefix_trie": PREFIX_TRIE,
}
