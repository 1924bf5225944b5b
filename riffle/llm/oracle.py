"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"

_OP1 = f"""
WITH v AS (
  SELECT row_number() OVER () AS mark, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE {_FINITE}
), scored AS (
  SELECT a.mark, a.vec_id AS query_id, b.vec_id,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.mark <> b.mark
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mark ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_OP10 = f"""
WITH v AS (SELECT row_number() OVER () AS mark, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_FINITE}),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS length FROM v WHERE list_inner_product(e, e) > 0),
scored AS (
  SELECT a.mark, a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) / (a.length * b.length) AS score
  FROM n a JOIN n b ON a.vec_id % 50 = 0 AND a.mark <> b.mark
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mark ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


_OP7 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS newest FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM g
"""


_OP11 = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS failed
  FROM t LEFT JOIN l USING (doc_id)
), cells AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM d GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, s AS step, filter_order[s] AS f, filter_order[1:s - 1] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) AS fails,
         len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND failed <> '' AND before <> '' AS gone
  FROM cells, steps
), told AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE failed = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""


_OP12 = r"""
WITH crc AS (
  SELECT c, xor(list_reduce(
    list_concat([4294967295], flatten([list_concat([ord(x)], [-1, -1, -1, -1, -1, -1, -1, -1]) FOR x IN string_split(CAST(c AS VARCHAR), '')])),
    lambda acc, y: CASE WHEN y >= 0 THEN xor(acc, y) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END
  ), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
), held AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT crc.c, list_concat(coalesce(lead.turns[1:h], []), own.turns[h + 1:]) AS turns
  FROM crc JOIN held own ON own.c = crc.c LEFT JOIN held lead ON lead.c = crc.c - crc.c % 20
), steps AS (
  SELECT c, d, turns[1:d] AS prefix, len(turns) AS n FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)
), nodes AS (
  SELECT d, prefix, min(c) AS node, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM steps GROUP BY d, prefix
), parents AS (
  SELECT nodes.*, up.node AS parent FROM nodes LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.prefix = nodes.prefix[1:nodes.d - 1]
), children AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM parents WHERE d > 0 GROUP BY ALL),
known AS (
  SELECT parents.d, parents.node, parent, n_convs, words, ends_sha256, coalesce(n_children, 0) AS n_children
  FROM parents LEFT JOIN children ON children.d = parents.d AND children.node = parents.node
), walk AS (
  SELECT s.c, s.d, m.node FROM steps s JOIN nodes m ON m.d = s.d AND m.prefix = s.prefix
), sums AS (
  SELECT w.d, w.node, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved
  FROM known k JOIN walk w ON w.c = k.node AND w.d <= k.d GROUP BY w.d, w.node
)
SELECT k.node AS conv_id, CAST(k.d AS BIGINT) AS depth, k.parent AS parent_conv_id, k.n_convs,
       CAST(k.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON s.d = k.d AND s.node = k.node
"""


_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
  ) AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS grams FROM w
), u AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS met FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.met
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id
FROM s JOIN (SELECT doc_id, min(met) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def sql() -> dict[str, str]:
    return {
        "op1_bit_sliced_topk": _OP1,
        "op7_warc_transactions": _OP7,
        "op8_ngram_join": _OP8,
        "op10_int8_neighbours": _OP10,
        "op11_filter_shapley": _OP11,
        "op12_conversation_trie": _OP12,
    }
