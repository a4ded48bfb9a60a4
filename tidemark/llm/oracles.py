"""DuckDB twins of the registered queries, where SQL can express them."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k
         FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS m FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 50)) AS j
         FROM wins JOIN firsts USING (k) WHERE m < doc_id)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

#: Links by counting common shingles; the classes of a link chain by a recursive walk.
MINHASH_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
walk AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT walk.doc_id, v FROM walk JOIN links ON seen = u),
c AS (SELECT doc_id, min(seen) AS component_id FROM walk GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
