"""SQL for DuckDB for the queries that SQL can express."""

from __future__ import annotations

COMPONENTS = """r AS (SELECT id AS node, id AS root FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.root = e.a),
  c AS (SELECT node, min(root) AS component FROM r GROUP BY node)"""

OP2 = f"""WITH RECURSIVE v AS (SELECT DISTINCT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
  n AS (SELECT DISTINCT id FROM v),
  e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
  {COMPONENTS}, k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id,
  coalesce(coalesce(component, vec_id) = vec_id, false) AS kept
FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN k ON a = vec_id"""

OP5 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS k FROM w WHERE len(w) > 0),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s FROM i),
  z AS (SELECT doc_id AS id, count(*) AS z FROM s GROUP BY doc_id), n AS (SELECT id FROM z),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 100 * shared >= 80 * (x.z + y.z - shared)),
  {COMPONENTS}
SELECT doc_id, CAST(coalesce(z, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id,
  coalesce(coalesce(component, doc_id) = doc_id, false) AS kept
FROM documents LEFT JOIN z ON id = doc_id LEFT JOIN c ON node = doc_id"""

OP10 = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
  q AS (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS p FROM d),
  l AS (SELECT doc_id, p, s[p] AS line, list_distinct(list_filter(string_split(lower(s[p]), ' '), lambda t: t <> '')) AS t FROM q),
  f AS (SELECT row_number() OVER (ORDER BY doc_id, p) AS id, doc_id, p, t, len(t) AS n FROM l WHERE len(t) > 0),
  g AS (SELECT list_sort(t) AS k, min(id) AS id FROM f GROUP BY 1), u AS (SELECT f.* FROM f JOIN g USING (id)),
  t AS (SELECT id, n, unnest(t) AS t FROM u), r AS (SELECT t, count(*) AS df FROM t GROUP BY t),
  o AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS place FROM t JOIN r USING (t)),
  x AS (SELECT * FROM o WHERE place <= n - CAST(ceil(n * 80 / 100.0) AS BIGINT) + 1),
  c AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS m, b.n AS n FROM x a JOIN x b ON a.t = b.t AND a.id < b.id),
  h AS (SELECT c.a, c.b, any_value(c.m) AS m, any_value(c.n) AS n, count(*) AS shared FROM c JOIN t y ON y.id = c.a JOIN t z ON z.id = c.b AND y.t = z.t GROUP BY 1, 2),
  gone AS (SELECT b AS id FROM h WHERE 100 * shared >= 80 * (m + n - shared) UNION SELECT f.id FROM f ANTI JOIN g USING (id)),
  kept AS (SELECT l.doc_id, l.p, l.line, v.id IS NOT NULL AS gone FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.p = l.p LEFT JOIN gone v ON v.id = f.id)
SELECT doc_id, CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') END AS text,
  CAST(count_if(gone) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY doc_id"""

SQL = {"op2_embeddings": OP2, "op5_minhash": OP5, "op10_lines": OP10}
