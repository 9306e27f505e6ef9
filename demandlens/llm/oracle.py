"""DuckDB SQL of the operators that SQL can express, over the same whole tables."""

ORACLE: dict[str, str] = {}

ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
     g AS (SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""

ORACLE["op6_decontamination"] = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS v, least(len(w), 10) AS n
  FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, i, sizes.n, array_to_string(w[i : i + sizes.n - 1], ' ') AS v
  FROM split, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.v = win.v AND pos.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(j) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_items,
               string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op4_substring_sketch"] = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS v FROM split, unnest(range(1, len(w) - 11)) AS t(i)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY v) AS first_id FROM win) WHERE first_id < doc_id),
word AS (SELECT DISTINCT doc_id, j FROM gone, unnest(range(i, i + 13)) AS t(j)),
cut AS (SELECT doc_id, count(*) AS n_removed, list(j) AS js FROM word GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, k: NOT coalesce(list_contains(js, k), false)), ' '), '')) AS kept_sha256
FROM split LEFT JOIN cut USING (doc_id)
"""

ORACLE["op8_ngram_jaccard"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS v
  FROM split, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM split UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM split s LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

ORACLE["op7_suffix_columns"] = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS v FROM b, unnest(range(0, length(h) // 2 - 399)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY v) AS n FROM win) WHERE n > 1),
edge AS (SELECT doc_id, i, i - coalesce(lag(i) OVER w, -1000000) AS gap FROM rep WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, sum(CASE WHEN gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY 1, 2),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS s, list(z ORDER BY a) AS e
  FROM span GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda k:
         substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE e[k] END) + 1,
                2 * ((CASE WHEN k = len(s) THEN length(h) // 2 ELSE s[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE e[k] END)))), '') END)) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
"""

ORACLE["op11_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLE["op12_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
total AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY 1, 2),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 2)) // (coalesce(total.total, 0) + 2 * sizes.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (kept.n + 2)) // (sizes.total + 2 * sizes.v))::BIGINT AS q
  FROM grp g JOIN kept USING (lang) JOIN sizes USING (lang)
  LEFT JOIN total USING (lang, source) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM cell WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLE["op13_infill"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT *, array_to_string(u[1 : least(c1, c2)], '') AS a, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1 : n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""
