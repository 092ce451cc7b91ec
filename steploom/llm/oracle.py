"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE = {
    "op1_decontaminate": r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), item AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), sized AS (
  SELECT item, w, least(len(w), 13) AS n FROM item WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM sized)
), spots AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM doc CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s, n, item FROM spots JOIN windows USING (n, win)
), covered AS (
  SELECT doc_id, count(DISTINCT at_word) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS at_word FROM (SELECT DISTINCT doc_id, s, n FROM hits))
  GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op4_embeddings": r"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(DISTINCT b) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
""",
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op9_warc_revisits": r"""
WITH page AS (
  SELECT page_id, url, coalesce(html, '') AS html, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 100000) AS moment,
         'day ' || (page_id % 50) AS modified
  FROM pages
), capture AS (
  SELECT page_id, page_id * 2 AS record_id, 0 AS revisit, url, moment, '"' || md5(html) || '"' AS tag,
         CASE WHEN page_id % 3 <> 0 THEN modified END AS modified, strlen(html)::VARCHAR AS length
  FROM page WHERE page_id % 9 <> 0
  UNION ALL
  SELECT page_id, page_id * 2 + 1, 1, CASE WHEN page_id % 2 = 0 THEN url || '#again'
                                           ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x' END,
         moment + to_hours(page_id % 5 - 1), CASE WHEN page_id % 4 <> 0 THEN '"' || md5(html) || '"' END,
         CASE WHEN page_id % 8 = 0 THEN 'another day' WHEN page_id % 4 = 0 THEN modified END, '0'
  FROM page
), cut AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS plain FROM capture
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[A-Za-z]+://([^/?]*)', 1)), ':(80|443)?$', ''), '^www\d*\.', '') AS host,
         regexp_replace(regexp_extract(plain, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(
           lower(regexp_extract(p, '^[^=]*')), '^(utm_[a-z]+|fbclid|gclid|jsessionid|phpsessid|sid|sessionid)$'))) AS params
  FROM cut
), canonical AS (
  SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS page FROM parts
), matched AS (
  SELECT v.page_id, v.record_id, v.moment, v.tag, v.modified, r.record_id AS refers_to, r.tag AS old_tag, r.modified AS old_modified,
         r.length AS old_length,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.moment DESC NULLS LAST, r.record_id DESC) AS n
  FROM (SELECT * FROM canonical WHERE revisit = 1) v
  LEFT JOIN (SELECT * FROM canonical WHERE revisit = 0) r ON v.page = r.page AND r.moment < v.moment
), judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'no_response' WHEN tag <> old_tag THEN 'etag_differs' WHEN tag = old_tag THEN 'resolved'
                 WHEN modified <> old_modified THEN 'modified_later' WHEN modified = old_modified THEN 'resolved'
                 ELSE 'no_validator' END AS outcome
  FROM matched WHERE n = 1
)
SELECT page_id, record_id, coalesce(refers_to, -1) AS refers_to, outcome,
       'cache-control=max-age=60; content-length=' || CASE WHEN outcome = 'resolved' THEN old_length || '; content-type=text/html' ELSE '0' END
       || '; date=' || strftime(moment, '%Y-%m-%d %H:%M:%S')
       || coalesce('; etag=' || coalesce('W/' || tag, CASE WHEN outcome = 'resolved' THEN old_tag END), '')
       || coalesce('; last-modified=' || coalesce(modified, CASE WHEN outcome = 'resolved' THEN old_modified END), '') AS headers
FROM judged
""",
    # Bytes come from the hexadecimal text; the checksum's table is made by its rule, eight steps a byte.
    "op13_sharding": r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8
), docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h,
         row_number() OVER (ORDER BY doc_id) - 1 AS row_number
  FROM documents
), sums AS (
  SELECT doc_id, n, row_number,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS crc
  FROM docs, crc_table
), domain AS (
  SELECT n_rows, a, CAST(ceil(n_rows / a) AS BIGINT) AS b
  FROM (SELECT n_rows, CAST(ceil(sqrt(n_rows)) AS BIGINT) AS a FROM (SELECT count(*) AS n_rows FROM documents))
), rounds AS (
  SELECT list((i * 1103515245 + 12345) % 2147483647 ORDER BY i) AS keys FROM range(6) t(i)
), walk AS (
  SELECT doc_id, row_number // b AS l, row_number % b AS r, 0 AS i
  FROM docs, domain
  UNION ALL
  SELECT doc_id,
         CASE WHEN i % 2 = 0 THEN (l + ((r + keys[i % 6 + 1]) % 2147483647) * ((r + keys[i % 6 + 1]) % 2147483647) % 2147483647 * 1588635695 % 2147483629) % a ELSE l END,
         CASE WHEN i % 2 = 1 THEN (r + ((l + keys[i % 6 + 1]) % 2147483647) * ((l + keys[i % 6 + 1]) % 2147483647) % 2147483647 * 1588635695 % 2147483629) % b ELSE r END,
         i % 6 + 1
  FROM walk, domain, rounds WHERE i < 6 OR l * b + r >= n_rows
), places AS (
  SELECT doc_id, l * b + r AS place FROM walk, domain WHERE i = 6 AND l * b + r < n_rows
)
SELECT doc_id, n + 16 AS size, crc AS text_crc32, 'rows' AS law, (place % 40)::INTEGER AS shard, place // 40 AS slot,
       NULL::INTEGER AS grown_shard
FROM sums JOIN places USING (doc_id)
""",
}
