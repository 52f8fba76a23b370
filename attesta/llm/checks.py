"""DuckDB SQL that gives the rows of the operator queries."""

from __future__ import annotations

import string

WORDS = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', "
         f"'{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")

REPLY_TREES = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\#<\n]', '', 'g'))
          + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 4 + 1 + 9 AS n FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

DECONTAMINATE = f"""
WITH item AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS gram
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s
        FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, s, g.n FROM grams g JOIN windows v USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
          FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

SKETCH_JOIN = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}',
         '{string.ascii_lowercase}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 4], ' ')) AS g
          FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM doc WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id
FROM doc d LEFT JOIN sized s USING (doc_id)
"""

URL_TRIE = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT row_number() OVER () AS k, page_id, url FROM pages),
parts AS (
  SELECT k, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM cut),
fits AS (
  SELECT k, first(r_host || r_path ORDER BY length(r_host) DESC, length(r_path) DESC) AS rule,
         first(r_verdict ORDER BY length(r_host) DESC, length(r_path) DESC) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (k)
"""

SPELLING = r"""
WITH RECURSIVE crc_step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, key_bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, c, key, list_transform(regexp_extract_all(hex(encode(key)), '..'), lambda x: ('0x' || x)::BIGINT) AS key_bytes
        FROM (SELECT run, c, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM counted)), crc_table),
spoilt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
holes AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS rest, i
          FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN holes b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN holes b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
         CASE WHEN near_n >= 5 * w.n THEN near_n END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)),
walk(word, here, next) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN formed f ON f.word = walk.next WHERE walk.next IS NOT NULL)
SELECT f.word, form, here AS root, n, n_near, form_n FROM formed f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x60\x7B-\x7F]+') AS terms FROM documents),
said AS (SELECT k, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counted USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
overall AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term)
  JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
raised AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
           FROM shares JOIN overall USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM raised)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
WHERE part = 'pair' OR rank <= 10
"""
