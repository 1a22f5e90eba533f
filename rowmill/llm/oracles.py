"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) r(i)),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], chr(10)) AS k FROM words WHERE i + 12 <= n),
least AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win JOIN least USING (k) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
kept AS (
  SELECT w.doc_id, w.i, w.w[w.i] AS word FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i),
joined AS (SELECT doc_id, count(*) AS m, string_agg(word, ' ' ORDER BY i) AS t FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) AS BIGINT) - coalesce(j.m, 0) AS n_removed,
       sha256(coalesce(j.t, '')) AS kept_sha256
FROM docs d LEFT JOIN joined j USING (doc_id)"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], chr(10))) AS k
  FROM words, range(1, greatest(len(w) - 4, 1) + 1) r(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, root) AS (
  SELECT a, a FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id WHERE r.root < e.b),
component AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id,
       coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN component c ON c.id = d.doc_id"""

CONTAMINATION = r"""
WITH split AS (
  SELECT 0 AS bench, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS MATERIALIZED (
  SELECT bench, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM split),
phrases AS MATERIALIZED (
  SELECT DISTINCT id AS item, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS k
  FROM words, range(1, greatest(len(w) - 12, 1) + 1) r(i) WHERE bench = 1 AND len(w) > 0),
lengths AS (SELECT DISTINCT m FROM phrases),
found AS MATERIALIZED (
  SELECT id, i, g.m, p.item
  FROM (SELECT id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
        FROM words, lengths, range(1, greatest(len(w) - m + 1, 0) + 1) r(i) WHERE bench = 0) g
  JOIN phrases p ON p.k = g.k AND p.m = g.m),
hit AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS j FROM found) GROUP BY id),
item AS (
  SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS s FROM found) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit h USING (id) LEFT JOIN item t USING (id) WHERE w.bench = 0"""

QUOTES = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, i, string_split(text, chr(10))[i] AS line
  FROM conversations, range(1, len(string_split(text, chr(10))) + 1) r(i)),
marked AS (
  SELECT conv_id, turn, i, line, regexp_extract(line, '^\s*((?:>\s?)+)', 0) AS mark FROM lines),
parts AS (
  SELECT conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS level,
         substr(line, length(mark) + 1) AS rest FROM marked),
norm AS MATERIALIZED (
  SELECT *, lower(trim(regexp_replace(rest, '\s+', ' ', 'g'))) AS k FROM parts),
votes AS (
  SELECT q.conv_id, q.turn, q.level, o.turn AS origin, count(DISTINCT q.k) AS n
  FROM norm q JOIN norm o ON o.conv_id = q.conv_id AND o.k = q.k AND o.level = 0 AND o.turn < q.turn
  WHERE q.level > 0 AND q.k <> '' GROUP BY ALL),
parents AS MATERIALIZED (
  SELECT conv_id, turn, origin AS parent_turn FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
paths AS (
  SELECT c.conv_id, c.turn, [c.turn] AS path FROM (SELECT DISTINCT conv_id, turn FROM conversations) c
  ANTI JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.turn
  UNION ALL
  SELECT p.conv_id, p.turn, list_append(a.path, p.turn) FROM paths a
  JOIN parents p ON p.conv_id = a.conv_id AND p.parent_turn = a.turn),
own AS (
  SELECT conv_id, turn, coalesce(max(level) FILTER (k <> ''), 0) AS quote_depth,
         coalesce(trim(string_agg(rest, chr(10) ORDER BY i) FILTER (level = 0), chr(10)), '') AS own_text
  FROM norm GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, CAST(coalesce(o.quote_depth, 0) AS BIGINT) AS quote_depth, p.parent_turn,
       h.path[1] AS thread_turn, CAST(len(h.path) AS BIGINT) AS reply_level,
       array_to_string(h.path, '/') AS reply_path, sha256(coalesce(o.own_text, '')) AS own_sha256
FROM conversations c LEFT JOIN own o USING (conv_id, turn) LEFT JOIN parents p USING (conv_id, turn)
LEFT JOIN paths h ON h.conv_id = c.conv_id AND h.turn = c.turn"""


NEIGHBOURS = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INT) AS rank
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 20 = 0)
WHERE rank <= 20"""


DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS size FROM kept GROUP BY lang),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(n.size, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, count(*) AS size FROM words JOIN kept USING (lang, term) GROUP BY ALL) n
  USING (lang, source)),
cells AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
share AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (g.size + 2 * g.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.total + 2) // (l.size + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM share WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10"""


SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM counted),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, CAST(i AS INT), 2) AS BIGINT))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM bytes, crc_table),
slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS MATERIALIZED (
  SELECT word, n, length(word) AS m, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, range(1, length(word) + 1) r(i)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.m = b.m AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS most FROM near GROUP BY word),
found AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
follow AS (
  SELECT word, coalesce(form, word) AS root FROM found
  UNION SELECT f.word, g.form FROM follow f JOIN found g ON g.word = f.root WHERE g.form IS NOT NULL),
roots AS (SELECT f.word, f.root FROM follow f JOIN found g ON g.word = f.root WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)"""
