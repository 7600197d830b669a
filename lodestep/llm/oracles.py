"""DuckDB SQL for the queries that SQL can express, written apart from their plans."""

AZ = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + AZ + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
iw AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) >= 10 THEN w[i:i + 9] ELSE w END AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM dw, (SELECT DISTINCT len(g) AS n FROM ig) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM dg JOIN ig USING (g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

HOST_RULES = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (
  SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(bad AS INT)) AS DOUBLE) AS k
  FROM (SELECT source, unnest(['short', 'repetitive', 'symbols']) AS rule,
               unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 5 * n_symbols > word_chars]) AS bad
        FROM m WHERE source IS NOT NULL) GROUP BY source, rule),
p AS (SELECT rule, sum(k) / sum(n) AS mean, sum(n) AS total, count(*) AS hosts FROM f GROUP BY rule),
v AS (
  SELECT rule, any_value(mean) AS mean,
         sum(n * (k / n - mean) ** 2) / any_value(total) - any_value(mean * (1 - mean) * hosts / total) AS between_hosts
  FROM f JOIN p USING (rule) GROUP BY rule),
s AS (
  SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e6) ELSE 1e6 END AS strength
  FROM v),
rejected AS (SELECT DISTINCT source FROM f JOIN s USING (rule) WHERE (k + mean * strength) / (n + strength) >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
FROM m
"""

URL_RULES = r"""
WITH r(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
b AS (SELECT page_id, after, regexp_extract(after, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT row_number() OVER () AS k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(after, length(raw) + 1), '^[^?#]*') AS path FROM b),
m AS (
  SELECT k, r.host || r.path AS rule, action,
         row_number() OVER (PARTITION BY k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM c JOIN r ON (c.host = r.host OR suffix(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM c LEFT JOIN (SELECT * FROM m WHERE place = 1) USING (k)
"""

POISSON_MIX = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n, CAST(count(*) AS DOUBLE) ** 0.7 AS w FROM documents GROUP BY source),
r AS (SELECT source, n, w / (SELECT sum(w) FROM c) * (SELECT CAST(sum(n) AS DOUBLE) FROM c) / n AS rate FROM c),
p AS (
  SELECT source, rate, 0 AS j, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL
  SELECT source, rate, j + 1, p * rate / (j + 1), cdf + p * rate / (j + 1) FROM p WHERE j < ceil(rate + 10 * sqrt(rate) + 20)),
d AS (
  SELECT doc_id, text, source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
         CAST(('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
n AS (
  SELECT doc_id, k, any_value(text) AS text, any_value(d.source) AS source, any_value(rate) AS rate, count(*) FILTER (WHERE cdf <= u) AS copies
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source GROUP BY doc_id, k),
e AS (SELECT *, unnest(range(copies)) AS copy FROM n)
SELECT doc_id, text, source, CAST(copies AS INT) AS copies, CAST(copy AS INT) AS copy, round(rate, 6) AS rate,
       md5('20:' || k || ':' || copy) AS order_key
FROM e
"""

TOOL_CALLS = """
WITH t AS (SELECT conv_id, turn, role, text, 'c' || conv_id || '-' AS c FROM conversations),
res AS (SELECT conv_id, turn, c || (turn - 1) AS call_id, text FROM t WHERE role = 'assistant'),
got AS (SELECT call_id, max(text) AS output, count(*) AS n FROM res GROUP BY call_id),
calls AS (
  SELECT t.conv_id, t.turn, t.c || t.turn AS call_id, t.text, b.turn IS NOT NULL AS has, t.c || t.other AS after,
         -- only the third of four exchanges needs a later one, which itself needs an earlier one
         CASE WHEN b.turn > t.turn THEN t.other + 1 / 16777216.0::DOUBLE ELSE t.turn END AS rank
  FROM (SELECT *, turn + [-2, -2, 2, -4][CAST(turn // 2 % 4 AS INT) + 1] AS other FROM t) t
  LEFT JOIN (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'user') b ON b.conv_id = t.conv_id AND b.turn = t.other
  WHERE t.role = 'user'),
lines AS (
  SELECT conv_id, turn AS position, rank, coalesce(n, 0) AS n_results, 'call' AS kind, call_id,
         coalesce(length(text), 0) > 0 AS valid,
         CASE WHEN text IS NULL THEN '$.prompt: missing' WHEN text = '' THEN '$.prompt: too short' END AS problems,
         '{"arguments":{' || CASE WHEN has THEN '"after":"' || after || '"' || CASE WHEN text IS NULL THEN '' ELSE ',' END ELSE '' END
           || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(text) AS VARCHAR) END || '},"id":"' || call_id
           || '","name":"reply","result":' || coalesce(CAST(to_json(output) AS VARCHAR), 'null') || '}' AS line
  FROM calls LEFT JOIN got USING (call_id)
  UNION ALL
  SELECT conv_id, turn, turn, 1, 'orphan', call_id, true, NULL,
         '{"id":"' || call_id || '","result":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}'
  FROM res WHERE call_id NOT IN (SELECT call_id FROM calls)
  UNION ALL
  SELECT conv_id, turn, turn, 0, 'message', NULL, true, NULL,
         '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
  FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT conv_id, position, CAST(rank AS DOUBLE) AS rank, CAST(n_results AS BIGINT) AS n_results, kind, call_id, valid, problems, line FROM lines
"""

# CRC-32 of UTF-8 text: its bytes, each with eight shifts (-1) after it, are folded into the remainder
CRC = """xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || flatten(list_transform(range(CAST(length(hex({0})) / 2 AS BIGINT)),
  lambda i: [('0x' || substr(hex({0}), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""

PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
b AS (SELECT h.conv_id, coalesce(s.own[1:h.h], []) || h.own[h.h + 1:] AS turns FROM h LEFT JOIN t s ON s.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, turns, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth FROM b),
k AS (SELECT conv_id, n, depth, md5(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS node,
             CASE WHEN depth > 0 THEN md5(CAST(to_json(turns[1:depth - 1]) AS VARCHAR)) END AS parent,
             CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM p),
m AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM k GROUP BY depth, node),
c AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
-- each node under every node on its path: pairs of places of one conversation
a AS (SELECT DISTINCT u.node AS above, u.depth AS above_depth, v.node, v.depth FROM k u JOIN k v ON v.conv_id = u.conv_id AND v.depth >= u.depth),
s AS (SELECT above AS node, above_depth AS depth, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
      FROM a JOIN m USING (node, depth) LEFT JOIN c USING (node, depth) GROUP BY ALL)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, m.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (node, depth) LEFT JOIN c USING (node, depth) LEFT JOIN m up ON up.node = m.parent AND up.depth = m.depth - 1
"""

SPELLING = rf"""
WITH RECURSIVE r AS (
  SELECT id, w, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents)
  GROUP BY ALL),
h AS (SELECT w, n, {CRC.format("encode(id || ':' || w)")} AS h FROM r),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
e AS (SELECT w, k, substr(w, 1, k - 1) || substr(w, k + 1) AS cut FROM (SELECT w, unnest(range(1, length(w) + 1)) AS k FROM v)),
one AS (
  SELECT a.w AS x, b.w AS y FROM e a JOIN e b ON a.k = b.k AND a.cut = b.cut AND length(a.w) = length(b.w) AND a.w <> b.w
  UNION SELECT a.w, v.w FROM e a JOIN v ON a.cut = v.w
  UNION SELECT v.w, a.w FROM e a JOIN v ON a.cut = v.w),
f AS (SELECT x, count(*) AS n_near, first(y ORDER BY n DESC, y) AS y, max(n) AS n_y FROM one JOIN v ON v.w = y GROUP BY x),
g AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN n_y >= 2 * n THEN y END AS form, CASE WHEN n_y >= 2 * n THEN n_y END AS form_n FROM v LEFT JOIN f ON x = w),
up AS (SELECT w, w AS root FROM g UNION ALL SELECT up.w, g.form FROM up JOIN g ON g.w = up.root WHERE g.form IS NOT NULL)
SELECT g.w AS word, g.form, up.root, g.n, g.n_near, g.form_n
FROM g JOIN up ON up.w = g.w JOIN g last ON last.w = up.root AND last.form IS NULL
"""

EMBEDDING_COPIES = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id, vec_id AS place FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.place),
c AS (SELECT vec_id, min(place) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


ORACLES = {
    "op5_tool_calls": TOOL_CALLS,
    "op6_poisson_mix": POISSON_MIX,
    "op3_decontamination": DECONTAMINATION,
    "op4_host_rules": HOST_RULES,
    "op10_url_rules": URL_RULES,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_spelling_variants": SPELLING,
    "op13_lattice_hash": EMBEDDING_COPIES,
}
