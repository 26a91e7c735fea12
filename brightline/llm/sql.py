"""SQL of the operators whose results SQL can express, for comparison on tables small enough for all pairs or all windows."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
  g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS gram FROM w, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS t(i) WHERE len(ws) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * s >= 80 * (x.n + y.n - s)),
  edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reached AS (SELECT a AS doc_id, b AS met FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.met),
  least_met AS (SELECT doc_id, min(met) AS met FROM reached GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(met, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_met USING (doc_id)"""

OP3 = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
  bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win FROM b, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS t(i) WHERE len(ws) > 0),
  lengths AS (SELECT DISTINCT m FROM bw),
  dw AS (SELECT doc_id, m, i, array_to_string(ws[i : i + m - 1], ' ') AS win FROM w, lengths, unnest(generate_series(1, len(ws) - m + 1)) AS t(i) WHERE len(ws) >= m),
  hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.win = dw.win),
  cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS h FROM w, unnest(generate_series(1, len(ws) - 19)) AS t(i) WHERE len(ws) >= 20),
  later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later),
  words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP9 = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  win AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS k FROM b, unnest(generate_series(1, n - 199)) AS t(i) WHERE n >= 200),
  again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
  marked AS (SELECT doc_id, i, CASE WHEN i > 200 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM again),
  runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked),
  spans AS (SELECT doc_id, min(i) AS s, max(i) + 199 AS e FROM runs GROUP BY doc_id, run),
  cut AS (SELECT doc_id, s, e FROM spans UNION ALL SELECT doc_id, n + 1, n + 1 FROM b),
  gaps AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM cut),
  kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before - 1)), '' ORDER BY s) AS h FROM gaps g JOIN b ON b.doc_id = g.doc_id GROUP BY g.doc_id),
  sums AS (SELECT doc_id, count(*) AS n_spans, sum(e - s + 1) AS n_removed FROM spans GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN sums ON sums.doc_id = b.doc_id"""


OP7 = r"""WITH labelled AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
  d AS (SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(CASE WHEN quality >= 1 THEN 1.0 WHEN quality <= 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS weight FROM documents d LEFT JOIN labelled USING (doc_id)),
  k AS (SELECT *, -ln((CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE)) / weight AS key FROM d),
  s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM k GROUP BY source),
  w AS (SELECT *, CAST([5, 2, 1][(turn - 1) % 3 + 1] AS DOUBLE) AS share, 2 * source_size AS cap FROM s),
  o AS (SELECT *, row_number() OVER (ORDER BY cap / share, turn) AS place FROM w),
  tried AS (SELECT x.place, ((SELECT 1.5 * sum(source_size) FROM o) - coalesce(sum(y.cap) FILTER (y.place < x.place), 0)) / sum(y.share) FILTER (y.place >= x.place) AS level
    FROM o x CROSS JOIN o y GROUP BY x.place),
  met AS (SELECT min_by(level, place) AS level FROM tried JOIN o USING (place) WHERE cap / share >= level),
  t AS (SELECT source, source_size, least(cap, coalesce(level * share, cap)) AS target FROM o CROSS JOIN met),
  r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN epochs < 2 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

OP11 = rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
  groups AS (SELECT DISTINCT lang, source FROM d),
  w AS (SELECT row, lang, source, unnest(ws) AS term FROM d),
  kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
  own AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  ps AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + 2 * v) AS p FROM own JOIN v USING (lang)),
  whole AS (SELECT lang, term, sum(n) AS n FROM own GROUP BY lang, term),
  qs AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * CAST(n + 2 AS HUGEINT) // (CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) + 2 * v) AS q FROM whole JOIN v USING (lang)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
  pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
  term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM ps JOIN qs USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

OP12 = OP2.replace("ws[i : i + 4]", "ws[i : i + 3]").replace("len(ws) - 4)", "len(ws) - 3)").replace(
    " AS component_id\nFROM", " AS component_id, least(d.doc_id, coalesce(met, d.doc_id)) = d.doc_id AS kept\nFROM"
)

_BIT = "xor(c >> 1, 3988292384 * (c & 1))"
OP13 = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS family FROM t),
  crc AS (SELECT conv_id, family, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, s: list_reduce([xor(a, s), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_BIT})), 4294967295) % 9 AS h FROM c),
  lent AS (SELECT crc.conv_id, place, role, text FROM crc JOIN t ON t.conv_id = family AND place <= h UNION ALL SELECT crc.conv_id, place, role, text FROM crc JOIN t ON t.conv_id = crc.conv_id AND place > h),
  items AS (SELECT conv_id, octet_length(encode(text)) AS bytes, sha256(octet_length(encode(role)) || ':' || role || text) AS item, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS d FROM lent),
  whole AS (SELECT c.conv_id, coalesce(list(item ORDER BY d) FILTER (item IS NOT NULL), []) AS path, coalesce(list(bytes ORDER BY d) FILTER (item IS NOT NULL), []) AS sizes FROM c LEFT JOIN items USING (conv_id) GROUP BY c.conv_id),
  steps AS (SELECT conv_id, d AS depth, array_to_string(path[1 : d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(path[1 : d - 1], ',') END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, d = len(path) AS last
    FROM whole, unnest(generate_series(0, len(path))) AS s(d)),
  nodes AS (SELECT node, depth, min(up) AS up, min(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM steps GROUP BY node, depth),
  kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
  full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (node)),
  above AS (SELECT DISTINCT s.node AS below, u.node AS node FROM steps s JOIN steps u ON u.conv_id = s.conv_id AND u.depth <= s.depth),
  sums AS (SELECT a.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM above a JOIN full_nodes n ON n.node = a.below GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums USING (node) LEFT JOIN nodes p ON p.node = n.up"""
