"""SQL of the registered queries that SQL can express."""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size::DOUBLE * 3 AS cap, (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
levels AS (
  SELECT *, (budget - COALESCE(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
level AS (SELECT arg_min(level, cap / weight) AS lv FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, budget, least(cap, COALESCE(lv, 0.0) * weight) AS target FROM levels LEFT JOIN level ON true),
queued AS (
  SELECT z.*, t.source_size, t.target, t.budget, t.target / t.budget AS share,
         sum(z.size) OVER (PARTITION BY z.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS words
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (words + copy * source_size)::DOUBLE / share AS finish
  FROM queued, (VALUES (0), (1), (2)) v(copy)
  WHERE size > 0 AND share > 0 AND copy < least(3, ceil(target / source_size))),
placed AS (
  SELECT doc_id, h, source, size, sum(size) OVER (ORDER BY finish, source IS NULL, source, h, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS upto, budget
  FROM copies),
took AS (SELECT doc_id, sum(size)::BIGINT AS n FROM placed WHERE upto <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, COALESCE(t.n, 0)::BIGINT AS taken FROM queued q LEFT JOIN took t USING (doc_id)
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position,
         COALESCE(floor(turn / 256.0), -1)::BIGINT AS part
  FROM t),
c AS (SELECT conv_id, list(md5(role || chr(0) || text) ORDER BY position) AS said FROM o GROUP BY conv_id),
p AS (SELECT md5(array_to_string(list_slice(said, 1, n), ',')) AS prefix FROM (SELECT said, unnest(range(1, len(said))) AS n FROM c)),
w AS (SELECT md5(array_to_string(said, ',')) AS whole, min(conv_id) AS conv_id FROM c GROUP BY 1),
kept AS (SELECT conv_id FROM w WHERE whole NOT IN (SELECT prefix FROM p))
SELECT conv_id, part, min(position) AS first_position, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY position) AS rendered
FROM o JOIN kept USING (conv_id) GROUP BY conv_id, part
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT s.doc_id, s.shingle, n.n FROM s JOIN n USING (doc_id)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, COALESCE(l.component_id, d.doc_id) AS component_id, COALESCE(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, encode(COALESCE(text, '')) AS data FROM documents),
z AS (SELECT doc_id, octet_length(data)::BIGINT AS n, hex(data) AS x FROM d),
y AS (SELECT doc_id, k, substr(x, 2000 * k + 1, 2098) AS y FROM (SELECT doc_id, x, unnest(range(0, (n - 50) // 1000 + 1)) AS k FROM z WHERE n >= 50)),
w AS (SELECT doc_id, 1000 * k + p AS p, substr(y, 2 * p + 1, 100) AS s FROM (SELECT doc_id, k, y, unnest(range(0, len(y) // 2 - 49)) AS p FROM y)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
run AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
gone AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, run),
part AS (SELECT doc_id, a, b, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM gone),
cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM part JOIN z USING (doc_id) GROUP BY doc_id)
SELECT z.doc_id, z.n AS n_bytes, COALESCE(c.n_removed, 0) AS n_removed, COALESCE(c.n_spans, 0) AS n_spans, sha256(unhex(COALESCE(c.kept, z.x))) AS kept_sha256
FROM z LEFT JOIN cut c USING (doc_id)
"""

LINE_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       COALESCE(dup.n, 0) AS n_dup_lines, COALESCE(again.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * COALESCE(again.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN dup USING (r) LEFT JOIN again USING (r)
"""

PRIVATE_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
p(k, kind, pattern) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT r, k, kind, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS gaps FROM d, p),
h AS (SELECT r, k, kind, n, hits[n] AS hit, length(gaps[n]) AS gap FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS n FROM m)),
s AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, sum(gap + length(hit)) OVER (PARTITION BY r, k ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM h),
f AS (
  SELECT *, b - length(hit) AS a FROM s
  WHERE CASE k WHEN 0 THEN true
    WHEN 1 THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND COALESCE(TRY_CAST(ltrim(x, '0') AS INT), 0) <= 255))
    WHEN 2 THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT
      ELSE 2 * digits[length(digits) - i]::INT // 10 + 2 * digits[length(digits) - i]::INT % 10 END)) % 10 = 0
    ELSE length(digits) BETWEEN 8 AND 15 END),
o AS (
  SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS spans
  FROM f GROUP BY r)
SELECT doc_id, COALESCE(n_email, 0) AS n_email, COALESCE(n_ip, 0) AS n_ip, COALESCE(n_card, 0) AS n_card, COALESCE(n_phone, 0) AS n_phone, sha256(COALESCE(spans, '')) AS base_sha256
FROM d LEFT JOIN o USING (r)
"""

# CRC-32 with its table made by its rule; ``c`` is a list of bytes.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

SHARDS = rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, COALESCE('=' || doc_id, '') AS key FROM documents),
s AS (
  SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size, {_CRC.format("text")}::BIGINT AS text_crc32,
         list_transform(range(17), lambda i: {{'score': -ln((('0x' || substr(md5('shard:' || i || key), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE), 'shard': i,
                                               'draw': ('0x' || substr(md5('shard:' || i || key), 1, 13))::BIGINT}}) AS drawn
  FROM d, {_CRC_TABLE}),
p AS (SELECT *, list_min(drawn[:16]) AS best, list_min(drawn).shard AS grown FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, best.shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY best.shard ORDER BY best.draw, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INTEGER AS grown_shard
FROM p
"""

TRIE = rf"""
WITH t AS (
  SELECT conv_id, turn, md5(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS m, length(COALESCE(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, m, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS p FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), {_CRC_TABLE}),
r AS (
  SELECT c.conv_id, 0 AS own, o.p, m, chars FROM c JOIN o ON o.conv_id = c.base AND o.p <= c.h
  UNION ALL SELECT c.conv_id, 1, o.p, m, chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h),
l AS (SELECT conv_id, list(m ORDER BY own, p) AS ms, list(chars ORDER BY own, p) AS cs FROM r GROUP BY conv_id),
b AS (SELECT conv_id, COALESCE(ms, []) AS ms, COALESCE(cs, []) AS cs FROM c LEFT JOIN l USING (conv_id)),
n AS (SELECT conv_id, d AS depth, md5(array_to_string(ms[:d], ',')) AS node, md5(array_to_string(ms[:d - 1], ',')) AS parent, COALESCE(cs[d], 0) AS chars, d = len(ms) AS ends
      FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM b)),
g AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(chars) AS chars, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ended
      FROM n GROUP BY node, depth),
k AS (SELECT parent, count(*) AS n FROM g WHERE depth > 0 GROUP BY parent),
v AS (SELECT g.node, g.depth, g.conv_id, (COALESCE(k.n, 0) = 0)::INT AS leaf, (g.n_convs - 1) * chars AS saved FROM g LEFT JOIN k ON k.parent = g.node),
u AS (SELECT a.node, a.depth, sum(v.leaf)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens FROM v JOIN n a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.node, a.depth)
SELECT g.conv_id, g.depth, up.conv_id AS parent_conv_id, g.n_convs, COALESCE(k.n, 0) AS n_children, u.n_leaves, u.saved_tokens, sha256(COALESCE(g.ended, '')) AS ends_sha256
FROM g JOIN u USING (node, depth) LEFT JOIN k ON k.parent = g.node LEFT JOIN g up ON g.depth > 0 AND up.node = g.parent AND up.depth = g.depth - 1
"""


def _codes(rounds: int = 2) -> str:
    near = "(SELECT vec_id, p.part, arg_min(entry, far * 64 + entry) AS entry, min(far) AS far FROM (SELECT p.vec_id, p.part, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN c{k} c ON c.part = p.part) p GROUP BY vec_id, part)"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS {near.format(k=k)}")
        steps.append(f"m{k} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS x FROM (SELECT part, entry, i, sum(p.x[i])::DOUBLE AS s, count(*) AS n FROM p JOIN a{k} USING (vec_id, part), range(1, 5) r(i) GROUP BY part, entry, i) GROUP BY part, entry)")
        steps.append(f"c{k + 1} AS (SELECT part, entry, COALESCE(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (part, entry))")
    made = ",\n".join(steps)
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (SELECT vec_id, part, q[part * 4 + 1:part * 4 + 4] AS x FROM v, range(16) r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{made},
f AS {near.format(k=rounds)},
g AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN g USING (vec_id), h
"""


#: Of 64 dimensions, as the table has them.
CODES = _codes()
