"""DuckDB SQL of the queries that SQL expresses whole."""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(column)}, '{pattern}')"


_BENCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words("text", _BENCH)} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, {_words("text", _BENCH)} AS w FROM benchmark),
k AS MATERIALIZED (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
grams AS MATERIALIZED (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, s.k, unnest(range(1, len(w) - s.k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) s)),
hit AS MATERIALIZED (SELECT doc_id, i, grams.k, item_id FROM grams JOIN win USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words("text", _PLAIN)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
near AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x AS node, x AS r FROM near UNION SELECT t.y, reach.r FROM reach JOIN near t ON t.x = reach.node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(r) AS r FROM reach GROUP BY 1) ON node = doc_id
"""


def _crc32(text: str) -> str:
    """The unsigned checksum of a string's UTF-8 bytes, bit by bit."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({code}) // 2 + 1), lambda i: CAST('0x' || substr({code}, 2 * i - 1, 2) AS BIGINT))"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {step}))"


OP12 = f"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
sums AS MATERIALIZED (SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs WHERE length(run) >= 7),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN w v ON v.word = c.rest UNION SELECT v.word, c.word FROM cut c JOIN w v ON v.word = c.rest),
best AS MATERIALIZED (SELECT near.word, count(*) AS n_near, min(struct_pack(less := -w.n, other := other)) AS b FROM near JOIN w ON w.word = other GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * w.n THEN b.other END AS form, CASE WHEN -b.less >= 10 * w.n THEN -b.less END AS form_n FROM w LEFT JOIN best USING (word)),
led AS (SELECT word, word AS root FROM f UNION ALL SELECT led.word, f.form FROM led JOIN f ON f.word = led.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, led.root FROM f JOIN led ON led.word = f.word JOIN f g ON g.word = led.root WHERE g.form IS NULL
"""

OP13 = f"""
WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, own, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY 1)),
p AS MATERIALIZED (SELECT s.*, least(s.h, coalesce(b.own, 0)) AS taken FROM s LEFT JOIN s b ON b.conv_id = s.base),
r AS MATERIALIZED (SELECT p.conv_id, place AS d, role, text FROM p JOIN t ON t.conv_id = base AND place <= taken UNION ALL SELECT p.conv_id, place - h + taken, role, text FROM p JOIN t USING (conv_id) WHERE place > h),
l AS MATERIALIZED (SELECT p.conv_id, list(sha256(sha256(role) || sha256(text)) ORDER BY d) FILTER (d IS NOT NULL) AS seq, list(len(regexp_extract_all(text, '{_PLAIN}')) ORDER BY d) FILTER (d IS NOT NULL) AS words FROM p LEFT JOIN r USING (conv_id) GROUP BY 1),
m AS MATERIALIZED (SELECT conv_id, d, coalesce(len(seq), 0) AS size, coalesce(array_to_string(seq[1 : d], ''), '') AS k, coalesce(words[d], 0) AS words FROM (SELECT *, unnest(range(0, coalesce(len(seq), 0) + 1)) AS d FROM l)),
n AS MATERIALIZED (SELECT d, k, substr(k, 1, greatest(64 * (d - 1), 0)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = size) AS ends FROM m GROUP BY d, k),
c AS MATERIALIZED (SELECT a.d, a.k, a.n_convs, a.words, count(b.k) AS kids FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.up = a.k GROUP BY ALL),
u AS MATERIALIZED (SELECT substr(k, 1, 64 * j) AS k, j AS d, sum((n_convs - 1) * words) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM c) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN x.conv_id END AS parent_conv_id, n.n_convs, c.kids AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN c USING (d, k) JOIN u USING (d, k) LEFT JOIN n x ON x.d = n.d - 1 AND x.k = n.up
"""
