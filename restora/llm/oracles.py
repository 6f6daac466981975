"""DuckDB SQL for the corpus queries that SQL can express; it compares everything with everything and is meant for small tables."""

#: Near-duplicate components by counting shared shingles of all pairs.
OP6 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS gs FROM w),
u AS (SELECT doc_id, unnest(gs) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * c >= 80 * (len(sx.gs) + len(sy.gs) - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y)
SELECT doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) ON x = doc_id"""

#: Repeated strings of 200 bytes by counting all of them, as hexadecimal digits.
OP1 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 199)) AS i, h FROM d WHERE len(h) >= 400),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM p),
r AS (SELECT doc_id, i FROM k WHERE m IN (SELECT m FROM k GROUP BY 1 HAVING count(*) > 1)),
f AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM r),
g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS last, list((before, a) ORDER BY a) AS cuts FROM e GROUP BY 1),
kept AS (SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(cuts, lambda c: substr(h, 2 * c[1] + 1, 2 * (c[2] - c[1]))), '') || substr(h, 2 * last + 1) END AS rest FROM d LEFT JOIN t ON t.doc_id = d.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""

#: Spelling variants: the checksum from a table that is made here, and all pairs of words of nearly equal length.  levenshtein() counts bytes, so the 64 letters
#: from U+00C0 stand for the one-byte signs from U+0020.
OP11 = """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab, array_to_string(list_transform(range(192, 256), lambda i: chr(CAST(i AS INTEGER))), '') AS wide, array_to_string(list_transform(range(32, 96), lambda i: chr(CAST(i AS INTEGER))), '') AS narrow),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS h FROM runs GROUP BY 1, 2),
bytes AS (SELECT run, n, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM own),
sums AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS crc FROM bytes, t),
made AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM sums),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS l, translate(word, any_value(wide), any_value(narrow)) AS signs FROM made, t WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM w a JOIN w b ON b.l BETWEEN a.l - 1 AND a.l + 1 AND a.word <> b.word WHERE levenshtein(a.signs, b.signs) = 1),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY 1),
pick AS (SELECT near.word, min(other) AS other FROM near JOIN best ON best.word = near.word AND other_n = most GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN other END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM w LEFT JOIN best ON best.word = w.word LEFT JOIN pick ON pick.word = w.word),
walk AS (SELECT word, coalesce(form, word) AS here FROM f UNION SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, here AS root FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends ON ends.word = f.word"""

#: The largest integer inner products by scoring all pairs.
OP12 = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

#: Hard negatives by scoring all pairs with anchors.
OP13 = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_dot_product(a.c, v.c) AS BIGINT) AS score FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLES = {"op1_repeats": OP1, "op6_minhash": OP6, "op11_spelling": OP11, "op12_topk": OP12, "op13_hard_negatives": OP13}
