"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORD = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, i, substr(h, CAST(2 * i + 1 AS INTEGER), 400) AS g FROM (SELECT k, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d) x),
m AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS c FROM w) x WHERE c > 1),
n AS (SELECT k, i, CASE WHEN i > lag(i) OVER (PARTITION BY k ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY k ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM m),
s AS (SELECT k, min(i) AS a, max(i) + 200 AS z FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS span FROM n) x GROUP BY k, span),
e AS (SELECT k, a, lag(z, 1, 0) OVER (PARTITION BY k ORDER BY a) AS before, z, row_number() OVER (PARTITION BY k ORDER BY a DESC) AS last FROM s),
p AS (SELECT e.k, string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) || max(CASE WHEN last = 1 THEN substr(h, CAST(2 * z + 1 AS INTEGER)) ELSE '' END) AS kept, sum(z - a) AS gone, count(*) AS spans FROM e JOIN d ON d.k = e.k GROUP BY e.k)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN p ON p.k = d.k
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) x),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) x WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.p = e.p WHERE gone.p IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) c ON c.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, {WORD}) AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x),
c AS (SELECT doc_id, i, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
    count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY w1, doc_id) AS c1,
    CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY w2, doc_id) END AS c2,
    CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY w3, doc_id) END AS c3 FROM p),
l AS (SELECT *, lag(c1) OVER w AS b1, lag(c2) OVER w AS b2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used,
    CASE WHEN c3 > 0 THEN log10(c3 / b2) WHEN c2 > 0 THEN log10(c2 / b1) + (least(i, 3) - 2) * log10(0.4) WHEN c1 > 0 THEN log10(c1 / n) + (least(i, 3) - 1) * log10(0.4) ELSE least(i, 3) * log10(0.4) - log10(n + 1) END AS score FROM l)
SELECT d.doc_id, len(w) AS n_words, round(m, 4) AS mean_log10, coalesce(n3, 0) AS n_three, coalesce(n2, 0) AS n_two, coalesce(n1, 0) AS n_one, coalesce(n0, 0) AS n_unseen
FROM d LEFT JOIN (SELECT doc_id, avg(score) AS m, count(*) FILTER (used = 3) AS n3, count(*) FILTER (used = 2) AS n2, count(*) FILTER (used = 1) AS n1, count(*) FILTER (used = 0) AS n0 FROM s GROUP BY doc_id) x ON x.doc_id = d.doc_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, {ALNUM}) AS w FROM documents),
t AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOW}, {ALNUM}) AS w FROM benchmark),
win AS (SELECT item, 13 AS size, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - 11)) AS i FROM t) x
  UNION ALL SELECT item, len(w), array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 12),
size AS (SELECT DISTINCT size FROM win),
occ AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, size) x),
hit AS (SELECT DISTINCT occ.doc_id, occ.i, occ.size, win.item FROM occ JOIN win ON occ.size = win.size AND occ.g = win.g),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) x GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) x) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""

OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) x) y
WHERE rank <= 5
"""

# crc32 of a text's UTF-8 bytes, for a row that holds the table t of its 256 steps.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def crc32(text: str) -> str:
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({hexed}), 2), lambda i: CAST('0x' || substr({hexed}, CAST(i AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295)"


OP11 = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
k AS (SELECT own.*, {crc32("id")} % 20 AS k FROM own, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '' END AS q, substr(role, 1, 1) AS q1 FROM damaged),
r AS (SELECT conv_id, turn, role, text, i, q, lag(q1) OVER (PARTITION BY conv_id ORDER BY i) || q1 AS pair, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
f AS (SELECT conv_id, i, role, text, q, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS x FROM r),
n AS (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id),
back AS (SELECT conv_id, n + 1 AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM n
  UNION ALL SELECT conv_id, i, least(c0, 3 + least(c2, 3 + c3)), least(c1, 3 + least(c2, 3 + c3)), least(c2, 3 + c3), least(c3, 3 + c2) FROM (
    SELECT f.conv_id, f.i, least(4 + v0, CASE WHEN gone THEN 999999 ELSE least(3 + x + v2, CASE q WHEN 's' THEN x + v1 WHEN 'u' THEN x + v2 ELSE 999999 END) END) AS c0, least(4 + v1, CASE WHEN gone THEN 999999 ELSE least(3 + x + v2, CASE q WHEN 'u' THEN x + v2 ELSE 999999 END) END) AS c1,
      least(4 + v2, CASE WHEN gone THEN 999999 ELSE least(3 + x + v3, CASE q WHEN 'a' THEN x + v3 ELSE 999999 END) END) AS c2, least(4 + v3, CASE WHEN gone THEN 999999 ELSE least(3 + x + v2, CASE q WHEN 'u' THEN x + v2 ELSE 999999 END) END) AS c3
    FROM back JOIN f ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.i = back.i - 1) s),
b AS (SELECT back.conv_id, back.i, [v0, v1, v2, v3] AS v, role, text, q, gone, x FROM back LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.i = back.i),
two AS (SELECT a.*, z.v AS w FROM b a LEFT JOIN b z ON z.conv_id IS NOT DISTINCT FROM a.conv_id AND z.i = a.i + 1),
walk AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines, CAST(0 AS BIGINT) AS nth FROM n
  UNION ALL SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND q = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || text) END, nth + 1 FROM (
    SELECT t.conv_id, t.i, s, audit, lines, nth, role, text, q, CASE WHEN w IS NOT NULL AND 4 + w[s + 1] = v[s + 1] THEN 'D' WHEN v[s + 1] = 3 + v[CASE WHEN s = 2 THEN 4 ELSE 3 END] THEN 'I' WHEN w IS NULL THEN NULL
      WHEN (q = 's' AND s = 0 AND x + w[2] = v[1]) OR (q = 'u' AND s <> 2 AND x + w[3] = v[s + 1]) OR (q = 'a' AND s = 2 AND x + w[4] = v[3]) THEN 'K' ELSE 'R' END AS e
    FROM walk JOIN two t ON t.conv_id IS NOT DISTINCT FROM walk.conv_id AND t.i = walk.i) s WHERE e IS NOT NULL),
last AS (SELECT conv_id, max_by(audit, nth) AS audit, max_by(lines, nth) AS lines FROM walk GROUP BY conv_id),
seen AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN seen ON seen.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id AND b.i = 1
"""

OP12 = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOW}, '[a-z\x{{00C0}}-\x{{00FF}}]{{6,}}')) AS run FROM documents),
u AS (SELECT id, run, count(*) AS c FROM d GROUP BY id, run), h AS (SELECT run, c, {crc32("id || ':' || run")} AS h FROM u, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), gone AS (SELECT word, n, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS g, substr(word, 1, CAST(i AS INTEGER) - 1) || '*' || substr(word, CAST(i AS INTEGER) + 1) AS s FROM p),
near AS (SELECT a.word, b.word AS near, b.n FROM gone a JOIN gone b ON a.s = b.s AND a.word <> b.word UNION SELECT gone.word, v.word, v.n FROM gone JOIN v ON v.word = g UNION SELECT v.word, gone.word, gone.n FROM gone JOIN v ON v.word = g),
best AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS nth FROM near),
f AS (SELECT v.word, CASE WHEN best.n >= 5 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND nth = 1),
walk AS (SELECT word, word AS here, form AS onward FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.onward)
SELECT f.word, form, here AS root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND walk.onward IS NULL
"""

SQL = {"op1_suffix_dedup": OP1, "op3_substring_dedup": OP3, "op5_backoff_scores": OP5, "op9_decontaminate": OP9, "op10_near_dedup": OP10, "op11_conversation_repair": OP11, "op12_spelling_variants": OP12, "op13_top_k": OP13}
