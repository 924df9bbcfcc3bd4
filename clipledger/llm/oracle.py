"""The same rows as DuckDB SQL, where SQL can express an operator."""

#: Of the hex digits of all documents, those of each 100-byte string; all but the first place of a string are covered.
OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
    SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM again))
  GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_b,
  string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last_b + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs from the shingles themselves, then everything a link reaches.
OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id <= coalesce(low, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ALPHABET32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: SHA-1 in base 32, five bits at a time of the bits of its hex digits.
OP5 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
bits AS (SELECT s, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
  4 * (strpos('0123456789abcdef', substr(s, i, 1)) - 1) + 1, 4)), '') AS t FROM (SELECT DISTINCT s FROM h)),
d AS (SELECT s, array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET32}', 1
  + 16 * CAST(substr(t, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(t, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(t, 5 * i + 3, 1) AS INT)
  + 2 * CAST(substr(t, 5 * i + 4, 1) AS INT) + CAST(substr(t, 5 * i + 5, 1) AS INT), 1)), '') AS digest FROM bits),
f AS (SELECT s, min(page_id) AS low FROM h GROUP BY s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM h JOIN d USING (s) JOIN f USING (s)
"""

#: crc32 by half bytes, with the fixed values of its sixteen-entry table; each digit of the id has the low half first and then 3.
CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) & 15 AS BIGINT), CAST(ascii(x) // 16 AS BIGINT)]))),
  lambda c, b: xor(c // 16, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][CAST(xor(c, b) % 16 + 1 AS INT)])))"""
#: Matches of equal words at each lag; neighbours on a lag make a run, and the smallest period of a stretch counts.
OP13 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32} AS h FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
t AS (SELECT doc_id, CASE WHEN hit THEN list_transform(range(0, n),
  lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS BIGINT)]) ELSE w END AS w FROM g),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM t),
cells AS (SELECT a.doc_id, a.i - b.i AS p, a.i FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i < a.i),
marked AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS run FROM cells),
found AS (SELECT doc_id, min(i) - p AS start, count(*) + p AS length, p AS period FROM marked GROUP BY doc_id, p, run HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT doc_id, start, length, min(period) AS period FROM found GROUP BY ALL),
most AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
  arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS m FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, m.start AS start, m.length AS length, m.period AS period, 1000 * m.length // m.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(s, '')) AS collapsed_sha256
FROM t LEFT JOIN most ON most.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

#: Lines with their keys; all but the smallest document lose a key that two or more hold.
OP12 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM d),
k AS (SELECT doc_id, x, i, translate(trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') AS k FROM e),
shared AS (SELECT k, min(doc_id) AS keeper FROM k WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, x, i, coalesce(doc_id <> keeper, false) AS gone FROM k LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Every document is scored for every item.
OP11 = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, docs),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // total AS m FROM n, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM benchmark WHERE item_id IS NOT NULL),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10
"""

SQL = {"op11_best_position_search": OP11, "op12_cuckoo_line_dedup": OP12, "op5_dictionary_warc": OP5, "op1_suffix_array_dedup": OP1, "op6_bottom_k_near_dedup": OP6, "op13_sparse_diagonal_runs": OP13}
