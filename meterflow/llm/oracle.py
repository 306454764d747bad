"""SQL of those corpus queries that SQL can express, by brute force over whole tables."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS size FROM s),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
pairs AS (
  SELECT l.doc_id AS a, r.doc_id AS b, COUNT(*) AS c
  FROM e l JOIN e r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.size + nb.size - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT doc_id, CAST(size AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

SUFFIX_DEDUP = """
WITH d AS (
  SELECT doc_id, encode(COALESCE(text, '')) AS t, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
p AS (
  SELECT doc_id, unnest(list_transform(range(1, n - 198),
    lambda i: {'i': i, 'k': md5(t[i:i + 199])})) AS s FROM d WHERE n >= 200),
m AS (SELECT doc_id, s.i AS i, s.k AS k FROM p),
twice AS (SELECT k FROM m GROUP BY k HAVING COUNT(*) > 1),
r AS (
  SELECT doc_id, i, i - LAG(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) > 200 AS fresh
  FROM m SEMI JOIN twice USING (k)),
g AS (SELECT doc_id, i, SUM(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
runs AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 199 AS b FROM g GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, n + 1, n + 1 FROM d),
kept AS (
  SELECT doc_id, a, LAG(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS start FROM ends),
pieces AS (
  SELECT doc_id, string_agg(hex(CASE WHEN a > start THEN t[start:a - 1] ELSE ''::BLOB END), '' ORDER BY a) AS h
  FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed,
  CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN pieces USING (doc_id)
LEFT JOIN (SELECT doc_id, SUM(b - a + 1) AS gone, COUNT(*) AS spans FROM runs GROUP BY doc_id) USING (doc_id)"""


def crc32(number: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits, bit by bit (-1 stands for a shift)."""
    steps = ("flatten(list_transform(string_split(CAST({} AS VARCHAR), ''), "
             "lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))").format(number)
    return (f"xor(list_reduce(list_concat([4294967295], {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) "
            "WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)")


def framed(value: str) -> str:
    return f"COALESCE(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def climb(name: str, start: str) -> str:
    """All levels of the trees whose leaves ``start`` lists by key ``g`` and place ``i``."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT g, lv + 1, i // 3, (MAX(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY g, lv, i // 3)"""


MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, COALESCE(source, '') AS s, source IS NOT NULL AS named, {leaf("text")} AS leaf,
    CASE WHEN {crc32("doc_id")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other
  FROM documents),
o AS (SELECT *, DENSE_RANK() OVER (ORDER BY named, s) - 1 AS g FROM d),
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM o),
{climb("a", "SELECT g, 0 AS lv, i, COUNT(*) OVER (PARTITION BY g) AS n, leaf AS h FROM l")},
tops AS (SELECT g, h FROM a WHERE n = 1),
{climb("b", "SELECT CAST(0 AS BIGINT) AS g, 0 AS lv, g AS i, COUNT(*) OVER () AS n, h FROM tops")},
sides AS (
  SELECT l.g, l.i, 0 AS part, a.lv, string_agg(a.h, '' ORDER BY a.i) FILTER (a.i < l.i // CAST(POW(3, a.lv) AS BIGINT)) AS x,
    string_agg(a.h, '' ORDER BY a.i) FILTER (a.i > l.i // CAST(POW(3, a.lv) AS BIGINT)) AS y
  FROM l JOIN a ON a.g = l.g AND a.n > 1 AND a.i // 3 = l.i // CAST(POW(3, a.lv + 1) AS BIGINT)
  GROUP BY l.g, l.i, a.lv
  UNION ALL
  SELECT l.g, l.i, 1, b.lv, string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < l.g // CAST(POW(3, b.lv) AS BIGINT)),
    string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > l.g // CAST(POW(3, b.lv) AS BIGINT))
  FROM l JOIN b ON b.n > 1 AND b.i // 3 = l.g // CAST(POW(3, b.lv + 1) AS BIGINT)
  GROUP BY l.g, l.i, b.lv),
p AS (
  SELECT g, i, sha256(string_agg(COALESCE(x, '') || COALESCE(y, ''), '' ORDER BY part, lv)) AS proof,
    list(COALESCE(x, '') || '|' || COALESCE(y, '') ORDER BY part, lv) AS path
  FROM sides GROUP BY g, i),
f AS (
  SELECT doc_id, leaf, tops.h AS subroot, (SELECT h FROM b WHERE n = 1) AS root, COALESCE(proof, sha256('')) AS proof_sha256,
    list_reduce(list_concat([other], COALESCE(path, [])),
      lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM l JOIN tops USING (g) LEFT JOIN p USING (g, i))
SELECT *, folded_root = root AS verified FROM f"""

CONVERSATION_TRIE = f"""
WITH h AS (SELECT conv_id, {crc32("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
t AS (
  SELECT conv_id, h, COALESCE(role, '') AS r, COALESCE(text, '') AS x,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations JOIN h USING (conv_id)),
parts AS (
  SELECT h.conv_id, 0 AS part, pos, r, x FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.pos <= h.h
  UNION ALL SELECT conv_id, 1, pos, r, x FROM t WHERE pos > h),
v AS (
  SELECT conv_id, x, ROW_NUMBER() OVER w AS depth, COUNT(*) OVER (PARTITION BY conv_id) AS n,
    sha256(string_agg(octet_length(encode(r)) || ':' || r || octet_length(encode(x)) || ':' || x, '') OVER w) AS k
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
u AS (
  SELECT conv_id, depth, n, k, x FROM v
  UNION ALL SELECT conv_id, 0, COUNT(v.conv_id), '', '' FROM h LEFT JOIN v USING (conv_id) GROUP BY conv_id),
w AS (SELECT *, LAG(k) OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM u),
nodes AS (
  SELECT k, MIN(conv_id) AS conv_id, MIN(depth) AS depth, MIN(p) AS p, COUNT(*) AS n_convs,
    octet_length(encode(MIN(x))) AS size, sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (n = depth), '')) AS ends_sha256
  FROM w GROUP BY k),
kids AS (SELECT p AS k, COUNT(*) AS n_children FROM nodes WHERE p IS NOT NULL GROUP BY p),
own AS (
  SELECT nodes.*, COALESCE(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * size ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids USING (k)),
below AS (
  SELECT u.k, SUM(CAST(n_children = 0 AS BIGINT)) AS n_leaves, SUM(saved) AS saved_tokens
  FROM own JOIN u ON u.conv_id = own.conv_id AND u.depth <= own.depth GROUP BY u.k)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN below USING (k) LEFT JOIN nodes up ON up.k = own.p"""
