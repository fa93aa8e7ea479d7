"""DuckDB SQL for the rows of queries whose contract SQL can express; it shares nothing with the operators' ways.

Documents are told apart by a number of their own (r), so repeated ids do not matter. Windows are compared as whole strings. Operators 2, 7, 8 and 9 have
no SQL: seeded keys, trained weights and the positional index are not the contract's, and tests compare those with plain versions.
"""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, text: str, pattern: str, key: str) -> str:
    return f"SELECT row_number() OVER () AS r, {key}, coalesce(regexp_extract_all({text}, '{pattern}'), []) AS w FROM {table}"


#: The CRC of a text's bytes, bit by bit; the checksum's polynomial, reflected, is 0xEDB88320.
SHARDS = """
WITH RECURSIVE lut AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM lut WHERE k < 8
), crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS v FROM lut WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM d),
s AS MATERIALIZED (SELECT r, xor(list_reduce(bytes, lambda a, y: xor(a >> 8, v[(xor(a, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS c FROM b, crc),
o AS (SELECT doc_id, size, c, 2 * (sum(size) OVER (ORDER BY c, x, doc_id ROWS UNBOUNDED PRECEDING)) - size AS middle, 2 * (sum(size) OVER ()) AS twice FROM d JOIN s USING (r)),
p AS (SELECT doc_id, size, c, middle, least(middle * 40 // twice, 39) AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, c::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY middle) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM p
"""

#: Links between the different sets only; a component's smallest class is found by widening from every class.
NEAR = f"""
WITH RECURSIVE d AS MATERIALIZED ({_words("documents", LOWER, SPACED, "doc_id")}),
s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS own
  FROM d
), c AS MATERIALIZED (SELECT row_number() OVER () AS c, own, len(own) AS n FROM (SELECT DISTINCT own FROM s WHERE len(own) > 0)),
e AS MATERIALIZED (SELECT c, n, unnest(own) AS g FROM c),
l AS MATERIALIZED (
  SELECT a.c AS x, b.c AS y FROM e a JOIN e b USING (g) WHERE a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (SELECT c AS x, c AS y FROM c UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
low AS (SELECT c.own, m.component_id FROM (SELECT reach.x, min(s.doc_id) AS component_id FROM reach JOIN c ON c.c = reach.y JOIN s ON s.own = c.own GROUP BY reach.x) m JOIN c ON c.c = m.x)
SELECT s.doc_id, len(s.own)::BIGINT AS n_shingles, coalesce(low.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(low.component_id, s.doc_id) AS kept
FROM s LEFT JOIN low ON s.own = low.own
"""

#: A window has ten words, or all of an item that has fewer.
LEAKS = f"""
WITH d AS MATERIALIZED ({_words("documents", LOWER, LETTERED, "doc_id")}),
i AS MATERIALIZED (SELECT *, least(len(w), 10) AS n FROM ({_words("benchmark", LOWER, LETTERED, "item_id")}) WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS g FROM i),
dw AS MATERIALIZED (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k : k + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM i)),
f AS MATERIALIZED (SELECT r, k, n, item_id FROM dw JOIN iw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM f)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

#: Bytes as pairs of hexadecimal digits. Windows are cut out of blocks of 1000 bytes and the 199 that follow, since a place far into a long string takes long to reach.
BYTES = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS MATERIALIZED (SELECT *, len(x) // 2 AS n FROM d),
b AS (SELECT r, n, o, substr(x, 2 * o + 1, 2398) AS y FROM (SELECT *, unnest(range(0, n, 1000)) AS o FROM n)),
w AS MATERIALIZED (SELECT r, o + j AS k, sha256(substr(y, 2 * j + 1, 400)) AS g FROM (SELECT r, n, o, y, unnest(range(0, least(1000, n - o))) AS j FROM b) WHERE o + j + 200 <= n),
t AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
m AS (SELECT r, k, CASE WHEN k <= 200 + lag(k) OVER (PARTITION BY r ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN t USING (g)),
u AS (SELECT r, min(k) AS a, max(k) + 200 AS z FROM (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM m) GROUP BY r, run),
gone AS (SELECT r, sum(z - a) AS removed, count(*) AS spans FROM u GROUP BY r),
cut AS (SELECT r, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS z FROM u UNION ALL SELECT r, coalesce(max(u.z), 0), max(n) FROM n LEFT JOIN u USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS x FROM cut JOIN n USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM n JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

PASSAGES = f"""
WITH d AS MATERIALIZED ({_words("documents", "text", SPACED, "doc_id")}),
w AS MATERIALIZED (SELECT r, unnest(range(1, len(w) - 33)) AS k, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i : i + 34], ' '))) AS g FROM d),
t AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM w SEMI JOIN t USING (g)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS x, count(*) AS n FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

ORACLE_SQL = {
    "op1_prefix_sum_shards": SHARDS,
    "op3_minhash_near_dedup": NEAR,
    "op5_decontamination": LEAKS,
    "op6_suffix_array_dedup": BYTES,
    "op10_substring_dedup": PASSAGES,
}
