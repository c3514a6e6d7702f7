"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i:least(i + 12, len(w))], ' ') AS win, least(13, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item FROM pos p JOIN win
        ON win.n = p.n AND win.win = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# crc32 of UTF-8 text, byte by byte; the table follows from the polynomial.
_CRC_TABLE = """SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
    ORDER BY i) AS t FROM range(256) r(i)"""


def _crc32(text: str, table: str) -> str:
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(0, len({digits}) // 2), lambda p: CAST('0x' || substr({digits}, 2 * p + 1, 2) AS BIGINT))"
    return (f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), "
            "CAST(4294967295 AS BIGINT)), 4294967295)")


SPELLING = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
hash AS (SELECT run.*, {_crc32("CAST(doc_id AS VARCHAR) || ':' || w", "crc.t")} AS h FROM run, crc WHERE length(w) >= 7),
word AS (SELECT w, CAST(sum(c) AS BIGINT) AS n
         FROM (SELECT c, CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w FROM hash)
         WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2),
cut AS (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS rest FROM (SELECT w, n, unnest(range(length(w))) AS i FROM word)),
near AS (
  SELECT a.w, b.w AS o, b.n AS o_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.w) = length(b.w) AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cut a JOIN word b ON a.rest = b.w
  UNION SELECT b.w, a.w, a.n FROM cut a JOIN word b ON a.rest = b.w),
best AS (SELECT w, count(*) AS n_near, first(o ORDER BY o_n DESC, o) AS o, max(o_n) AS o_n FROM near GROUP BY w),
form AS (SELECT word.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 10 * n THEN o END AS form,
                CASE WHEN o_n >= 10 * n THEN o_n END AS form_n FROM word LEFT JOIN best USING (w)),
step AS (SELECT w, w AS root, 0 AS k FROM form UNION ALL
         SELECT step.w, form.form, k + 1 FROM step JOIN form ON form.w = step.root WHERE form.form IS NOT NULL)
SELECT form.w AS word, form.form, r.root, n, n_near, form_n
FROM form JOIN (SELECT w, last(root ORDER BY k) AS root FROM step GROUP BY w) r USING (w)
"""

RESAMPLE = f"""
WITH crc AS ({_CRC_TABLE}),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
used AS (SELECT unnest(w) AS w, 1 AS s, 0 AS t FROM doc UNION ALL
         SELECT unnest({_WORDS}), 0, 1 FROM benchmark),
word AS (SELECT w, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM used GROUP BY w),
hash AS (SELECT word.*, {_crc32("w", "crc.t")} % 10000 AS b FROM word, crc),
total AS (SELECT sum(s) + 10000 AS s, sum(t) + 10000 AS t FROM word),
gain AS (SELECT b, CAST(floor(1000 * ln((sum(hash.t) + 1) * any_value(total.s) / ((sum(hash.s) + 1) * any_value(total.t)))) AS BIGINT) AS g
         FROM hash, total GROUP BY b),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g
         FROM (SELECT doc_id, unnest(w) AS w FROM doc) JOIN hash USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS n, coalesce(g // s.n - CAST(g % s.n < 0 AS BIGINT), 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM doc d LEFT JOIN sums s USING (doc_id)),
noisy AS (SELECT doc_id, n, weight,
                 weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS k
           FROM noisy WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN r <= k THEN CAST(r AS BIGINT) END AS rank
FROM noisy LEFT JOIN ranked USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": DECONTAMINATE, "op11_spelling": SPELLING, "op12_resample": RESAMPLE}
