"""The same results in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

SPACES = r"[\x20\x09-\x0D]+"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

# The schedules of mixing.py for weights 5, 2, 1: linear from 1.5 to 0.5; flat at 1; 0.5 up to time 0.7, then
# rising to 3 (an integral of 0.35 up to the knot and 0.525 after it).
MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS c FROM s),
w AS (SELECT *, [5, 2, 1][c + 1]::BIGINT AS w, 3 * source_size AS lim FROM r),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW o AS (ORDER BY lim / w, source NULLS LAST)),
g AS (SELECT *, lim::HUGEINT * open < rest::HUGEINT * w AS filled FROM f),
t AS (
  SELECT source, c, source_size,
         CASE WHEN filled THEN lim::DOUBLE
              ELSE (w * (sum(source_size) OVER () - coalesce(sum(CASE WHEN filled THEN lim END) OVER (), 0)))::DOUBLE
                   / (sum(CASE WHEN NOT filled THEN w END) OVER ())::DOUBLE END AS target
  FROM g),
p AS (
  SELECT d.*, t.c, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, CASE WHEN size > 0 THEN (2 * before + size <= 2 * target)::INT + (2 * (source_size + before) + size <= 2 * target)::INT
                                    + (2 * (2 * source_size + before) + size <= 2 * target)::INT ELSE 0 END AS passes,
         CASE WHEN target > 0 THEN (2 * before + size)::DOUBLE / (2.0 * target) END AS u
  FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size)::BIGINT AS taken,
       CASE WHEN passes > 0 THEN round(CASE c
         WHEN 0 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u))
         WHEN 1 THEN u
         ELSE CASE WHEN u * 0.875 <= 0.35 THEN u * 0.875 / 0.5
                   ELSE 0.7 + 2 * (u * 0.875 - 0.35) / (0.5 + sqrt(0.25 + 5 / 0.3 * (u * 0.875 - 0.35))) END END, 9) END AS position
FROM n
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT row, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT row, k.doc_id, pos, line, o.key IS NOT NULL AND k.doc_id <> owner AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row
"""

COLLOCATIONS = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS o FROM p),
g AS (SELECT lang, k, array_to_string(w[o:o + k - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4)) AS s(k) WHERE o + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
h AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT h.lang, h.k, h.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM h JOIN f x ON x.lang = h.lang AND x.phrase = array_to_string(h.w[1:cut], ' ')
  JOIN f y ON y.lang = h.lang AND y.phrase = array_to_string(h.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (SELECT *, unnest(range(2, k)) AS size FROM c),
q AS (SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS o FROM m),
z AS (SELECT lang, array_to_string(w[o:o + size - 1], ' ') AS phrase, max(a) AS most FROM q GROUP BY ALL),
e AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT e.lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM e JOIN n ON n.lang = e.lang WHERE rank <= 2000
"""


def _centroids(rounds: int = 10) -> str:
    """Assignment and mean, written out for each round."""
    assigned = """a{i} AS MATERIALIZED (
  SELECT row, vec_id, cluster, distance FROM (
    SELECT v.row, v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance
    FROM v JOIN c{i} c ON v.j = c.j GROUP BY v.row, v.vec_id, c.cluster)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)"""
    moved = """c{k} AS MATERIALIZED (
  SELECT c.cluster, c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
      SELECT a.cluster, v.j, sum(v.x) AS s, count(*) AS n FROM a{i} a JOIN v ON v.row = a.row GROUP BY a.cluster, v.j)) m
  ON m.cluster = c.cluster AND m.j = c.j)"""
    steps = [t.format(i=i, k=i + 1) for i in range(rounds) for t in (assigned, moved)] + [assigned.format(i=rounds)]
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT row, vec_id, unnest(range(64)) AS j, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x FROM e),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS cluster FROM e),
c0 AS MATERIALIZED (SELECT s.cluster, v.j, v.x FROM s JOIN v ON v.row = s.row WHERE s.cluster < 8),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, a.cluster::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} a JOIN h ON h.cluster = a.cluster
"""


ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP, "op2_mixing": MIXING, "op11_line_dedup": LINE_DEDUP, "op12_collocations": COLLOCATIONS,
    "op13_centroids": _centroids(),
}
