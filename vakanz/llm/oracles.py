"""SQL counterparts of the operators, for DuckDB."""

from __future__ import annotations

EXACT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n
  FROM documents),
ranked AS (
  SELECT doc_id, n,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256
FROM ranked
"""

#: Equal runs of six words at a distance q, joined to stretches: the same runs by another way.
RUNS_SQL = r"""
WITH hashed AS (
  SELECT doc_id, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [-2 - ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x < -1 THEN xor(c, (-2 - x)::BIGINT)
                     ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) AS h
  FROM documents),
split AS (
  SELECT doc_id, h, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS raw
  FROM hashed),
sized AS (
  SELECT *, len(raw) AS n, CASE WHEN len(raw) > 0 THEN (h // 10) % len(raw) END AS a FROM split),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: raw[1 + CASE WHEN i < a THEN i
           ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END])
    ELSE raw END AS words
  FROM sized),
words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM texts),
grams AS (
  SELECT doc_id, i, hash(word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w,
                         lead(word, 4) OVER w, lead(word, 5) OVER w) AS gram,
         lead(i, 5) OVER w AS last
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
  WHERE x.last IS NOT NULL AND y.last IS NOT NULL),
islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (
  SELECT doc_id, q, min(i) AS start, max(i) + 6 + q - min(i) AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches
  WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i)
  GROUP BY words.doc_id),
summed AS (
  SELECT doc_id, count(*) AS n_runs,
         first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
       1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN summed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def clusters_sql(clusters: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """Lloyd's rounds written out, every vector against every centroid."""
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})""",
        f"""x AS (SELECT r, unnest(range({dims})) AS d, unnest(v) AS x FROM kept)""",
        f"""chosen AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c FROM kept
  QUALIFY c < {clusters})""",
        "c0 AS (SELECT c, d, x AS y FROM chosen JOIN x USING (r))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM (
    SELECT r, c, sum((x - y) * (x - y))::BIGINT AS s FROM x JOIN c{i} USING (d) GROUP BY r, c) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS (
  SELECT c, d, coalesce(m, y) AS y FROM c{i} LEFT JOIN (
    SELECT c, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM a{i} JOIN x USING (r) GROUP BY c, d) USING (c, d))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(s) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN kept USING (r)
JOIN (SELECT c, sha256(string_agg(y, ',' ORDER BY d)) AS digest FROM c{rounds} GROUP BY c) USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": EXACT_SQL, "op11_periodic_runs": RUNS_SQL, "op12_heap_clusters": clusters_sql()}
