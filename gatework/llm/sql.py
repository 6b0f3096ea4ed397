"""DuckDB twins of the queries that SQL can express."""

OP4 = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE nth WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 0.5 END::DOUBLE AS w0, CASE nth WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.5 END::DOUBLE AS w1 FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weights
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT room::DOUBLE / weights AS level FROM r WHERE room::DOUBLE / weights * w <= cap ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM f) * w) AS target, w0, w1 FROM r),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.w0, t.w1, round(t.target)::BIGINT AS whole,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, whole - off)) + greatest(0, least(size, whole - source_size - off)) + greatest(0, least(size, whole - 2 * source_size - off)))::BIGINT AS taken,
  CASE WHEN greatest(0, least(size, whole - off)) > 0 THEN
    least(1.0, 2 * (off / target * (w0 + w1) / 2) / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * (off / target * (w0 + w1) / 2), 0.0)))) END::DOUBLE AS first_position
FROM o
"""

OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i + 1:i + 10], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
dw AS (SELECT doc_id, l, i, array_to_string(w[i + 1:i + l], ' ') AS win FROM di),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw USING (l, win)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def lloyd(k: int, rounds: int) -> str:
    """k centroids, as many rounds, in 128-bit integers."""
    parts = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        near = "list_sum(list_transform(list_zip(v.v, p.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{n} AS (SELECT row, vec_id, v.v, c, {near} AS d FROM v, c{n} AS p QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)")
        if n < rounds:
            # // rounds towards zero, so the remainder is made positive first
            mean = "(sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*)"
            parts.append(f"m{n} AS (SELECT c, i, {mean} AS x FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY ALL)")
            parts.append(f"c{n + 1} AS (SELECT p.c, coalesce(first(l.v), first(p.v)) AS v FROM c{n} AS p LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{n} GROUP BY c) AS l USING (c) GROUP BY p.c)")
    last = f"c{rounds}"
    sha = f"(SELECT c, sha256(array_to_string(v, ',')) AS sha FROM {last})"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 "
        f"FROM a{rounds} JOIN {sha} USING (c)"
    )


OP13 = lloyd(16, 3)

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM i GROUP BY ALL HAVING f >= 100),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k AS size, f AS a FROM f WHERE k > 1),
x AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT x.*, l.f AS l, r.f AS r, n.n, (1000 * a * n.n) // (l.f * r.f) AS score FROM x JOIN n USING (lang)
      JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.k], ' ') JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_size AS (SELECT lang, w, size, a, unnest(range(2, size)) AS m FROM c WHERE size > 2),
inner_at AS (SELECT *, unnest(range(1, size - m + 2)) AS i FROM inner_size),
sub AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_at GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
