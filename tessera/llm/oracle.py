"""DuckDB statements of the operators that SQL can express.

They state the contracts plainly (all windows, all pairs of documents with a
shingle in common), not the operators' methods.
"""

W = r"'[^\x20\x09-\x0D]+'"
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _covered(n: int) -> str:
    """Words inside an n-word window that the text has twice or more."""
    return f"""
g{n} AS (SELECT doc_id, i, list_aggregate(ws[i:i + {n - 1}], 'string_agg', chr(1)) AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM d WHERE len(ws) >= {n})),
r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w)) AS chars
        FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM r{n}) JOIN w USING (doc_id, i) GROUP BY doc_id)"""


def repetition(max_share: dict[int, float], max_line_share: float) -> str:
    shares = ", ".join(f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1) AS dup_{n}gram_share" for n in max_share)
    kept = " AND ".join(f"dup_{n}gram_share <= {m!r}" for n, m in max_share.items())
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in max_share)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {W}) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
b AS (SELECT doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(wc.chars, 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
      FROM d LEFT JOIN (SELECT doc_id, sum(length(w)) AS chars FROM w GROUP BY doc_id) wc USING (doc_id)),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS p FROM d),
dl AS (SELECT doc_id, count(*) AS n, sum(length(l)) AS chars FROM (
        SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY p) AS k FROM l WHERE regexp_matches(l, {W})) WHERE k > 1 GROUP BY doc_id),
{",".join(_covered(n) for n in max_share)},
s AS (SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c3.words, 0) AS BIGINT) AS n_repeat_words, coalesce(dl.chars, 0) / greatest(length(t), 1) AS dup_line_share, {shares}
      FROM b LEFT JOIN dl USING (doc_id) {joins}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND dup_line_share <= {max_line_share!r} AND {kept} AS kept FROM f"""


def mixing(seed: int, weights: tuple[int, ...], share: float, most: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {W})), 0) AS BIGINT) AS size,
                  (CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || coalesce(text, '~')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
                  / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, weights))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight, {most} * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER f AS place,
             ((SELECT sum(source_size) FROM s) * {share}::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST)),
e AS (SELECT min_by(level, place) AS final FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(coalesce((SELECT final FROM e) * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM l),
x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, floor(rate) AS certain, rate - floor(rate) AS pi, target - floor(rate) * source_size AS due FROM x),
k AS (SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS k FROM y),
r AS (SELECT *, pi > 0 AND sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k NULLS LAST, doc_id NULLS FIRST, size
                  ROWS UNBOUNDED PRECEDING)::DOUBLE - size / 2.0::DOUBLE <= due AS extra FROM k),
g AS (SELECT *, due - sum(CASE WHEN extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM r),
n AS (SELECT *, NOT extra AND pi > 0 AND size > 0 AND size < 2 * gap AS may FROM g),
b AS (SELECT *, may AND row_number() OVER (PARTITION BY source, may ORDER BY abs(size - gap), k, doc_id NULLS FIRST, size) = 1 AS fill FROM n)
SELECT doc_id, size, source_size, target, CAST(certain AS BIGINT) + extra::BIGINT + fill::BIGINT AS copies,
       (CAST(certain AS BIGINT) + extra::BIGINT + fill::BIGINT) * size AS taken FROM b"""


def components(shingle: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, {W}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + {shingle - 1}], 'string_agg', ' ') AS h
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {shingle - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)"""


def importance(buckets: int, min_words: int, percent: int, seed: int, scale: int) -> str:
    return f"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
                 lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
fd AS (SELECT doc_id, unnest(ws || [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS f FROM d),
fb AS (SELECT unnest(ws || [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS f FROM b),
nd AS (SELECT doc_id, f, count(*) AS n FROM fd GROUP BY ALL),
nb AS (SELECT f, count(*) AS n FROM fb GROUP BY ALL),
hx AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM nd UNION SELECT f FROM nb)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(x, i, 2) AS BIGINT) for i in range(1, len(x), 2)]),
             lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % {buckets} AS bucket FROM hx, tab),
cs AS (SELECT bucket, sum(n)::BIGINT AS s FROM nd JOIN k USING (f) GROUP BY 1),
ct AS (SELECT bucket, sum(n)::BIGINT AS t FROM nb JOIN k USING (f) GROUP BY 1),
g AS (SELECT bucket, floor({scale} * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM cs) + {buckets})::DOUBLE)
             / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM ct) + {buckets})::DOUBLE)))::BIGINT AS gain
      FROM cs LEFT JOIN ct USING (bucket)),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
      FROM nd JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
s AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-{scale} * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s WHERE n_words >= {min_words})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM r) * {percent} // 100 THEN place END AS rank FROM s LEFT JOIN r USING (doc_id)"""


def warc(min_revisit: int) -> str:
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= {min_revisit} GROUP BY 1)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, CAST(1 AS BIGINT) AS n_requests
FROM q LEFT JOIN f USING (payload_digest)"""
