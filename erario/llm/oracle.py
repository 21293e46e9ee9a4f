"""DuckDB SQL of the operators whose whole result SQL can say, by plain definitions instead of the methods."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM doc
), run AS (
    SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o || ' ' || lead(x, 6) OVER o || ' ' || lead(x, 7) OVER o AS g
    FROM word WINDOW o AS (PARTITION BY r ORDER BY i)
), win AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM run WHERE g IS NOT NULL
), twice AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win WHERE n > 1) GROUP BY r
), base AS (
    SELECT doc_id, t, w, lines, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM doc LEFT JOIN twice USING (r)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        n_symbols * 4 > n_words OR word_chars > 15 * n_words OR word_chars * 2 < 3 * n_words
        OR (n_dup_lines >= 3 AND n_dup_lines * 2 > len(lines))
        OR (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) * 2 > word_chars
        OR len(list_filter(list_zip(w[2:], w), lambda x: x[1] = x[2])) * 5 > n_words
        OR (n_words >= 60 AND len(list_distinct(w)) * 20 < least(n_words, 2000))
        OR (n_words >= 200 AND len(regexp_extract_all(t, '[.!?]([ \t\n\x0B\f\r]|\z)')) * 500 < n_words) AS rejected
    FROM base
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged
"""

OP2 = rf"""
WITH RECURSIVE doc AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w
    FROM documents
), held AS (
    SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [w[i : i + 4] FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM doc
), shingles AS (SELECT r, len(s) AS n, unnest(s) AS g FROM held
), shared AS (
    SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.r < b.r
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM shared UNION ALL SELECT b, a FROM shared
), reach AS (SELECT r, r AS o FROM held UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o
), least AS (SELECT reach.r, min(held.doc_id) AS c FROM reach JOIN held ON held.r = reach.o GROUP BY reach.r)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, coalesce(doc_id = c, FALSE) AS kept FROM held JOIN least USING (r)
"""

OP3 = rf"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item, size, w[i : i + size - 1] AS g
    FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), grams AS (
    SELECT r, s.size, i, w[i : i + s.size - 1] AS g
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size) AS s
), found AS (
    SELECT r, item, grams.size, i FROM grams JOIN win ON grams.g = win.g
), covered AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r
), named AS (
    SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
    sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)
"""

OP10 = r"""
WITH doc AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), grams AS (
    SELECT r, i, md5_number(substr(h, 2 * i + 1, 200)) AS g
    FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM doc WHERE len(h) >= 200)
), later AS (
    SELECT r, i FROM grams QUALIFY row_number() OVER (PARTITION BY g ORDER BY r, i) > 1
), opened AS (
    SELECT r, i, i + 100 AS e, sum(CAST(i > before AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 100, -1) AS before FROM later)
), runs AS (SELECT r, run, min(i) AS i, max(e) AS e FROM opened GROUP BY r, run
), gaps AS (
    SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY i), 0) AS f, i AS t FROM runs
    UNION ALL SELECT r, max(e), NULL FROM runs GROUP BY r
), left_over AS (
    SELECT r, string_agg(CASE WHEN t IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY f) AS kept
    FROM gaps JOIN doc USING (r) GROUP BY r
), spans AS (SELECT r, sum(e - i) AS removed, count(*) AS n FROM runs GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
    sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM doc LEFT JOIN left_over USING (r) LEFT JOIN spans USING (r)
"""

OP11 = r"""
WITH RECURSIVE vec AS (
    SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v,
        embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
    FROM embeddings
), unit AS (SELECT r, v, sqrt(list_dot_product(v, v)) AS n FROM vec WHERE good
), pairs AS (SELECT a.r AS a, b.r AS b FROM unit a JOIN unit b ON a.r < b.r AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (SELECT r, r AS o FROM vec UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.o
), least AS (SELECT reach.r, min(vec.vec_id) AS c FROM reach JOIN vec ON vec.r = reach.o GROUP BY reach.r
), linked AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, coalesce(vec_id = c, FALSE) AS kept
FROM vec JOIN least USING (r) LEFT JOIN linked USING (r)
"""

ORACLE = {
    "op1_quality_rules": OP1,
    "op2_near_dedup": OP2,
    "op3_decontamination": OP3,
    "op10_suffix_dedup": OP10,
    "op11_embedding_dedup": OP11,
}
