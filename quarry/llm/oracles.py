"""DuckDB SQL for the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '{_WORD}') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM t, unnest(range(1, len(w) - 1)) AS u(p)),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN c ON c.doc_id = t.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_symbols * 10000 // greatest(word_chars, 1) AS symbol_rate, greatest(n_dup_lines - 1, 0) * 10000 // greatest(n_lines, 1) AS dup_line_rate,
             n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS mean_length FROM m),
x AS (SELECT lang, source, metric, v FROM (SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'mean_length']) AS metric,
             unnest([symbol_rate, dup_line_rate, repeat_rate, mean_length]) AS v FROM b WHERE NOT base_failed)),
h AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE v - v % (1 << (length(bin(v)) - 6)) END AS bucket, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT 0 AS tier, lang, source, metric, bucket, n FROM h UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM h GROUP BY lang, metric, bucket
      UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM h GROUP BY metric, bucket),
q AS (SELECT tier, lang, source, metric, max(total) AS n, min(bucket) FILTER (cum * 4 >= total) AS q1, min(bucket) FILTER (cum * 4 >= total * 3) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY tier, lang, source, metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY tier, lang, source, metric) AS total FROM s) GROUP BY ALL),
p AS (SELECT o.lang, o.source, o.metric, CASE WHEN o.n >= 200 THEN o.q1 WHEN l.n >= 200 THEN l.q1 ELSE a.q1 END AS q1,
             CASE WHEN o.n >= 200 THEN o.q3 WHEN l.n >= 200 THEN l.q3 ELSE a.q3 END AS q3,
             CASE o.metric WHEN 'symbol_rate' THEN 100 WHEN 'mean_length' THEN 50 WHEN 'dup_line_rate' THEN 500 ELSE 300 END AS slack
      FROM (SELECT * FROM q WHERE tier = 0) o JOIN (SELECT * FROM q WHERE tier = 1) l ON l.metric = o.metric AND l.lang IS NOT DISTINCT FROM o.lang JOIN (SELECT * FROM q WHERE tier = 2) a ON a.metric = o.metric),
f AS (SELECT lang, source, max(q3 + 3 * (q3 - q1 + slack)) FILTER (metric = 'symbol_rate') AS s_hi, max(q3 + 3 * (q3 - q1 + slack)) FILTER (metric = 'dup_line_rate') AS d_hi,
             max(q3 + 3 * (q3 - q1 + slack)) FILTER (metric = 'repeat_rate') AS r_hi, max(q3 + 3 * (q3 - q1 + slack)) FILTER (metric = 'mean_length') AS m_hi,
             max(q1 - 3 * (q3 - q1 + slack)) FILTER (metric = 'mean_length') AS m_lo FROM p GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_rate <= s_hi AND dup_line_rate <= d_hi AND repeat_rate <= r_hi AND mean_length BETWEEN m_lo AND m_hi, true) AS kept
FROM b LEFT JOIN f ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap, (source_size * 3) / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
a AS (SELECT (SELECT level FROM l WHERE level * w <= cap ORDER BY ratio, encode(source) NULLS LAST LIMIT 1) AS lvl),
t AS (SELECT source, source_size, CASE WHEN lvl IS NULL OR lvl * w > cap THEN cap::DOUBLE ELSE lvl * w END AS target FROM l, a),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
j AS (SELECT d.*, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS budget FROM d JOIN k ON k.source IS NOT DISTINCT FROM d.source),
e AS (SELECT source, h, budget, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS cum FROM j GROUP BY source, h, budget),
b AS (SELECT source, arg_min(CASE WHEN 2 * (budget - cum + words) >= words THEN h + 1 ELSE h END, h) AS threshold FROM e WHERE cum > budget GROUP BY source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN whole < 3 AND h < coalesce(threshold, 0) THEN 1 ELSE 0 END) AS taken,
       whole + CASE WHEN whole < 3 AND h < coalesce(threshold, 0) THEN 1 ELSE 0 END AS copies
FROM j LEFT JOIN b ON b.source IS NOT DISTINCT FROM j.source
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 3) - 1], ' ') AS g FROM w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT root, b FROM r JOIN e ON a = node)
SELECT node AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node
"""

OP3 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(p) WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM i), unnest(range(1, len(w) - n + 2)) AS u(p)),
h AS (SELECT doc_id, p, x.n, item_id FROM x JOIN i ON i.n = x.n AND i.g = x.g),
k AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM h), unnest(range(n)) AS u(o) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, i * 5 // 4 + 1, 2))::INTEGER >> (3 - (i * 5 % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""

# Every document is run through every order on its own.
OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
f AS (SELECT part, d.doc_id, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
             coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS E FROM d LEFT JOIN labels ON labels.doc_id = d.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
m AS (SELECT part, good, toxic, CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END
             || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END AS fails, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT part, filter_order, step, filter_order[step] AS x, filter_order[:step - 1] AS before, fails, good, toxic, n,
             list_min(list_transform(string_split(fails, ''), lambda c: strpos(filter_order, c))) AS falls FROM m, o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, x, sum(n) FILTER (fails = '' OR falls > step) AS kept, sum(n) FILTER (fails <> '' AND falls = step) AS removed,
             sum(n) FILTER (fails <> '' AND falls < step AND contains(fails, x)) AS redundant, sum(n) FILTER (fails = x) AS unique_fails,
             sum(n) FILTER (fails <> '' AND falls = step AND good) AS good_lost, sum(n) FILTER (fails <> '' AND falls = step AND toxic) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley FROM r
"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW} AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w)::HUGEINT AS p FROM x WINDOW w AS (PARTITION BY lang, source)),
y AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w)::HUGEINT AS q FROM y WINDOW w AS (PARTITION BY lang)),
a AS (SELECT g.lang, g.source, h.source AS item, coalesce(sum((p.p - r.p) * (p.p - r.p) // (p.p + r.p)), 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
      LEFT JOIN p ON p.lang = g.lang AND p.source = g.source LEFT JOIN p r ON r.lang = h.lang AND r.source = h.source AND r.term = p.term GROUP BY ALL),
b AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM a UNION ALL SELECT lang, source, 'term', item, value FROM b)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM u
QUALIFY part = 'pair' OR rank <= 10
"""

#: By query.
SQL = {"op1_quality_rules": OP1, "op2_ngram_jaccard_join": OP2, "op3_decontamination": OP3, "op7_mixing": OP7, "op10_warc": OP10, "op11_filter_audit": OP11, "op12_source_divergence": OP12}
