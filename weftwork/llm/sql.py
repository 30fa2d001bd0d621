"""DuckDB SQL with the same results as the queries of this package, where SQL can say it."""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.r, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN d USING (r)
"""

_MEASURED = f"""
d AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM {{docs}}),
w AS (SELECT r, {_WORDS.format('t')} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS three FROM g),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM h),
p AS (SELECT DISTINCT r, i + j AS at FROM c, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1),
q AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
m AS (SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, len(ls) AS lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS f1, sum((n_symbols > n_words)::INT) AS f2, sum((2 * n_dup_lines > lines)::INT) AS f3 FROM b GROUP BY source),
long AS (SELECT host, n, 1 AS rule, f1 AS k FROM hosts UNION ALL SELECT host, n, 2, f2 FROM hosts UNION ALL SELECT host, n, 3, f3 FROM hosts),
prior AS (SELECT rule, sum(k) * 1.0 / sum(n) AS pooled, coalesce(avg(CASE WHEN n > 1 THEN k * 1.0 / n END), sum(k) * 1.0 / sum(n)) AS m,
                 coalesce(var_samp(CASE WHEN n > 1 THEN k * 1.0 / n END), 0) AS v, coalesce(avg(CASE WHEN n > 1 THEN 1.0 / n END), 0) AS u FROM long GROUP BY rule),
weight AS (SELECT rule, pooled, least(greatest(CASE WHEN v - m * (1 - m) * u > 1e-9 THEN m * (1 - m) / (v - m * (1 - m) * u) - 1 ELSE 10 END, 1), 1000) AS wt FROM prior),
verdict AS (SELECT host, bool_or((k + wt * pooled) / (n + wt) > 0.5) AS bad FROM long JOIN weight USING (rule) GROUP BY host),
judged AS (SELECT b.*, NOT base_failed AND NOT bad AS kept FROM b JOIN verdict ON b.source IS NOT DISTINCT FROM host)
"""

OP3 = f"""
WITH {_MEASURED.format(docs='documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(coalesce(text, ''), " + _LOWER + ")")} AS ws FROM documents),
g AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, list_slice(ws, i, i + 3) AS four FROM g),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.four = b.four AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(r, z) AS (SELECT r, r FROM d UNION SELECT c.r, e.y FROM c JOIN e ON c.z = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT c.r, min(o.doc_id) AS component_id FROM c JOIN d o ON o.r = c.z GROUP BY c.r) m USING (r)
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(coalesce(text, ''), " + _LOWER + ")")} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS.format("translate(coalesce(text, ''), " + _LOWER + ")")} AS ws FROM benchmark),
x AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, list_slice(ws, i, i + 4) AS five FROM x),
y AS (SELECT q, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM b WHERE len(ws) > 0),
t AS (SELECT DISTINCT q, list_slice(ws, i, i + 4) AS five FROM y),
n AS (SELECT q, count(*) AS n FROM t GROUP BY q),
p AS (SELECT r, q, count(*) AS common FROM s JOIN t USING (five) GROUP BY r, q)
SELECT doc_id, item_id, common AS n_shared, n AS n_item FROM p JOIN n USING (q) JOIN d USING (r) JOIN b USING (q) WHERE 100 * common >= 80 * n
"""

OP11 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(coalesce(text, ''), " + _LOWER + ")")} AS ws FROM documents),
g AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, list_slice(ws, i, i + 4) AS five FROM g),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.five = b.five AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * common >= 85 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(r, z) AS (SELECT r, r FROM d UNION SELECT c.r, e.y FROM c JOIN e ON c.z = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id IS NOT DISTINCT FROM m.component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN (SELECT c.r, min(o.doc_id) AS component_id FROM c JOIN d o ON o.r = c.z GROUP BY c.r) m USING (r)
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
o AS (SELECT r, unnest(ts) AS t FROM d),
f AS (SELECT r, t, count(*) AS tf FROM o GROUP BY r, t),
l AS (SELECT r, count(*) AS n FROM o GROUP BY r),
a AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM l),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, a GROUP BY t, all_docs),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
i AS (SELECT DISTINCT q, t FROM (SELECT q, unnest(ts) AS t FROM b)),
s AS (SELECT q, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms)))) AS BIGINT) AS score
      FROM i JOIN w USING (t) JOIN f USING (t) JOIN l USING (r), a GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 10
"""

OP13 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS o(m)),
f AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, list_slice(ws, i, i + m - 1) AS p FROM i) GROUP BY lang, p HAVING count(*) >= 30),
k AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f),
c AS (SELECT k.lang, k.p, a, k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.p = list_slice(k.p, 1, k) JOIN f y ON y.lang = k.lang AND y.p = list_slice(k.p, k + 1, len(k.p))),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
z AS (SELECT lang, f, p, m, unnest(range(1, len(p) - m + 2)) AS i FROM f, (VALUES (2), (3)) AS o(m) WHERE m < len(p)),
v AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS most FROM z GROUP BY ALL),
s AS (SELECT lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN v USING (lang, p) WHERE most IS NULL OR 100 * most < 80 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op3_quality_rules": OP3,
    "op5_decontamination": OP5,
    "op10_jaccard_join": OP10,
    "op11_minhash": OP11,
    "op12_lexical_search": OP12,
    "op13_collocations": OP13,
}
