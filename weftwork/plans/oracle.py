"""DuckDB SQL with the same results as the queries, where SQL can say it."""

from weftwork.plans import crawl_queries  # noqa: F401  (registers its queries)
from weftwork.plans.run_queries import RUN_SQL

_PICKS = ["h1", "div.ad", "nav > ul > li + li > a[href^='/']", "body > footer", "li:nth-child(3)", "html:root > head > title", "article > ul", "#main .lead", "div["]

_HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PLAIN = "replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_TEXT = _CLEAN.format(_PLAIN.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<!--|-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"))
_TITLE = _CLEAN.format(_PLAIN.format(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
_DESCRIPTION = """regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)"""
_ROOT = r"regexp_extract(url, '^[a-z]+://[^/?#]*')"
_HREFS = """regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)"""
_LINKS = f"l0 AS (SELECT page_id, {_ROOT} AS root, unnest({_HREFS}) AS href, generate_subscripts({_HREFS}, 1) - 1 AS pos FROM pages), l AS (SELECT page_id, root || href AS link, CAST(min(pos) AS BIGINT) AS pos FROM l0 GROUP BY ALL)"
_ATTEMPTS = """a0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
a AS (SELECT user_id, n // 4 AS request, CAST(n % 4 + 1 AS INT) AS attempt,
             CASE WHEN event_type IN ('view', 'purchase') THEN 'success' WHEN event_type IN ('signup', 'click') THEN 'http_error' ELSE 'timeout' END AS outcome,
             CASE WHEN event_type IN ('view', 'purchase') THEN 200 WHEN event_type = 'signup' THEN 404 WHEN event_type = 'click' THEN 503 END AS status_code,
             event_type IN ('click', 'error') AS again FROM a0),
e AS (SELECT user_id, request, coalesce(min(attempt) FILTER (WHERE NOT again), max(attempt)) AS attempts FROM a GROUP BY ALL),
t AS (SELECT a.user_id, a.request, e.attempts, a.outcome, a.status_code FROM a JOIN e ON a.user_id = e.user_id AND a.request = e.request AND a.attempt = e.attempts)"""
_SLOTS = """s0 AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS arrival, greatest(1.0, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 600) AS d, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s1 AS (SELECT *, sum(CASE WHEN rn = 1 THEN 0.0 ELSE d END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM s0),
s AS (SELECT event_id, total + max(arrival - total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - arrival AS wait FROM s1)"""
_GRAPH = "g AS (SELECT o_custkey AS src, o_orderkey AS pos, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders)"

SQL: dict[str, str] = {
    **RUN_SQL,
    "top_domains": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10",
    "host_page_counts": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1",
    "url_origin": f"SELECT page_id, lower({_ROOT}) AS origin FROM pages",
    "url_defrag_distinct": "SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages",
    "url_filter_https_en": r"SELECT page_id, url FROM pages WHERE (regexp_matches(url, '^https://') OR regexp_matches(url, '/en/')) AND NOT regexp_matches(url, '\?utm_') AND NOT regexp_matches(url, '\.html$')",
    "same_domain_semi": f"SELECT page_id, url FROM pages WHERE {_HOST} IN (SELECT {_HOST} FROM pages WHERE url LIKE '%/de/%')",
    "page_title_meta": f"SELECT page_id, {_TITLE} AS title, {_CLEAN.format(_PLAIN.format(_DESCRIPTION))} AS description FROM pages",
    "page_links": f"WITH {_LINKS} SELECT * FROM l",
    "page_text": f"SELECT page_id, {_TEXT} AS text FROM pages",
    "page_headings": f"SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS pos, unnest(l) AS level, {_CLEAN.format(_PLAIN.format('unnest(h)'))} AS text FROM (SELECT page_id, regexp_extract_all(html, '<(h[123])[^>]*>', 1) AS l, regexp_extract_all(html, '<h[123][^>]*>(.*?)</h[123]>', 1) AS h FROM pages)",
    "page_select": f"""WITH e AS (SELECT html, page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages),
p AS (SELECT page_id, unnest([{", ".join("'" + x.replace("'", "''") + "'" for x in _PICKS)}]) AS selector, unnest([regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), list_filter(items[2:], lambda x: x LIKE '<li><a href="/%')[1],
    regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), items[3], regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '', '', '']) AS x FROM e)
SELECT page_id, selector, coalesce({_CLEAN.format(_PLAIN.format("regexp_replace(x, '<[^>]*>', ' ', 'g')"))}, '') AS text FROM p""",
    "page_lists": f"""SELECT page_id, CAST(0 AS BIGINT) AS pos, 'ul' AS type, CAST(len(i) AS BIGINT) AS n_items, {_PLAIN.format("array_to_string(i, '|')")} AS items FROM (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a></li>', 1) AS i FROM pages)""",
    "page_images_tables": "SELECT page_id, CAST(len(regexp_extract_all(html, '<img')) AS BIGINT) AS n_images, CAST(len(regexp_extract_all(html, '<table')) AS BIGINT) AS n_tables FROM pages",
    "page_summary": f"""WITH {_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM l),
f AS (SELECT page_id, count(*) AS n_links, string_agg(link, '|' ORDER BY pos) FILTER (WHERE rn <= 5) AS first_links FROM r GROUP BY page_id)
SELECT page_id, {_TITLE} AS title, length({_TEXT}) AS text_length, coalesce(n_links, 0) AS n_links, {_CLEAN.format(_PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))} AS headings, coalesce(first_links, '') AS first_links FROM pages LEFT JOIN f USING (page_id)""",
    "crawl_content_totals": f"WITH {_LINKS} SELECT count(*) AS total_pages, CAST(max(len(regexp_extract_all(regexp_replace(url, '[?#].*$', ''), '/')) - 2) AS INT) AS max_depth, CAST(sum(length({_TEXT})) AS BIGINT) AS total_text_length, (SELECT count(*) FROM l) AS total_links, CAST(sum(len(regexp_extract_all(html, '<img'))) AS BIGINT) AS total_images FROM pages",
    "crawl_records_build": f"WITH {_LINKS}, n AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id) SELECT url, {_TITLE} AS title, length({_TEXT}) AS text_length, coalesce(n, 0) AS n_links, 200 AS status_code, CASE WHEN url LIKE 'https:%' THEN 'text/html' ELSE 'application/octet-stream' END AS content_type FROM pages LEFT JOIN n USING (page_id)",
    "attempt_outcomes": f"WITH {_ATTEMPTS} SELECT outcome, CASE WHEN again THEN 'TransientError' WHEN outcome = 'http_error' THEN 'PermanentError' ELSE 'none' END AS error_type, again AS retryable, count(*) AS n FROM a GROUP BY ALL",
    "status_code_distribution": f"WITH {_ATTEMPTS} SELECT CAST(status_code AS VARCHAR) AS status, count(*) AS n FROM t WHERE status_code IS NOT NULL GROUP BY 1",
    "error_type_counts": f"WITH {_ATTEMPTS} SELECT CASE WHEN again THEN 'TransientError' ELSE 'PermanentError' END AS error_type, count(*) AS failed_attempts, count(*) FILTER (WHERE attempt = attempts) AS final_errors FROM a JOIN e USING (user_id, request) WHERE attempt <= attempts AND outcome <> 'success' GROUP BY 1",
    "retry_terminal": f"WITH {_ATTEMPTS} SELECT * FROM t",
    "retry_backoff_total": f"WITH {_ATTEMPTS}, w AS (SELECT user_id, unnest(range(1, attempts)) AS attempt FROM e) SELECT user_id, count(*) AS retries, sum(least(0.5 * 2.0 ** (attempt - 1), 30.0)) AS backoff_seconds FROM w GROUP BY user_id",
    "timeout_growth": f"WITH {_ATTEMPTS} SELECT attempt, count(*) AS n, max(least(5.0 * 2.0 ** (attempt - 1), 120.0)) AS connect_timeout, max(least(15.0 * 2.0 ** (attempt - 1), 120.0)) AS read_timeout, max(least(30.0 * 2.0 ** (attempt - 1), 120.0)) AS total_timeout FROM a GROUP BY attempt",
    "rate_schedule": f"WITH {_SLOTS} SELECT event_id, round(wait, 3) AS wait FROM s",
    "rate_stats": f"WITH {_SLOTS} SELECT count(*) AS total_requests, count(*) FILTER (WHERE wait > 1e-6) AS delayed_requests, round(sum(wait), 1) AS total_wait FROM s",
    "trailing_rate": "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "concurrency_peak": """WITH i AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e FROM events),
m AS (SELECT event_type, s AS moment, 1 AS step FROM i WHERE e > s UNION ALL SELECT event_type, e, -1 FROM i WHERE e > s),
r AS (SELECT event_type, sum(step) OVER (PARTITION BY event_type ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS active FROM m)
SELECT event_type, CAST(max(active) AS BIGINT) AS peak FROM r GROUP BY event_type""",
    "frontier_order_cap": f"WITH {_LINKS}, f AS (SELECT link, min((page_id, pos)) AS place FROM l WHERE link NOT IN (SELECT url FROM pages) GROUP BY link) SELECT link, row_number() OVER (ORDER BY place) AS seq FROM f ORDER BY place LIMIT 50",
    "bfs_orders_graph": f"WITH RECURSIVE {_GRAPH}, r(url, depth) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, depth + 1 FROM r JOIN g ON src = url WHERE depth < 2) SELECT url, min(depth) AS depth FROM r GROUP BY url",
    "bfs_orders_capped": f"""WITH {_GRAPH}, one AS (SELECT dst AS url, row_number() OVER (ORDER BY min(pos)) AS seq FROM g WHERE src = 1 AND dst <> 1 GROUP BY dst),
two AS (SELECT dst AS url, min((seq, pos)) AS place FROM one JOIN g ON src = one.url WHERE dst <> 1 AND dst NOT IN (SELECT url FROM one) GROUP BY dst),
n AS (SELECT CAST(1 AS BIGINT) AS url, 0 AS depth, CAST(0 AS BIGINT) AS seq UNION ALL SELECT url, 1, seq FROM one UNION ALL SELECT url, 2, (SELECT count(*) FROM one) + row_number() OVER (ORDER BY place) FROM two)
SELECT * FROM n WHERE seq < 50""",
    "upsert_last_wins": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "integrity_except": "SELECT page_id, url, 'first' AS side FROM pages WHERE page_id IN (3, 5) UNION ALL SELECT page_id, url || '#x', 'other' FROM pages WHERE page_id = 5",
    "stats_delta": "SELECT event_type, n FROM (SELECT event_type, count(*) FILTER (WHERE ts >= '2024-01-15') AS n FROM events GROUP BY 1) WHERE n > 0",
    "robots_decision": r"""SELECT page_id, CASE WHEN host LIKE 'www.%' THEN true WHEN host LIKE 'blog.%' THEN false WHEN host LIKE '%.org' THEN true WHEN url LIKE 'https%' THEN NOT starts_with(p, '/fr/') ELSE starts_with(p, '/en/') END AS allowed
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?#]*', '') AS p FROM pages)""",
    "sitemap_resolve": f"SELECT {_HOST} AS root, row_number() OVER (PARTITION BY {_HOST} ORDER BY replace(url, '&', '&amp;') || '<') - 1 AS pos, url FROM pages",
    "queue_states": f"""WITH {_ATTEMPTS}, l AS (SELECT user_id, arg_max(outcome, request) AS o, arg_max(coalesce(status_code, 0), request) AS s FROM t GROUP BY user_id),
x AS (SELECT CASE WHEN o = 'success' THEN 'processed' WHEN s = 404 THEN 'failed' WHEN o = 'timeout' THEN 'queued' ELSE 'blocked' END AS state FROM l)
SELECT count(*) AS scheduled, count(*) FILTER (WHERE state = 'queued') AS queued, CAST(0 AS BIGINT) AS active, count(*) FILTER (WHERE state = 'processed') AS processed, count(*) FILTER (WHERE state = 'failed') AS failed,
       count(*) FILTER (WHERE state = 'blocked') AS blocked, count(*) FILTER (WHERE state IN ('processed', 'failed', 'blocked')) AS completed FROM x""",
}
