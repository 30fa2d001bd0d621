"""Queries over the run statistics, each beside DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import urls
from weftwork.operators import outcomes, run_stats, schedule

RUN_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RUN_SQL: dict[str, str] = {}

#: Budgets and factors by class: transient errors have their own, all others those of their parent.
LIMITS, FACTORS = {"TransientError": 2, "CrawlerError": 1}, {"TransientError": 3.0}
#: Where the baseline run ends.
BASELINE = "2024-01-15"


def query(sql: str):
    def register(f):
        RUN_QUERIES[f.__name__], RUN_SQL[f.__name__] = f, sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _made(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    if before is not None:
        events = events.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return run_stats.with_budgets(outcomes.attempts_from_events(events), LIMITS, FACTORS)


def _results(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Each user as a page: what the last of the attempts made gave; purchases over 100 do not parse."""
    last = F.max_by(F.struct("outcome", "status_code", F.col("elapsed_seconds").alias("v")), F.struct("request", "attempt"))
    rows = _made(spark, sf_dir, before).groupBy(F.concat(F.lit("http://h"), (F.col("user_id") % 7).cast("string"), F.lit(".example/"), F.col("user_id").cast("string")).alias("url")).agg(last.alias("r")).select("url", "r.*")
    error = F.when(F.col("outcome") == "http_error", F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).when(F.col("outcome") == "timeout", F.lit("Request timed out"))
    return rows.select("url", "outcome", "status_code", error.alias("error"), F.when((F.col("outcome") == "success") & (F.col("v") > 100), F.lit("too large")).alias("parse_error"))


_MADE = """{p}0 AS (SELECT user_id, event_id, value, n // 4 AS request, n % 4 + 1 AS attempt, CASE WHEN event_type IN ('view', 'purchase') THEN 'success' WHEN event_type IN ('signup', 'click') THEN 'http_error' ELSE 'timeout' END AS outcome,
    CASE WHEN event_type IN ('view', 'purchase') THEN 200 WHEN event_type = 'signup' THEN 404 WHEN event_type = 'click' THEN 503 END AS status_code,
    CASE WHEN event_type IN ('click', 'error') THEN 'TransientError' WHEN event_type = 'signup' THEN 'PermanentError' WHEN event_type NOT IN ('view', 'purchase') THEN 'TransientError' END AS error_type
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events WHERE {where})),
{p}1 AS (SELECT *, count(error_type) OVER (PARTITION BY user_id, request, CASE error_type WHEN 'TransientError' THEN 'TransientError' WHEN 'PermanentError' THEN 'CrawlerError' END ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS nth FROM {p}0),
{p}2 AS (SELECT *, coalesce(error_type = 'TransientError' AND nth <= 2, false) AS again FROM {p}1),
{p}3 AS (SELECT *, coalesce(min(attempt) FILTER (WHERE NOT again) OVER (PARTITION BY user_id, request), max(attempt) OVER (PARTITION BY user_id, request)) AS stop FROM {p}2),
{p} AS (SELECT *, again AND attempt < stop AS retried, attempt = stop AS final, CASE WHEN again AND attempt < stop THEN least(0.5 * 3.0 ** (nth - 1), 30.0) END AS backoff FROM {p}3 WHERE attempt <= stop)"""
_NOW = _MADE.format(p="m", where="true")
_THEN = _MADE.format(p="o", where=f"ts < '{BASELINE}'")
_RESULTS = f"""{_NOW}, r0 AS (SELECT 'http://h' || (user_id % 7) || '.example/' || user_id AS url, arg_max((outcome, status_code, value), (request, attempt)) AS r FROM m GROUP BY user_id),
r1 AS (SELECT url, r[1] AS outcome, r[2] AS status_code, r[3] AS v FROM r0),
r AS (SELECT url, outcome, status_code, CASE WHEN outcome = 'http_error' THEN 'HTTP ' || status_code WHEN outcome = 'timeout' THEN 'Request timed out' END AS error, CASE WHEN outcome = 'success' AND v > 100 THEN 'too large' END AS parse_error FROM r1)"""
_TOTALS = """SELECT count(*) AS total_requests, count(*) FILTER (WHERE outcome = 'success') AS successful_requests, count(*) FILTER (WHERE outcome <> 'success') AS failed_requests,
count(*) FILTER (WHERE outcome = 'http_error') AS http_errors, count(*) FILTER (WHERE outcome = 'network_error') AS network_errors, count(*) FILTER (WHERE outcome = 'timeout') AS timeouts, avg(value) AS average_request_time FROM {}"""


@query(
    f"""WITH {_NOW} SELECT count(*) FILTER (WHERE final) AS total_executions, count(*) AS total_attempts, count(error_type) AS errors, count(*) FILTER (WHERE retried) AS scheduled_retries,
count(*) FILTER (WHERE final AND outcome = 'success' AND attempt > 1) AS successful_retries, count(*) FILTER (WHERE final AND error_type = 'TransientError') AS exhausted_retries,
count(*) FILTER (WHERE final AND error_type = 'PermanentError') AS non_retryable_failures, sum(backoff) AS total_backoff_time, round(avg(backoff), 6) AS average_backoff_time FROM m"""
)
def retry_statistics(spark, sf_dir):
    """AGG14, WIN9, CTL2, CTL4: budgets and factors by class of error."""
    out = run_stats.retry_statistics(_made(spark, sf_dir))
    return out.withColumn("average_backoff_time", F.round("average_backoff_time", 6))


@query(f"WITH {_NOW} SELECT error_type, count(*) AS errors, count(*) FILTER (WHERE retried) AS retries FROM m WHERE error_type IS NOT NULL GROUP BY error_type")
def retries_by_type(spark, sf_dir):
    """AGG14, SRT3."""
    return run_stats.retries_by_type(_made(spark, sf_dir))


@query(f"WITH {_NOW}, s AS ({_TOTALS.format('m')}) SELECT * REPLACE (round(average_request_time, 6) AS average_request_time) FROM s")
def request_statistics(spark, sf_dir):
    """AGG8, AGG9."""
    return run_stats.request_statistics(_made(spark, sf_dir)).withColumn("average_request_time", F.round("average_request_time", 6))


@query(
    f"""WITH {_NOW}, {_THEN}, c AS ({_TOTALS.format('m')}), b AS ({_TOTALS.format('o')})
SELECT greatest(0, c.total_requests - b.total_requests) AS total_requests, greatest(0, c.successful_requests - b.successful_requests) AS successful_requests, greatest(0, c.failed_requests - b.failed_requests) AS failed_requests,
greatest(0, c.http_errors - b.http_errors) AS http_errors, greatest(0, c.network_errors - b.network_errors) AS network_errors, greatest(0, c.timeouts - b.timeouts) AS timeouts,
round((c.average_request_time * c.total_requests - b.average_request_time * b.total_requests) / (c.total_requests - b.total_requests), 4) AS average_request_time FROM c, b"""
)
def request_growth(spark, sf_dir):
    """AGG6, CTL6: a run's figures less its baseline's, the mean again from both sums."""
    counts = ["total_requests", "successful_requests", "failed_requests", "http_errors", "network_errors", "timeouts"]
    now, then = (run_stats.request_statistics(_made(spark, sf_dir, x)) for x in (None, BASELINE))
    out = run_stats.growth(now, then, counts, {"average_request_time": ("successful_requests", "failed_requests")})
    return out.withColumn("average_request_time", F.round("average_request_time", 4))


@query(
    """WITH s0 AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6 AS arrival, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s1 AS (SELECT *, sum(CASE WHEN rn = 1 THEN 0.0 ELSE 900.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM s0),
s AS (SELECT user_id, total + max(arrival - total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - arrival AS wait FROM s1)
SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE wait > 1e-6) AS delayed, round(sum(wait), 2) AS total_wait, round(avg(wait), 2) AS mean_wait FROM s GROUP BY user_id"""
)
def limiter_by_user(spark, sf_dir):
    """AGG10, AGG12: a limiter of one request in 900 seconds for each user."""
    events = _read(spark, sf_dir, "events")
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    interval = run_stats.required_interval(F.lit(1.0), F.lit(600.0), F.lit(900.0), F.lit(0.0), run_stats.jitter_draw(F.col("event_id")))
    slots = schedule.rate_slots(events, "user_id", arrival, interval, ["ts", "event_id"])
    out = run_stats.limiter_statistics(slots, "user_id")
    return out.withColumns({x: F.round(x, 2) for x in ("total_wait", "mean_wait")})


@query(
    """WITH c AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, NOT regexp_matches(url, '^[a-z]+://[^/?#]*/fr/') AS allowed FROM pages)
SELECT count(DISTINCT origin) AS cached_origins, count(DISTINCT origin) AS network_fetches, count(*) - count(DISTINCT origin) AS cache_hits, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS blocked FROM c"""
)
def robots_statistics(spark, sf_dir):
    """AGG11, AGG12: checks of all pages against rules that bar /fr/."""
    u = F.col("url")
    return run_stats.robots_statistics(_read(spark, sf_dir, "pages").select(urls.origin(u).alias("origin"), (~urls.path(u).startswith("/fr/")).alias("allowed")))


@query(
    f"""WITH {_RESULTS}, s AS (SELECT url, CASE WHEN outcome <> 'success' OR parse_error IS NOT NULL THEN 'failed' ELSE 'processed' END AS state, coalesce(error, parse_error) AS reason FROM r
UNION ALL SELECT 'http://never.example/', 'failed', 'Cancelled while processing') SELECT * FROM s"""
)
def page_states(spark, sf_dir):
    """REC1b, JN4, SRC5: every user as a task, and one that was never fetched."""
    results = _results(spark, sf_dir)
    tasks = results.select("url").unionByName(spark.createDataFrame([("http://never.example/",)], "url string"))
    return run_stats.page_states(tasks, results)


@query(
    f"""WITH {_RESULTS}, e AS (SELECT url, CASE WHEN outcome = 'timeout' OR status_code = 503 THEN 'TransientError' WHEN outcome = 'http_error' THEN 'PermanentError' WHEN parse_error IS NOT NULL THEN 'ParseError' END AS error_type FROM r)
SELECT error_type, count(*) AS final_errors, count(*) FILTER (WHERE error_type IN ('PermanentError', 'ParseError')) AS permanent, min(url) AS first_url FROM e WHERE error_type IS NOT NULL GROUP BY error_type"""
)
def final_errors_by_type(spark, sf_dir):
    """AGG15, AGG18, CTL8, JN9, SET3: final errors with those of the parser, and how many of them are permanent."""
    errors = run_stats.error_table(_results(spark, sf_dir))
    permanent = run_stats.permanent_urls(errors).withColumn("lasting", F.lit(True))
    met = errors.join(permanent, "url", "left")
    return met.groupBy("error_type").agg(F.count(F.lit(1)).alias("final_errors"), F.count("lasting").alias("permanent"), F.min("url").alias("first_url"))


@query(
    f"""WITH {_RESULTS}, x AS (SELECT url, status_code, CASE WHEN outcome = 'success' AND parse_error IS NULL THEN 'processed' ELSE 'failed' END AS state FROM r),
k AS (SELECT status_code, count(*) AS n FROM x WHERE status_code IS NOT NULL GROUP BY 1), h AS (SELECT regexp_extract(url, '//([^/]*)', 1) AS host, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, host LIMIT 10)
SELECT count(*) AS total_pages, count(*) AS pages_completed, count(*) FILTER (WHERE state = 'processed') AS successful, count(*) FILTER (WHERE state = 'failed') AS failed, CAST(0 AS BIGINT) AS blocked, count(*) AS pages_scheduled, CAST(0 AS BIGINT) AS pages_queued,
CAST(0 AS BIGINT) AS active_tasks, CAST(max(length(url)) % 3 AS INT) AS max_depth, CAST(sum(length(url)) AS BIGINT) AS total_text_length, count(*) AS total_links, CAST(0 AS BIGINT) AS total_images,
(SELECT string_agg(status_code || '=' || n, ',' ORDER BY status_code) FROM k) AS status_codes, (SELECT string_agg(host || '=' || n, ',' ORDER BY n DESC, host) FROM h) AS top_domains, 50.0 AS elapsed_seconds, count(*) / 50.0 AS pages_per_second FROM x"""
)
def run_snapshot(spark, sf_dir):
    """AGG5, AGG3, SRT1, SRT2: a run's figures in one row."""
    results = _results(spark, sf_dir)
    pages = results.select(F.col("url").alias("text"), F.array("url").alias("links"), F.array().alias("images"))
    totals = pages.agg(F.count(F.lit(1)).alias("total_pages"), (F.max(F.length("text")) % 3).cast("int").alias("max_depth"), F.sum(F.length("text")).cast("long").alias("total_text_length"), F.sum(F.size("links")).cast("long").alias("total_links"), F.sum(F.size("images")).cast("long").alias("total_images"))
    return run_stats.run_snapshot(run_stats.page_states(results.select("url"), results), totals, results, 50.0, urls.host(F.col("url")))


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN '' ELSE 'value' END AS missing, CASE WHEN event_type = 'error' THEN 'note' ELSE '' END AS unknown FROM events WHERE event_type <> 'purchase'"""
)
def record_keys(spark, sf_dir):
    """SET4, PRJ3: records whose keys are not those wanted; only purchases have all, errors one too many."""
    keys = F.when(F.col("event_type") == "purchase", F.array(F.lit("url"), F.lit("value"))).when(F.col("event_type") == "error", F.array(F.lit("url"), F.lit("note"))).otherwise(F.array(F.lit("url")))
    rows = _read(spark, sf_dir, "events").select("event_id", keys.alias("keys"))
    return run_stats.key_report(rows, F.col("keys"), ["url", "value"]).drop("keys")


@query(
    """SELECT url, 'absent from the other' AS difference FROM (SELECT DISTINCT url FROM pages WHERE url LIKE '%/de/%') UNION ALL SELECT url, 'html' FROM (SELECT url FROM pages WHERE url LIKE '%/fr/%' AND url NOT LIKE '%/de/%' GROUP BY url HAVING count(*) = 1)
UNION ALL SELECT url, 'duplicated' FROM (SELECT url FROM pages WHERE url NOT LIKE '%/de/%' GROUP BY url HAVING count(*) > 1)"""
)
def integrity_by_field(spark, sf_dir):
    """JN8, SNK17: two copies of the pages by url; the other lacks /de/ and has changed /fr/."""
    pages = _read(spark, sf_dir, "pages").select("url", F.xxhash64("html").alias("html"))
    other = pages.where(~F.col("url").contains("/de/")).withColumn("html", F.when(F.col("url").contains("/fr/"), F.lit(0).cast("long")).otherwise(F.col("html")))
    return run_stats.compared(pages, other, "url", ["html"])


@query(
    f"""WITH {_NOW}, {_THEN}, x AS (SELECT user_id, arg_max(coalesce(error_type, CASE WHEN value > 100 THEN 'ParseError' END, ''), (request, attempt)) AS k FROM m GROUP BY user_id),
y AS (SELECT user_id, arg_max(coalesce(error_type, CASE WHEN value > 100 THEN 'ParseError' END, ''), (request, attempt)) AS k FROM o GROUP BY user_id)
SELECT 'http://h' || (user_id % 7) || '.example/' || user_id AS url FROM x WHERE k IN ('PermanentError', 'ParseError') AND user_id NOT IN (SELECT user_id FROM y WHERE k IN ('PermanentError', 'ParseError'))"""
)
def new_permanent_errors(spark, sf_dir):
    """SET2, SET3, AGG6: pages whose final error is permanent or of the parser now, and was not in the baseline run."""
    now, then = (run_stats.error_table(_results(spark, sf_dir, x)) for x in (None, BASELINE))
    return run_stats.permanent_urls(now, then)
