"""Run-level statistics: retry budgets by type, request totals, page states, snapshots and their growth.

Counters that a running crawler would keep by hand are aggregates over tables of
attempts, slots, checks and tasks; what one run added is a run less its baseline.
"""

from __future__ import annotations

from collections.abc import Mapping

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators import outcomes

# The classes of errors and what each is a kind of.
PARENTS = {"TransientError": "CrawlerError", "NetworkError": "CrawlerError", "PermanentError": "CrawlerError", "ParseError": "PermanentError", "CrawlerError": None}


def resolved_setting(kind: Column, settings: Mapping[str, float], default: float) -> tuple[Column, Column]:
    """The class whose setting holds for an error type (the most specific that has one, else the type itself), and the setting."""
    owner, value = kind, F.lit(default)
    for name in PARENTS:
        at: str | None = name
        while at is not None and at not in settings:
            at = PARENTS[at]
        if at is not None:
            owner = F.when(kind == name, F.lit(at)).otherwise(owner)
            value = F.when(kind == name, F.lit(settings[at])).otherwise(value)
    return owner, value


def with_budgets(attempts: DataFrame, limits: Mapping[str, int], factors: Mapping[str, float], keys: tuple[str, ...] = ("user_id", "request"), max_retries: int = 3) -> DataFrame:
    """The attempts that are made, with error_type, retried and backoff seconds.

    Failures of a request count against the budget of their policy class; the
    first attempt that succeeds, cannot be retried or passes its budget is the
    last.  Windows are over one request's few attempts.
    """
    kind = outcomes.error_type(F.col("outcome"), F.col("status_code"))
    rows = attempts.withColumn("error_type", kind)
    owner, limit = resolved_setting(F.col("error_type"), limits, max_retries)
    _, factor = resolved_setting(F.col("error_type"), factors, outcomes.RETRY_FACTOR)
    so_far = Window.partitionBy(*keys, "policy").orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("policy", owner).withColumn("nth", F.count("error_type").over(so_far))
    again = outcomes.retryable(F.col("outcome"), F.col("status_code")) & (F.col("nth") <= limit)
    stops = Window.partitionBy(*keys)
    rows = rows.withColumn("again", again).withColumn("end", F.min(F.when(~F.col("again"), F.col("attempt"))).over(stops)).withColumn("last", F.max("attempt").over(stops))
    rows = rows.where(F.col("end").isNull() | (F.col("attempt") <= F.col("end")))
    retried = F.col("again") & (F.col("attempt") < F.coalesce("end", "last"))
    wait = F.least(F.lit(outcomes.RETRY_BASE) * F.pow(factor, F.col("nth") - 1), F.lit(outcomes.RETRY_CAP))
    return rows.withColumn("retried", retried).withColumn("backoff", F.when(retried, wait)).withColumn("final", F.col("attempt") == F.coalesce("end", "last")).drop("policy", "nth", "again", "end", "last")


def retry_statistics(made: DataFrame) -> DataFrame:
    """One row of a retry policy's figures over the attempts that ``with_budgets`` leaves."""
    failed = F.col("final") & F.col("error_type").isNotNull()
    can_retry = outcomes.retryable(F.col("outcome"), F.col("status_code"))
    return made.agg(
        F.count_if("final").alias("total_executions"),
        F.count(F.lit(1)).alias("total_attempts"),
        F.count("error_type").alias("errors"),
        F.count_if("retried").alias("scheduled_retries"),
        F.count_if(F.col("final") & (F.col("outcome") == "success") & (F.col("attempt") > 1)).alias("successful_retries"),
        F.count_if(failed & can_retry).alias("exhausted_retries"),
        F.count_if(failed & ~can_retry).alias("non_retryable_failures"),
        F.coalesce(F.sum("backoff"), F.lit(0.0)).alias("total_backoff_time"),
        F.coalesce(F.avg("backoff"), F.lit(0.0)).alias("average_backoff_time"),
    )


def retries_by_type(made: DataFrame) -> DataFrame:
    """Errors and scheduled retries of each type, by name."""
    return made.where("error_type is not null").groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"), F.count_if("retried").alias("retries")).orderBy("error_type")


def request_statistics(made: DataFrame) -> DataFrame:
    """One row of a transport's totals: requests by outcome and their mean seconds."""
    count = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return made.agg(
        F.count(F.lit(1)).alias("total_requests"),
        count("success").alias("successful_requests"),
        count("http_error", "network_error", "timeout").alias("failed_requests"),
        count("http_error").alias("http_errors"),
        count("network_error").alias("network_errors"),
        count("timeout").alias("timeouts"),
        F.coalesce(F.avg("elapsed_seconds"), F.lit(0.0)).alias("average_request_time"),
    )


def limiter_statistics(slots: DataFrame, key: str) -> DataFrame:
    """A limiter's figures by key: requests, delayed ones, seconds waited and their mean over all requests."""
    return slots.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("wait") > 1e-6).alias("delayed"), F.sum("wait").alias("total_wait"), F.avg("wait").alias("mean_wait"))


def robots_statistics(checks: DataFrame) -> DataFrame:
    """One row over checks (origin, allowed): origins known, fetches, cache hits, allowed and blocked."""
    origins = F.count_distinct("origin")
    return checks.agg(origins.alias("cached_origins"), origins.alias("network_fetches"), (F.count(F.lit(1)) - origins).alias("cache_hits"), F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))


def required_interval(rate: Column, min_delay: Column, crawl_delay: Column, jitter: Column, draw: Column) -> Column:
    """Seconds between two requests: the longer of both delays and a share of the jitter, at least one request's at the rate."""
    return F.greatest(F.greatest(F.coalesce(min_delay, F.lit(0.0)), F.coalesce(crawl_delay, F.lit(0.0))) + draw * jitter, F.try_divide(F.lit(1.0), rate))


def jitter_draw(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the row alone, so that a retried task draws it again."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def page_states(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """(url, state, reason): processed, blocked or failed tasks by what their fetch and their parse gave.

    A block is no failure; an error of the fetch or of the parse is; a task
    without any result was cancelled while it was processed.
    """
    r = tasks.join(results, "url", "left")
    state = F.when(F.col("outcome").isNull(), "failed").when(F.col("outcome") == "robots_blocked", "blocked").when((F.col("outcome") != "success") | F.col("parse_error").isNotNull(), "failed").otherwise("processed")
    reason = F.when(F.col("outcome").isNull(), F.lit("Cancelled while processing")).otherwise(F.coalesce("error", "parse_error"))
    return r.select("url", state.alias("state"), F.when(state != "processed", reason).alias("reason"))


def error_table(results: DataFrame) -> DataFrame:
    """(url, error_type) of final failures; a parse error counts where the fetch succeeded, a block does not."""
    kind = F.coalesce(outcomes.error_type(F.col("outcome"), F.col("status_code")), F.when((F.col("outcome") == "success") & F.col("parse_error").isNotNull(), F.lit("ParseError")))
    return results.select("url", kind.alias("error_type")).where("error_type is not null")


def permanent_urls(errors: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """URLs whose final error is permanent or of the parser, less those of the baseline."""
    of = lambda rows: rows.where(F.col("error_type").isin("PermanentError", "ParseError")).select("url").distinct()
    return of(errors) if baseline is None else of(errors).join(of(baseline), "url", "left_anti")


def growth(current: DataFrame, baseline: DataFrame | None, counts: list[str], means: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row less its baseline: counts not below 0; a mean again from the sums of what it is over.

    ``means`` names, for a mean, the counts whose sum it is over.  Without a
    baseline nothing has grown: every figure is 0.
    """
    before = (current if baseline is None else baseline).select([F.col(x).alias(f"__{x}") for x in [*counts, *(means or {})]])
    rows = current.crossJoin(F.broadcast(before))  # one row each
    out = [F.greatest(F.lit(0), F.col(x) - F.col(f"__{x}")).alias(x) for x in counts]
    for mean, over in (means or {}).items():
        now, old = sum((F.col(x) for x in over), F.lit(0)), sum((F.col(f"__{x}") for x in over), F.lit(0))
        total = F.greatest(F.lit(0.0), F.col(mean) * now - F.col(f"__{mean}") * old)
        grown = sum((F.greatest(F.lit(0), F.col(x) - F.col(f"__{x}")) for x in over), F.lit(0))
        out.append(F.when(grown > 0, total / grown).otherwise(F.lit(0.0)).alias(mean))
    return rows.select(*out)


def run_snapshot(states: DataFrame, totals: DataFrame, results: DataFrame, elapsed: float, host: Column) -> DataFrame:
    """One row of a run: pages by state, totals of their content, rate, statuses and top hosts.

    ``states`` has url and state, ``totals`` is the one row of ``crawl_totals``,
    ``results`` url and status_code.  Statuses are ``code=n`` by number, hosts
    ``host=n`` by falling number, ten at most.
    """
    terminal = F.col("state").isin("processed", "failed", "blocked")
    count = lambda *x: F.count_if(F.col("state").isin(*x))
    own = states.agg(
        F.count_if(terminal).alias("pages_completed"), count("processed").alias("successful"), count("failed").alias("failed"), count("blocked").alias("blocked"),
        F.count(F.lit(1)).alias("pages_scheduled"), count("queued").alias("pages_queued"), count("active").alias("active_tasks"),
    )
    codes = results.where("status_code is not null").groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))  # a few hundred codes at most
    codes = codes.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status_code", "n"))), lambda x: F.concat_ws("=", x["status_code"], x["n"])), ",").alias("status_codes"))
    hosts = states.where(terminal).select(host.alias("host")).where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(10)
    hosts = hosts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "host"))), lambda x: F.concat_ws("=", x["host"], -x["m"])), ",").alias("top_domains"))
    row = own.crossJoin(totals.drop("total_pages")).crossJoin(codes).crossJoin(hosts)  # one row each
    return row.select(
        F.col("pages_completed").alias("total_pages"), "*", F.lit(float(elapsed)).alias("elapsed_seconds"),
        F.coalesce(F.try_divide(F.col("pages_completed").cast("double"), F.lit(float(elapsed))), F.lit(0.0)).alias("pages_per_second"),
    )


def report_line(done: Column, scheduled: Column, failed: Column, rate: Column) -> Column:
    """A line of progress for a person: pages done and failed, share and rate."""
    return F.format_string("%d/%d pages (%.1f%%), %d failed, %.2f pages/s", done, scheduled, F.coalesce(F.try_divide(done * 100.0, scheduled), F.lit(0.0)), failed, rate)


def key_differences(found: list[str], wanted: list[str]) -> dict[str, list[str]]:
    """Missing and unknown names of a record's keys, sorted."""
    return {"missing": sorted(set(wanted) - set(found)), "unknown": sorted(set(found) - set(wanted))}


def key_report(rows: DataFrame, keys: Column, wanted: list[str]) -> DataFrame:
    """Rows whose keys are not the wanted ones, with the missing and the unknown, sorted and joined."""
    want = F.array(*[F.lit(x) for x in wanted])
    missing, unknown = F.array_sort(F.array_except(want, keys)), F.array_sort(F.array_except(keys, want))
    return rows.select("*", F.array_join(missing, ",").alias("missing"), F.array_join(unknown, ",").alias("unknown")).where("missing <> '' or unknown <> ''")


def compared(first: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys on which two sets of records differ: absent from one, duplicated in one, or the fields that are not equal; a null key is a key."""
    rows = integrity({"first": first, "other": other}, key, fields)
    names = {"absent": F.concat(F.lit("absent from the "), "backend"), "duplicated": F.lit("duplicated")}
    said = F.when(F.col("difference") == "absent", names["absent"]).when(F.col("difference") == "duplicated", names["duplicated"]).otherwise(F.col("difference"))
    rank = F.when(F.col("difference") == "absent", 0).when(F.col("difference") == "duplicated", 1).otherwise(2)
    return rows.groupBy(key).agg(F.min_by(said, rank).alias("difference"))


def _of_backend(name: str):
    return lambda x: F.struct(F.lit(name).alias("backend"), x.alias("difference"))


def integrity(backends: Mapping[str, DataFrame], key: str, fields: list[str], expected: DataFrame | None = None) -> DataFrame:
    """(key, backend, difference): what is wrong with records that several backends hold.

    One pass over all backends: each key's rows are counted by backend and their
    fields known by 64-bit hashes, so rows of a key are summed where they are read.
    A backend may lack a key of ``expected`` (key), or without that of another backend
    (absent), have one that is not expected (unexpected), have it more than once (duplicated),
    or differ from the first backend in some fields (their names, by commas); rows of
    duplicates that differ count as differing.  Null keys and fields equal themselves.
    """
    named = list(backends)
    hashed = lambda name, rows: rows.select(F.col(key).alias("key"), F.lit(name).alias("b"), *[F.xxhash64(F.col(c).isNull(), F.to_json(F.struct(c)), F.lit(i)).alias(f"f{i}") for i, c in enumerate(fields)])
    rows = reduce(DataFrame.unionByName, [hashed(name, x) for name, x in backends.items()])
    if expected is not None:
        rows = rows.unionByName(expected.select(F.col(key).alias("key"), F.lit("").alias("b"), *[F.lit(None).cast("long").alias(f"f{i}") for i in range(len(fields))]))
    own = lambda name, c: F.when(F.col("b") == name, F.col(c))
    out = [F.count_if(F.col("b") == "").alias("wanted")]
    for n, name in enumerate(named):
        out.append(F.count_if(F.col("b") == name).alias(f"n{n}"))
        out += [f(own(name, f"f{i}")).alias(f"{x}{n}_{i}") for i in range(len(fields)) for x, f in (("lo", F.min), ("hi", F.max))]
    seen = rows.groupBy("key").agg(*out)
    found = []
    for n, name in enumerate(named):
        differs = [F.when(~(F.col(f"lo{n}_{i}").eqNullSafe(F.col(f"lo0_{i}")) & F.col(f"hi{n}_{i}").eqNullSafe(F.col(f"hi0_{i}"))), F.lit(c)) for i, c in enumerate(fields)]
        unequal = F.nullif(F.concat_ws(",", *differs), F.lit("")) if n else F.lit(None).cast("string")
        has, lacking = F.col(f"n{n}") > 0, F.lit(expected is None) | (F.col("wanted") > 0)
        said = F.array(
            F.when(~has & lacking, F.lit("absent")),
            F.when(has & F.lit(expected is not None) & (F.col("wanted") == 0), F.lit("unexpected")),
            F.when(F.col(f"n{n}") > 1, F.lit("duplicated")),
            F.when(has & (F.col("n0") > 0), unequal),
        )
        found.append(F.transform(F.array_compact(said), _of_backend(name)))
    return seen.select(F.col("key").alias(key), F.explode(F.concat(*found)).alias("x")).select(key, "x.*")


# The figures of a crawler's requests, and which are counts, sums and means of others.
REQUEST_COUNTS = (
    "total_requests successful_requests failed_requests http_errors network_errors timeouts rate_limited_requests delayed_requests "
    "scheduled_retries successful_retries robots_network_fetches robots_cache_hits robots_allowed robots_blocked"
).split()
REQUEST_SUMS = "total_rate_limit_wait total_backoff_time".split()
REQUEST_RATIOS = {"average_rate_limit_wait": ("total_rate_limit_wait", "rate_limited_requests"), "average_retry_wait": ("total_backoff_time", "scheduled_retries")}
REQUEST_KEYS = [*REQUEST_COUNTS, *REQUEST_SUMS, *REQUEST_RATIOS, "current_requests_per_second", "average_request_time", "errors_by_type", "permanent_error_urls"]


def _ratio(total: Column, count: Column) -> Column:
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def request_snapshot(made: DataFrame, rate: DataFrame | None = None, slots: DataFrame | None = None, checks: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One row with the 22 figures of a crawler's requests, of four parts of one row each.

    ``made`` has the attempts that ``with_budgets`` leaves, ``rate`` the one column
    current_requests_per_second, ``slots`` the requests of the limiter (wait),
    ``checks`` those of robots rules (origin, allowed), ``errors`` the final errors by
    url.  A part that is off (None) has zeros.  The URLs of permanent errors are
    ordered; their number is that of the failed pages.
    """
    requests = request_statistics(made)
    retries = made.agg(F.count_if("retried").alias("scheduled_retries"), F.coalesce(F.sum("backoff"), F.lit(0.0)).alias("total_backoff_time"), F.count_if(F.col("final") & (F.col("outcome") == "success") & (F.col("attempt") > 1)).alias("successful_retries"))
    kinds = made.where("error_type is not null").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("errors_by_type"))  # a few classes
    zero = lambda n: F.lit(n)
    spark = made.sparkSession
    one = spark.range(1)
    speed = one.select(zero(0.0).alias("current_requests_per_second")) if rate is None else rate.agg(F.coalesce(F.max("current_requests_per_second"), F.lit(0.0)).cast("double").alias("current_requests_per_second"))
    if slots is None:
        waits = one.select(zero(0).cast("long").alias("rate_limited_requests"), zero(0).cast("long").alias("delayed_requests"), zero(0.0).alias("total_rate_limit_wait"))
    else:
        waits = slots.agg(F.count(F.lit(1)).alias("rate_limited_requests"), F.count_if(F.col("wait") > 1e-6).alias("delayed_requests"), F.coalesce(F.sum("wait"), F.lit(0.0)).alias("total_rate_limit_wait"))
    if checks is None:
        robots = one.select(*[zero(0).cast("long").alias(f"robots_{x}") for x in ("network_fetches", "cache_hits", "allowed", "blocked")])
    else:
        robots = robots_statistics(checks).select(*[F.col(x).alias(f"robots_{x}") for x in ("network_fetches", "cache_hits", "allowed", "blocked")])
    if errors is None:
        lasting = one.select(F.array().cast("array<string>").alias("permanent_error_urls"))
    else:
        lasting = permanent_urls(errors).agg(F.array_sort(F.collect_set("url")).alias("permanent_error_urls"))
    row = reduce(DataFrame.crossJoin, [requests, retries, kinds, speed, waits, robots, lasting])  # one row each
    return row.withColumns({x: _ratio(F.col(total), F.col(count)) for x, (total, count) in REQUEST_RATIOS.items()}).select(*REQUEST_KEYS)


def request_growth(current: DataFrame, baseline: DataFrame | None, final_errors: DataFrame | None = None) -> DataFrame:
    """What one run adds to a snapshot of 22 figures: differences not below 0, and every mean again from what it is over.

    Errors are those of types that grew.  Permanent URLs are the ones the baseline
    lacks and those of ``final_errors`` (url, error_type).  Without a baseline nothing
    has grown and no request is current.
    """
    before = (current if baseline is None else baseline).select([F.col(x).alias(f"__{x}") for x in REQUEST_KEYS])
    row = current.select(*REQUEST_KEYS).crossJoin(before)  # one row each
    if final_errors is not None:
        row = row.crossJoin(permanent_urls(final_errors).agg(F.collect_set("url").alias("__own")))
    less = {x: F.greatest(F.lit(0), F.col(x) - F.col(f"__{x}")) for x in REQUEST_COUNTS} | {x: F.greatest(F.lit(0.0), F.col(x) - F.col(f"__{x}")) for x in REQUEST_SUMS}
    done = lambda p: F.col(f"{p}successful_requests") + F.col(f"{p}failed_requests")
    seconds = F.greatest(F.lit(0.0), F.col("average_request_time") * done("") - F.col("__average_request_time") * done("__"))
    errors = F.map_filter(F.transform_values("errors_by_type", lambda k, v: F.greatest(F.lit(0), v - F.coalesce(F.element_at("__errors_by_type", k), F.lit(0)))), lambda _, v: v > 0)
    lasting = F.array_except("permanent_error_urls", "__permanent_error_urls")
    if final_errors is not None:
        lasting = F.array_union(lasting, "__own")
    out = {
        **less,
        **{x: _ratio(less[total], less[count]) for x, (total, count) in REQUEST_RATIOS.items()},
        "current_requests_per_second": F.col("current_requests_per_second") if baseline is not None else F.lit(0.0),
        "average_request_time": _ratio(seconds, less["successful_requests"] + less["failed_requests"]),
        "errors_by_type": errors,
        "permanent_error_urls": F.array_sort(lasting),
    }
    return row.select(*[out[x].alias(x) for x in REQUEST_KEYS])


def whole_snapshot(run: DataFrame, requests: DataFrame, storage: DataFrame | None = None, active_requests: Column | int = 0) -> DataFrame:
    """The 19 fields of a run: those of ``run_snapshot``, the requests in flight, and what requests and storage grew by."""
    row = run.crossJoin(requests.select(F.struct(*requests.columns).alias("request_stats")))
    row = row.crossJoin(storage.select(F.first(storage.columns[0]).alias("storage_stats")) if storage is not None else run.sparkSession.range(1).select(F.lit(None).cast("string").alias("storage_stats")))
    names = [x for x in run.columns if x not in ("elapsed_seconds", "pages_per_second")]
    at = names.index("active_tasks") + 1
    flight = (F.lit(active_requests) if isinstance(active_requests, int) else active_requests).cast("long").alias("active_requests")
    return row.select(*names[:at], flight, *names[at:], "elapsed_seconds", "pages_per_second", "request_stats", "storage_stats")


#: What ends the visit of a page, and the state it ends in.
ENDS = {"blocked": "blocked", "fetch_error": "failed", "parse_error": "failed", "exception": "failed", "cancelled": "failed", "done": "processed"}


def visited_states(tasks: DataFrame, steps: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """(url, state, reason) of tasks (url) after steps (url, visit, seq, kind, error_type, message).

    ``keys`` name a page in both, for tables with several pages of one url.
    A page's last visit counts.  The first of its steps that ends it (ENDS) gives the
    state: what comes after, such as the ``done`` of a visit that was cancelled, no
    longer does.  A visit without an end is active, a task without a visit queued.
    An exception's reason is ``Type: message``; a cancelled visit's is fixed, a
    block's is its message or the fixed one.  Both choices are aggregates that
    combine where the steps are read, so no page's steps are sorted or met in one task.
    """
    ends = F.col("kind").isin(*ENDS)
    reason = (
        F.when(F.col("kind") == "exception", F.concat("error_type", F.lit(": "), F.coalesce("message", F.lit(""))))
        .when(F.col("kind") == "cancelled", F.lit("Cancelled while processing"))
        .when(F.col("kind") == "blocked", F.coalesce(F.nullif("message", F.lit("")), F.lit("Blocked by robots.txt")))
        .when(F.col("kind") != "done", F.col("message"))
    )
    state = F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])[F.col("kind")]
    visits = steps.groupBy(*keys, "visit").agg(F.min_by(F.struct(state.alias("state"), reason.alias("reason")), F.when(ends, F.col("seq"))).alias("end"))
    last = visits.groupBy(*keys).agg(F.max_by(F.struct("end"), "visit").alias("v"))
    known = tasks.select(*keys).distinct().join(last.withColumn("met", F.lit(True)), list(keys), "left")
    state = F.when(F.col("met").isNull(), "queued").otherwise(F.coalesce("v.end.state", F.lit("active")))
    return known.select(*keys, state.alias("state"), F.col("v.end.reason").alias("reason"))
