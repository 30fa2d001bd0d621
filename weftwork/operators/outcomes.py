"""Request attempts: classification, retry, backoff, timeouts and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default limits of the retry and timeout policies.
MAX_ATTEMPTS, RETRY_BASE, RETRY_FACTOR, RETRY_CAP = 4, 0.5, 2.0, 30.0
TIMEOUTS, TIMEOUT_FACTOR, TIMEOUT_CAP = {"connect": 5.0, "read": 15.0, "total": 30.0}, 2.0, 120.0


def error_type(outcome: Column, status: Column) -> Column:
    """TransientError, NetworkError or PermanentError of a failed attempt; null for others."""
    transient = (outcome == "timeout") | ((outcome == "http_error") & ((status == 429) | (status >= 500)))
    return F.when(transient, "TransientError").when(outcome == "network_error", "NetworkError").when(outcome == "http_error", "PermanentError")


def retryable(outcome: Column, status: Column) -> Column:
    return F.coalesce(error_type(outcome, status).isin("TransientError", "NetworkError"), F.lit(False))


def is_valid_fetch(r) -> Column:
    """Invariants of a fetch result: status, content and error fit the outcome."""
    ok = (r["outcome"] == "success") & r["content"].isNotNull() & r["error"].isNull() & r["status_code"].between(200, 399)
    failed = F.coalesce(F.trim(r["error"]) != "", F.lit(False))
    http = (r["outcome"] == "http_error") & r["status_code"].between(400, 599) & failed
    other = r["outcome"].isin("network_error", "timeout", "robots_blocked") & r["status_code"].isNull() & r["content_type"].isNull() & failed
    return F.coalesce((ok | http | other) & (r["attempts"] >= 1) & (r["elapsed_seconds"] >= 0) & ~F.isnan(r["elapsed_seconds"]) & (r["elapsed_seconds"] < float("inf")) & (F.trim(r["url"]) != "") & F.coalesce(F.trim(r["content_type"]) != "", F.lit(True)), F.lit(False))


# What a failure says that brings no message of its own.
MESSAGES = {"timeout": "Request timed out", "robots_blocked": "Blocked by robots.txt"}


def fetch_result(
    outcome: str, url: Column, *, content: Column | None = None, status_code: Column | None = None, content_type: Column | None = None, error: Column | None = None, attempts: Column | int = 1, elapsed_seconds: Column | float = 0.0
) -> Column:
    """A struct of a fetch's result, with the defaults of its outcome.

    A success without a status has 200; an HTTP error without a message says
    ``HTTP n``, a timeout and a block have messages of their own.  A block has no
    status, content or time.  Whether the parts fit is told by ``is_valid_fetch``.
    """
    none = lambda kind: F.lit(None).cast(kind)
    own = F.lit(MESSAGES.get(outcome)).cast("string")
    if outcome == "success" and status_code is None:
        status_code = F.lit(200)
    if outcome == "http_error" and status_code is not None:
        own = F.concat(F.lit("HTTP "), status_code.cast("string"))
    has_status, blocked = outcome in ("success", "http_error"), outcome == "robots_blocked"
    message = own if error is None else F.coalesce(F.nullif(error, F.lit("")), own)
    return F.struct(
        url.alias("url"),
        F.lit(outcome).alias("outcome"),
        (none("string") if content is None or not has_status else content).alias("content"),
        (none("int") if status_code is None or not has_status else status_code.cast("int")).alias("status_code"),
        (none("string") if content_type is None or not has_status else content_type).alias("content_type"),
        (none("string") if outcome == "success" and error is None else message).alias("error"),
        (F.lit(attempts) if isinstance(attempts, int) else attempts).cast("int").alias("attempts"),
        (F.lit(0.0) if blocked else F.lit(elapsed_seconds) if isinstance(elapsed_seconds, float) else elapsed_seconds).cast("double").alias("elapsed_seconds"),
    )


def legacy_value(r) -> Column:
    """Content, or a line that begins with ``Error:``."""
    return (
        F.when(r["outcome"] == "success", r["content"])
        .when(r["outcome"] == "http_error", F.concat(F.lit("Error: HTTP "), r["status_code"].cast("string")))
        .when(r["outcome"] == "timeout", F.concat(F.lit("Error: Timeout for "), r["url"]))
        .when(r["outcome"] == "network_error", F.concat(F.lit("Error: ClientError "), F.split_part(r["error"], F.lit(":"), F.lit(1))))
        .otherwise(F.concat(F.lit("Error: "), r["error"], F.lit(" for "), r["url"]))
    )


def backoff(attempt: Column, base: float = RETRY_BASE, factor: float = RETRY_FACTOR, cap: float = RETRY_CAP) -> Column:
    """Seconds to wait after a failed attempt: base * factor ** (attempt - 1), at most cap."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), F.least(attempt, F.lit(1000)) - 1), F.lit(cap))


def timeout(kind: str, attempt: Column) -> Column:
    return F.least(F.lit(TIMEOUTS[kind]) * F.pow(F.lit(TIMEOUT_FACTOR), attempt - 1), F.lit(TIMEOUT_CAP))


def attempts_from_events(events: DataFrame) -> DataFrame:
    """A table of request attempts made of events: four in a row of a user are one request."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    outcome = F.when(kind.isin("view", "purchase"), "success").when(kind.isin("signup", "click"), "http_error").otherwise("timeout")
    status = F.when(kind.isin("view", "purchase"), 200).when(kind == "signup", 404).when(kind == "click", 503)
    n = F.row_number().over(order) - 1
    return events.select("user_id", "event_id", "ts", F.floor(n / 4).cast("long").alias("request"), (n % 4 + 1).cast("int").alias("attempt"), outcome.alias("outcome"), status.cast("int").alias("status_code"), F.col("value").alias("elapsed_seconds"))


def terminal_attempts(attempts: DataFrame) -> DataFrame:
    """One row for each request: its first attempt that is not retried, else its last.

    Aggregates by request, so no request's attempts are sorted.
    """
    final = ~retryable(F.col("outcome"), F.col("status_code"))
    row = F.struct("outcome", "status_code")
    stop = F.min(F.when(final, F.col("attempt")))
    known = attempts.groupBy("user_id", "request").agg(
        F.coalesce(stop, F.max("attempt")).alias("attempts"),
        F.coalesce(F.min_by(row, F.when(final, F.col("attempt"))), F.max_by(row, F.col("attempt"))).alias("r"),
    )
    return known.select("user_id", "request", "attempts", F.col("r.outcome").alias("outcome"), F.col("r.status_code").alias("status_code"))


def status_code_distribution(outcomes: DataFrame) -> DataFrame:
    """Counts by status in numeric order; null statuses are left out."""
    counted = outcomes.where("status_code is not null").groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("status_code").select(F.col("status_code").cast("string").alias("status"), "n")
