"""Run statistics: hosts, totals, queue states, deltas between runs, final errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions import urls


def top_domains(pages: DataFrame, n: int = 10) -> DataFrame:
    """The n hosts with most pages, then by name; invalid hosts are left out."""
    hosts = pages.select(urls.host(F.col("url")).alias("host")).where("host is not null")
    return hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(n)


def crawl_totals(pages: DataFrame) -> DataFrame:
    """Totals over parsed pages (text, links, images, depth)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pages.agg(
        F.count(F.lit(1)).alias("total_pages"),
        zero(F.max("depth")).alias("max_depth"),
        zero(F.sum(F.length("text"))).cast("long").alias("total_text_length"),
        zero(F.sum(F.size("links"))).cast("long").alias("total_links"),
        zero(F.sum(F.size("images"))).cast("long").alias("total_images"),
    )


def queue_states(tasks: DataFrame) -> DataFrame:
    """Tasks by state, and the completed ones."""
    count = lambda *x: F.count_if(F.col("state").isin(*x))
    return tasks.agg(F.count(F.lit(1)).alias("scheduled"), *[count(x).alias(x) for x in ("queued", "active", "processed", "failed", "blocked")], count("processed", "failed", "blocked").alias("completed"))


def counter_delta(current: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters less their baseline, not below 0; keys without growth are left out."""
    old = baseline.select(*keys, F.col(value).alias("_old"))
    out = current.join(old, keys, "left").withColumn(value, F.greatest(F.lit(0), F.col(value) - F.coalesce("_old", F.lit(0))))
    return out.where(F.col(value) > 0).select(*keys, value)


def final_errors(results: DataFrame, order: str) -> DataFrame:
    """The last result of each URL if it is a failure; success clears, a block is ignored."""
    rows = results.where("outcome <> 'robots_blocked'")
    last = rows.groupBy("url").agg(F.max_by(F.struct("outcome", "status_code", "error", "attempts", "elapsed_seconds"), F.col(order)).alias("r"))
    return last.where("r.outcome <> 'success'").select("url", "r.*")


def progress(done: Column, scheduled: Column, waiting: Column, rate: Column) -> tuple[Column, Column]:
    """Percentage done, and seconds to go (null if the rate is 0)."""
    return F.coalesce(F.try_divide(done * 100.0, scheduled), F.lit(0.0)), F.try_divide(waiting.cast("double"), rate)


def pages_per_second(pages: Column, elapsed: Column) -> Column:
    return F.coalesce(F.try_divide(pages.cast("double"), elapsed), F.lit(0.0))
