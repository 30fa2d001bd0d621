"""Streams of crawl records: sources, unique URLs, rate slots and several sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftwork.sources.delivery import Delivery
from weftwork.sources.records import RECORD, Composite, SinkFailure


def json_lines(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """New JSON Lines files as they are appended to a folder."""
    return spark.readStream.schema(schema).json(path)


def unique_urls(rows: DataFrame, time: str | None = None, delay: str = "1 hour", url: str = "url") -> DataFrame:
    """The first row of each URL.

    With ``time`` a URL is remembered until the watermark has passed it by
    ``delay``, so the state is bounded; without, it is remembered for good.
    """
    rows = rows.withColumn(url, F.trim(url))
    if time is None:
        return rows.dropDuplicates([url])
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])


def rate_slots(requests: DataFrame, idle: str = "1 hour") -> DataFrame:
    """(domain, arrival, slot, wait) from rows (domain, arrival seconds, min_interval).

    One number of state for each domain: its last slot.  Time is that of the
    arrivals: rows that arrive more than ``idle`` behind the latest one are
    dropped as late, and a domain without requests for that long is forgotten, so
    the state is bounded and a run over what is there ends.  Within a batch rows
    are taken by arrival; a domain's rows of one batch are held at once, which
    the source's limit for a batch bounds.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        slots = []
        for arrival, interval in zip(rows["arrival"], rows["min_interval"]):
            last = arrival if last is None else max(arrival, last + interval)
            slots.append(last)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000) + 1000, state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({"domain": key[0], "arrival": rows["arrival"].to_numpy(), "slot": slots, "wait": [s - a for s, a in zip(slots, rows["arrival"])]})

    # the watermark begins at the epoch, where what arrives at 0 would be late: hence a second more
    timed = requests.withColumn("time", F.timestamp_seconds(F.col("arrival") + 1)).withWatermark("time", idle)
    return timed.groupBy("domain").applyInPandasWithState(run, "domain string, arrival double, slot double, wait double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def host_counts(pages: DataFrame, host: str, time: str, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Pages by host and window of event time; late rows count until the watermark passes."""
    return pages.withWatermark(time, delay).groupBy(F.window(time, window), F.col(host)).agg(F.count(F.lit(1)).alias("n"))


def write_all(records: DataFrame, sinks: Composite, checkpoint: str) -> StreamingQuery:
    """Each micro-batch to every sink; a failing sink fails the batch, which is tried again."""

    def save(batch: DataFrame, _: int) -> None:
        sinks.save(batch)

    return records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver(records: DataFrame, delivery: Delivery, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """Each micro-batch to every sink of a delivery, once.

    A sink that fails for good does not stop the stream; with ``strict`` it fails
    the query, and the batch, when it comes again, goes to the sinks that lack it.
    """

    def save(batch: DataFrame, number: int) -> None:
        if not delivery.save(batch, number) and strict:
            raise SinkFailure("save", [name for name, x in delivery.stats().items() if x["failed_saves"]])

    return records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
