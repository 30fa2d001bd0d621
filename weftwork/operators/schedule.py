"""Ordered recurrences as windows: rate slots, trailing rates, concurrency, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.storage import saved


#: Chunks that the rows of a limiter are dealt to, if the session's shuffle partitions are fewer.
CHUNKS = 8


def in_chunks(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``_chunk``: ranges of (keys, order), so that a key with many rows is many chunks, each after the ones before it."""
    parts = max(CHUNKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return saved(rows.repartitionByRange(parts, *keys, *order).withColumn("_chunk", F.spark_partition_id()), label)


def rate_slots(requests: DataFrame, key: str, arrival: Column, interval: Column, order: list[str]) -> DataFrame:
    """``requests`` with arrival, slot and wait in seconds of a limiter by key.

    Slots follow s = max(a, previous s + d).  With D the running sum of d (its
    first d is 0) that is s = D + running max of (a - D).  Both run over chunks of a
    key: a chunk is known by its sum of d and its running max from D = 0, which
    compose, so its rows need only what the chunks before it come to, and one key
    with all rows is many tasks.
    """
    rows = in_chunks(requests.withColumn("arrival", arrival).withColumn("_d", interval.cast("double")), [key], order, "slots")
    running = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sum", F.sum("_d").over(running))
    rows = rows.withColumn("_most", F.max(F.col("arrival") - F.col("_sum")).over(running))
    chunks = rows.groupBy(key, "_chunk").agg(F.max("_most").alias("_most"), F.sum("_d").alias("_total"), F.min_by("_d", F.struct(*order)).alias("_head"))
    by_chunk = Window.partitionBy(key).orderBy("_chunk")  # a row for each chunk
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0.0)) - F.first("_head").over(by_chunk))
    chunks = chunks.withColumn("_past", F.max(F.col("_most") - F.col("_base")).over(before))
    chunks = chunks.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), "_base", "_past")
    met = rows.join(F.broadcast(chunks) if _few(chunks) else chunks, rows[key].eqNullSafe(F.col("_key")) & (rows["_chunk"] == F.col("_of")))
    met = met.withColumn("slot", F.col("_base") + F.col("_sum") + F.greatest("_past", F.col("_most") - F.col("_base")))
    return met.withColumn("wait", F.col("slot") - F.col("arrival")).drop("_d", "_sum", "_most", "_chunk", "_key", "_of", "_base", "_past")


def _few(rows: DataFrame, most: int = 100_000) -> bool:
    return rows.limit(most + 1).count() <= most


def rate_stats(slots: DataFrame) -> DataFrame:
    """Totals of a limiter; the mean wait is over all requests, delayed or not."""
    return slots.agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("wait") > 1e-6).alias("delayed_requests"), F.coalesce(F.sum("wait"), F.lit(0.0)).alias("total_wait"), F.coalesce(F.avg("wait"), F.lit(0.0)).alias("mean_wait"))


def trailing_count(rows: DataFrame, micros: Column, seconds: int, key: str | None = None) -> DataFrame:
    """``rows`` with the number of rows in (t - seconds, t], per key if given.

    Without a key Spark would sort all rows in one task, so rows are dealt to
    spans of ``seconds``.  A span begins with all rows of the one before it, each of
    which leaves ``seconds`` after it came, so the number is a running sum: a frame
    that slides would be added up anew at every row, with the square of a span's
    rows.  Rows that leave are one for each moment.
    """
    width = seconds * 1_000_000
    rows = rows.withColumn("_t", micros).withColumn("_k", F.lit(0) if key is None else F.col(key)).withColumn("_span", F.floor(F.col("_t") / width))
    left = rows.groupBy("_k", "_t", "_span").agg(F.count(F.lit(1)).alias("_n")).select("_k", (F.col("_t") + width).alias("_t"), (F.col("_span") + 1).alias("_span"), (-F.col("_n")).alias("_step"))
    both = rows.withColumn("_step", F.lit(1).cast("long")).unionByName(left, allowMissingColumns=True)
    span = Window.partitionBy("_k", "_span")
    so_far = F.sum("_step").over(span.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    begin = F.sum(F.when(F.col("_step") < 0, -F.col("_step"))).over(span)
    recent = (so_far + F.coalesce(begin, F.lit(0))).alias("recent")
    return both.select("*", recent).where("_step = 1").drop("_t", "_k", "_span", "_step")


def concurrency(intervals: DataFrame, start: str, end: str, key: str, width: int = 3_600_000_000) -> DataFrame:
    """Highest number of intervals [start, end) that hold at once, by key; ends come before starts.

    A few keys may hold all rows, so each span of ``width`` is walked by itself,
    from the number of intervals that hold where it begins: the sum over the spans
    before it, of which a key has one row each.
    """
    marks = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("x"))
    marks = marks.withColumn("span", F.floor(F.col("x.at") / width))
    before = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    begins = marks.groupBy(key, "span").agg(F.sum("x.step").alias("net")).select(F.col(key).alias("_key"), F.col("span").alias("_span"), F.coalesce(F.sum("net").over(before), F.lit(0)).alias("begin"))
    walk = Window.partitionBy(key, "span").orderBy("x.at", "x.step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = marks.withColumn("active", F.sum("x.step").over(walk)).groupBy(key, "span").agg(F.max("active").alias("most"))
    met = own.join(begins, own[key].eqNullSafe(begins["_key"]) & (own["span"] == begins["_span"]))
    return met.groupBy(key).agg(F.max(F.col("most") + F.col("begin")).alias("peak"))


def loads_at(intervals: DataFrame, domain: str, queued: str, start: str, end: str, at: Column) -> DataFrame:
    """(domain, active, waiting): requests of each domain that run, or wait for a slot, at a moment; domains with neither are left out.

    A request waits in [queued, start) and runs in [start, end); one without a start
    still waits, one without an end still runs.
    """
    begun = F.coalesce(F.col(start) <= at, F.lit(False))
    waits = (F.col(queued) <= at) & ~begun
    runs = begun & F.coalesce(F.col(end) > at, F.lit(True))
    return intervals.groupBy(domain).agg(F.count_if(runs).alias("active"), F.count_if(waits).alias("waiting")).where("active > 0 or waiting > 0")


def load_totals(loads: DataFrame, total_limit: int, domain_limit: int | None) -> DataFrame:
    """One row: the limits, and all that runs and waits."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return loads.agg(F.lit(total_limit).alias("global_limit"), F.lit(domain_limit).cast("int").alias("per_domain_limit"), zero("active").alias("active_total"), zero("waiting").alias("waiting_global"))


def upsert(rows: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """One row for each key: the place of its first row, the payload of its last."""
    at = F.struct(*order)
    out = rows.groupBy(key).agg(F.min(at).alias("first"), F.max_by(F.struct(*payload), at).alias("last"))
    return out.select(key, *[F.col(f"first.{x}").alias(f"first_{x}") for x in order], "last.*")
