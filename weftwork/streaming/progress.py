"""Live figures of a stream of page results, and the trailing rate of its requests."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

logger = logging.getLogger(__name__)

#: Name of the metrics that ``observed`` adds to a stream.
METRICS = "weft_progress"


def observed(results: DataFrame, host: Column | None = None) -> DataFrame:
    """``results`` (state, and what else it has) whose batches tell how many pages they scheduled, finished and in which state."""
    count = lambda *x: F.count_if(F.col("state").isin(*x))
    return results.observe(
        METRICS,
        F.count(F.lit(1)).alias("pages_scheduled"),
        count("processed", "failed", "blocked").alias("pages_completed"),
        count("processed").alias("pages_successful"),
        count("failed").alias("pages_failed"),
        count("blocked").alias("pages_blocked"),
        count("queued").alias("pages_queued"),
        count("active").alias("pages_active"),
    )


def snapshot(totals: Mapping[str, int], elapsed: float) -> dict[str, float]:
    """The figures of a run so far."""
    rate = totals.get("pages_completed", 0) / elapsed if elapsed > 0 else 0.0
    return {**totals, "elapsed_seconds": elapsed, "pages_per_second": rate}


def progress_line(stats: Mapping[str, float], requests: Mapping[str, object] | None = None, final: bool = False) -> str:
    """One line of a run's figures for a person, with those of its requests if given."""
    of = lambda name: stats.get(name, 0)
    share = 100.0 if final else 100.0 * of("pages_completed") / of("pages_scheduled") if of("pages_scheduled") > 0 else 0.0
    left, rate = of("pages_queued") + of("pages_active"), of("pages_per_second")
    eta = f"{left / rate:.1f} s" if not final and left > 0 and rate > 0 else "--"
    parts = [
        f"{'Total' if final else 'Progress'}: {of('pages_completed')}/{of('pages_scheduled')} pages", f"{share:.1f}%", f"successful {of('pages_successful')}", f"queued {of('pages_queued')}", f"active pages {of('pages_active')}",
        f"active requests {of('active_requests')}", f"failed {of('pages_failed')}", f"blocked {of('pages_blocked')}", f"{rate:.2f} pages/s", f"ETA {eta}",
    ]
    if requests is not None:
        errors = requests.get("errors_by_type") or {}
        permanent = requests.get("permanent_error_urls")
        number = lambda name: requests.get(name, 0)
        parts += [
            f"requests {number('total_requests')} ({number('current_requests_per_second'):.2f}/s)", f"mean wait {number('average_rate_limit_wait'):.3f} s",
            f"retries {number('scheduled_retries')} (successful {number('successful_retries')}, mean wait {number('average_retry_wait'):.3f} s)",
            f"errors {', '.join(f'{k}={v}' for k, v in sorted(errors.items(), key=lambda x: str(x[0]))) or 'none'}",
            f"permanent URLs {len(permanent) if isinstance(permanent, (list, tuple, set)) else 0}", f"blocked by robots {number('robots_blocked')}",
        ]
    return " | ".join(parts)


class Reporter(StreamingQueryListener):
    """Sums what ``observed`` tells of each batch and gives a line to ``output``, at most one in ``interval`` seconds and one at the end.

    An output that fails is logged; neither the query nor later lines are touched.
    Queued and active pages are those of the last batch, the others run totals.
    """

    def __init__(self, output: Callable[[str], object] = print, interval: float = 1.0, requests: Callable[[], Mapping[str, object]] | None = None, clock: Callable[[], float] = time.monotonic):
        if not callable(output) or (requests is not None and not callable(requests)):
            raise ValueError("output and requests must be callable")
        if isinstance(interval, bool) or not isinstance(interval, (int, float)) or interval < 0:
            raise ValueError("interval must be a number from 0")
        super().__init__()
        self.output, self.interval, self.requests, self.clock = output, interval, requests, clock
        self.totals: dict[str, int] = {}
        self.began, self.told = clock(), None
        self.failures = 0

    def current(self) -> dict[str, float]:
        return snapshot(self.totals, self.clock() - self.began)

    def tell(self, final: bool = False) -> None:
        try:
            self.output(progress_line(self.current(), None if self.requests is None else self.requests(), final))
        except Exception:  # a report must not stop the query
            self.failures += 1
            logger.exception("could not report progress")

    def take(self, metrics: Mapping[str, int]) -> None:
        for name, value in metrics.items():
            now = name in ("pages_queued", "pages_active")
            self.totals[name] = value if now else self.totals.get(name, 0) + value
        if self.told is None or self.clock() - self.told >= self.interval:
            self.told = self.clock()
            self.tell()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(METRICS)
        if row is not None:
            self.take(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(final=True)


class _Trailing(StatefulProcessor):
    """Holds the rows of one key and span; when the watermark has passed the span, tells its own rows with their counts."""

    def __init__(self, width: int):
        self.width = width  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "micros long, own boolean, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.rows.appendList(list(part[["micros", "own", "id"]].itertuples(index=False, name=None)))
        self.handle.registerTimer((key[1] + 1) * self.width // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(self.rows.get())
        self.rows.clear()
        micros = np.array([x[0] for x in held], np.int64)
        own = [i for i, x in enumerate(held) if x[1]]
        if own:
            at = micros[own]
            recent = np.searchsorted(micros, at, "right") - np.searchsorted(micros, at - self.width, "right")
            yield pd.DataFrame({"key": key[0], "id": [held[i][2] for i in own], "micros": at, "recent": recent})

    def close(self) -> None:
        pass


def trailing_rates(requests: DataFrame, key: str, time: str, ident: str, seconds: int = 1, delay: str = "10 seconds") -> DataFrame:
    """(key, id, micros, recent): each request with the number of its key's requests in the ``seconds`` up to it.

    Requests are dealt to spans of ``seconds``, each to its own and the next one, so
    a busy key is many groups.  A span is counted once the watermark has passed it,
    when no earlier request can come any more, so the counts do not depend on the
    batches; requests that come more than ``delay`` behind the latest one are
    dropped as late.  State holds the rows of the spans that are still open.
    """
    width = seconds * 1_000_000
    timed = requests.where(F.col(time).isNotNull()).withWatermark(time, delay)
    micros = F.unix_micros(time)
    both = F.explode(F.array(F.struct(F.lit(0).alias("off"), F.lit(True).alias("own")), F.struct(F.lit(1).alias("off"), F.lit(False).alias("own"))))
    dealt = timed.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("string").alias("id"), F.col(time), micros.alias("micros"), both.alias("x"))
    dealt = dealt.select("key", (F.floor(F.col("micros") / width) + F.col("x.off")).alias("span"), "micros", F.col("x.own").alias("own"), "id", time)
    return dealt.groupBy("key", "span").transformWithStateInPandas(_Trailing(width), "key string, id string, micros long, recent long", "Append", "eventTime")
