"""Saves that are tried again and report failure instead of raising it.

A batch goes to each sink by itself.  A ledger in the shared folder names the
batches that a sink has, so a batch that comes again, after a failure or a restart,
goes only to sinks that do not have it.  Sinks with ``save_once`` replace what an
attempt left behind, so each of their rows is there once, also where a job ends
between a sink's commit and the ledger's.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

_LEDGER = "batch string, sink string, records long"


@dataclass
class Tries:
    """How often a save is tried again, for which errors, and the seconds before each further try."""

    retries: int = 3
    retry_on: tuple[type[BaseException], ...] = (OSError, PySparkException)
    base: float = 0.1
    factor: float = 2.0
    most: float = 5.0
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        if isinstance(self.retries, bool) or not isinstance(self.retries, int) or self.retries < 0:
            raise ValueError("retries must be a whole number from 0")
        if not 0 <= self.base <= self.most or self.factor < 1:
            raise ValueError("base must be within most, and factor at least 1")

    def wait(self, retry: int) -> float:
        return min(self.base * self.factor**retry, self.most)


@dataclass
class Counts:
    """Lifetime counters of a sink, in records; retried counts further tries."""

    saved_records: int = 0
    failed_saves: int = 0
    retried_saves: int = 0
    held: int = field(default=0, repr=False)  # records that the ledger had already

    def as_dict(self) -> dict[str, int]:
        return {"saved_records": self.saved_records, "failed_saves": self.failed_saves, "retried_saves": self.retried_saves}


class Delivery:
    """Delivers batches of records to named sinks."""

    def __init__(self, sinks: Mapping[str, object], ledger: str, tries: Tries | None = None):
        if not sinks or any(not callable(getattr(x, "save", None)) for x in sinks.values()):
            raise ValueError("a delivery needs sinks that save")
        self.sinks, self.ledger, self.tries = dict(sinks), ledger, tries or Tries()
        self.counts = {name: Counts() for name in self.sinks}

    def committed(self, spark: SparkSession) -> DataFrame:
        """(batch, sink, records) of what the ledger holds."""
        kept = spark.createDataFrame([], _LEDGER)
        path = spark._jvm.org.apache.hadoop.fs.Path(self.ledger)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            kept = spark.read.schema(_LEDGER).json(self.ledger)
        return kept

    def save(self, batch: DataFrame, key: str | int) -> bool:
        """Whether every sink has the batch at the end.

        What a sink raises counts for that sink alone, unless it ends the program
        (an interrupt, a lost session).  A batch that is not valid fails for all.
        """
        spark, key = batch.sparkSession, str(key)
        batch = batch.persist()
        try:
            n = batch.count()
            held = {r["sink"]: r["records"] for r in self.committed(spark).where(F.col("batch") == key).collect()}  # one row a sink
            done = True
            for name, sink in self.sinks.items():
                if name in held:
                    self.counts[name].held += held[name]
                elif self._saved(name, sink, batch, key):
                    spark.createDataFrame([(key, name, n)], _LEDGER).coalesce(1).write.mode("append").json(self.ledger)
                    self.counts[name].saved_records += n
                else:
                    self.counts[name].failed_saves += n
                    done = False
            return done
        finally:
            batch.unpersist()

    def _saved(self, name: str, sink, batch: DataFrame, key: str) -> bool:
        for n in range(self.tries.retries + 1):
            try:
                if hasattr(sink, "save_once"):
                    sink.save_once(batch, key)
                else:
                    sink.save(batch)
                return True
            except Exception as error:  # whatever a sink raises must not stop the others
                if n == self.tries.retries or not isinstance(error, self.tries.retry_on):
                    logger.error("batch %s was not saved to %s: %s: %s", key, name, type(error).__name__, error)
                    return False
                self.counts[name].retried_saves += 1
                self.tries.sleep(self.tries.wait(n))
        return False

    def stats(self) -> dict[str, dict[str, int]]:
        """The counters of each sink, detached."""
        return {name: counts.as_dict() for name, counts in self.counts.items()}

    def totals(self) -> dict[str, int]:
        """The counters of all sinks together."""
        out: dict[str, int] = {}
        for counts in self.stats().values():
            for name, value in counts.items():
                out[name] = out.get(name, 0) + value
        return out

    def close(self) -> bool:
        """Whether all sinks that can be closed were closed without an error; all are tried."""
        done = True
        for name, sink in self.sinks.items():
            try:
                getattr(sink, "close", lambda: None)()
            except Exception as error:
                logger.error("%s was not closed: %s: %s", name, type(error).__name__, error)
                done = False
        return done


def delivery_of(sinks: Sequence, ledger: str, tries: Tries | None = None) -> Delivery:
    """A delivery to sinks named by their kind, with numbers where a kind comes again."""
    named: dict[str, object] = {}
    seen: dict[str, int] = {}
    for sink in sinks:
        kind = type(sink).__name__
        seen[kind] = seen.get(kind, 0) + 1
        named[kind if seen[kind] == 1 else f"{kind}#{seen[kind]}"] = sink
    return Delivery(named, ledger, tries)
