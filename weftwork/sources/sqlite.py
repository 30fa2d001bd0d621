"""SQLite files as a data source: reads by ranges of ids, writes that are committed whole.

Tasks write staged files beside the database, each task its own; the commit puts
them into the database in one transaction, in the order of the rows, and an abort
leaves it as it was.  The file must be one that all executors see.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The columns of a record, flat: links and metadata are JSON, times ISO 8601.
FLAT = "url string, title string, text string, links string, metadata string, crawled_at string, status_code int, content_type string"
NAMES = [x.split()[0] for x in FLAT.split(", ")]
#: Rows that are fetched or put at once.
ROWS = 1000

_CREATE = f"CREATE TABLE IF NOT EXISTS records (id INTEGER PRIMARY KEY AUTOINCREMENT, url TEXT UNIQUE, {', '.join(NAMES[1:])})"
_INDEXES = ("CREATE INDEX IF NOT EXISTS by_status ON records (status_code)", "CREATE INDEX IF NOT EXISTS by_time ON records (crawled_at)")
_UPDATES = ", ".join(f"{c} = excluded.{c}" for c in NAMES[1:])


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class IdRange(InputPartition):
    low: int
    high: int


@dataclass
class Staged(WriterCommitMessage):
    partition: int
    path: str


class SqliteReader(DataSourceReader):
    """One task for each range of ids; no task holds more than ROWS rows."""

    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path, tasks

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[IdRange]:
        db = self._open()
        low, high = db.execute("SELECT min(id), max(id) FROM records").fetchone()
        db.close()
        if low is None:
            return [IdRange(0, 0)]
        step = -(-(high - low + 1) // self.tasks)
        return [IdRange(x, min(x + step, high + 1)) for x in range(low, high + 1, step)]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        db = self._open()
        cursor = db.execute(f"SELECT id, {', '.join(NAMES)} FROM records WHERE id >= ? AND id < ? ORDER BY id", (partition.low, partition.high))
        while rows := cursor.fetchmany(ROWS):
            columns = list(zip(*rows))
            kinds = [pa.int64(), *(pa.int32() if x == "status_code" else pa.string() for x in NAMES)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["id", *NAMES])
        db.close()


class SqliteWriter(DataSourceArrowWriter):
    """Stages each task's rows in a file of its own; the commit puts them all into the database."""

    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch
        self.staging = f"{path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        os.makedirs(self.staging, exist_ok=True)
        task = TaskContext.get().partitionId()
        staged = f"{self.staging}/{task}-{uuid.uuid4().hex}.db"
        db = sqlite3.connect(staged)
        db.execute(f"CREATE TABLE records (n INTEGER PRIMARY KEY, {', '.join(NAMES)})")
        for batch in iterator:
            for low in range(0, batch.num_rows, self.batch):
                part = batch.slice(low, self.batch)
                with db:
                    db.executemany(f"INSERT INTO records ({', '.join(NAMES)}) VALUES ({', '.join('?' * len(NAMES))})", zip(*(part.column(x).to_pylist() for x in NAMES)))
        db.close()
        return Staged(task, staged)

    def commit(self, messages: list[Staged | None]) -> None:
        db = sqlite3.connect(self.path, isolation_level=None)
        try:
            db.execute("PRAGMA busy_timeout = 60000")
            db.execute("BEGIN IMMEDIATE")  # one transaction over all staged files, which are read one row at a time
            db.execute(_CREATE)
            for statement in _INDEXES:
                db.execute(statement)
            for message in sorted((x for x in messages if x is not None), key=lambda x: x.partition):
                staged = sqlite3.connect(f"file:{message.path}?mode=ro", uri=True)
                rows = staged.execute(f"SELECT {', '.join(NAMES)} FROM records ORDER BY n")
                db.executemany(f"INSERT INTO records ({', '.join(NAMES)}) VALUES ({', '.join('?' * len(NAMES))}) ON CONFLICT (url) DO UPDATE SET {_UPDATES}", rows)
                staged.close()
            db.execute("COMMIT")
        except BaseException:
            if db.in_transaction:
                db.execute("ROLLBACK")
            raise
        finally:
            db.close()
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class SqliteSource(DataSource):
    """Format ``weft_sqlite``: options path, tasks (of a read) and batch (rows of a transaction of a staged file)."""

    @classmethod
    def name(cls) -> str:
        return "weft_sqlite"

    def schema(self) -> str:
        return f"id long, {FLAT}"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(_local(self.options["path"]), int(self.options.get("tasks", "8")))

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        if overwrite:
            raise ValueError("records are upserted; use mode append")
        return SqliteWriter(_local(self.options["path"]), int(self.options.get("batch", "100")))


def shared_path(spark: SparkSession, path: str, shared: bool) -> str:
    """``path`` if all executors see it: in local mode, below the shared folder, or by the caller's word."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    below = folder and os.path.realpath(_local(path)).startswith(os.path.realpath(_local(folder)) + os.sep)
    if shared or below or spark.sparkContext.master.split("[")[0] == "local":
        return os.path.realpath(_local(path))
    raise ValueError(f"{path} is not in the folder that executors share; say shared=True if they all see it")


def last_of_each(flat: DataFrame, order: list[str | Column]) -> DataFrame:
    """One row for each url, with the values of its last row, sorted by the place of its first."""
    place = F.struct(*order)
    out = flat.select("url", place.alias("_place"), F.struct(*NAMES[1:]).alias("_row")).groupBy("url")
    out = out.agg(F.min("_place").alias("_first"), F.max_by("_row", "_place").alias("_row"))
    return out.orderBy("_first").select("url", "_row.*")
