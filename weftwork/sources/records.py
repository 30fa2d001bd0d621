"""Crawl records in JSON Lines, CSV, a JSON array and SQLite, and whether they agree."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.sources import sqlite

RECORD = "url string, title string, text string, links array<string>, metadata map<string,string>, crawled_at timestamp, status_code int, content_type string"
COLUMNS = ["url", "title", "text", "links", "metadata", "crawled_at", "status_code", "content_type"]


class RecordError(ValueError):
    """Some records are not valid."""


def is_valid_record():
    """Not-blank url and content type, no blank link, a time, and a status of 200 to 399."""
    ok = (F.trim("url") != "") & (F.trim("content_type") != "") & F.col("crawled_at").isNotNull() & F.col("status_code").between(200, 399)
    ok = ok & F.col("title").isNotNull() & F.col("text").isNotNull() & F.forall("links", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))) & F.forall(F.map_values("metadata"), lambda x: x.isNotNull())
    return F.coalesce(ok, F.lit(False))


def normalized(records: DataFrame, *more: str) -> DataFrame:
    """Valid records with trimmed url and lower-case content type; RecordError before anything is written."""
    bad = records.where(~is_valid_record())
    if not bad.isEmpty():
        raise RecordError("the batch has records that are not valid")
    return records.select(F.trim("url").alias("url"), "title", "text", "links", "metadata", "crawled_at", "status_code", F.lower(F.trim("content_type")).alias("content_type"), *more)


def from_pages(fetched: DataFrame, parsed: DataFrame, key: str = "url") -> DataFrame:
    """Records of successful fetches whose page was parsed without error; ``key`` names a page in both, for tables with several of one url.

    The join is by sorting: sizes of parsed pages are estimated far too low for a choice.
    """
    own = parsed.where("error is null").drop(*({"url"} - {key}))
    return of_pages(fetched.where("outcome = 'success'").join(own.hint("merge"), key))


def of_pages(pages: DataFrame) -> DataFrame:
    """Records of pages, each a row of its fetch and of what was parsed: those that were fetched with success and parsed without error."""
    ok = pages.where("outcome = 'success' and error is null")
    meta = F.create_map(*[y for x in ("title", "description", "keywords") for y in (F.lit(x), F.col(f"metadata.{x}"))])
    return ok.select("url", "title", "text", "links", meta.alias("metadata"), "crawled_at", "status_code", F.coalesce(F.nullif(F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))), F.lit("")), F.lit("application/octet-stream")).alias("content_type"))


def _iso(column: str):
    """ISO 8601 with +00:00, microseconds only where there are any."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(column, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def _flat(records: DataFrame, *more: str) -> DataFrame:
    return records.select("url", "title", "text", F.to_json("links").alias("links"), F.to_json("metadata").alias("metadata"), _iso("crawled_at").alias("crawled_at"), "status_code", "content_type", *more)


def _nested(rows: DataFrame, *more: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("url", text("title").alias("title"), text("text").alias("text"), F.from_json("links", "array<string>").alias("links"), F.from_json("metadata", "map<string,string>").alias("metadata"), F.to_timestamp("crawled_at").alias("crawled_at"), F.col("status_code").cast("int").alias("status_code"), "content_type", *more)


class JsonLines:
    """Append-only JSON Lines."""

    def __init__(self, path: str):
        self.path = path

    def save(self, records: DataFrame) -> None:
        self._lines(records).write.mode("append").option("ignoreNullFields", "false").json(self.path)

    def save_once(self, records: DataFrame, key: str) -> None:
        """Save under a key; what was saved under it before is replaced."""
        self._lines(records).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.path}/key={key}")

    @staticmethod
    def _lines(records: DataFrame) -> DataFrame:
        return normalized(records).withColumn("crawled_at", _iso("crawled_at"))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(RECORD).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(self.path)

    def bad_lines(self, spark: SparkSession) -> DataFrame:
        """(file, line, reason): the lines that are no JSON objects, numbered from 1 in their files.

        A file may be read in many splits.  Each task numbers its lines without
        gaps, so a line's place in its split is its number less the split's first,
        and the lines before the split are a running sum over the splits of the
        file, of which there is one row each.  No line is shuffled but the bad ones.
        """
        lines = spark.read.option("recursiveFileLookup", True).text(self.path)
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
        splits = lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        value = F.try_parse_json("value")
        reason = F.when(value.isNull(), "not JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
        bad = lines.withColumn("reason", reason).where("reason is not null").drop("value")
        return bad.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "reason")

    def checked(self, spark: SparkSession) -> DataFrame:
        """The records, or RecordError with the first line that is no object."""
        bad = self.bad_lines(spark).orderBy("file", "line").first()
        if bad is not None:
            raise RecordError(f"{bad['file']}, line {bad['line']}: {bad['reason']}")
        return self.read(spark)

    def export_pretty(self, spark: SparkSession, target: str, indent: int = 2) -> int:
        """One JSON array in a driver file, row by row; for outputs a person reads."""
        if Path(target).absolute() == Path(self.path).absolute():
            raise ValueError("the target must differ from the source")
        if isinstance(indent, bool) or not isinstance(indent, int) or indent < 1:
            raise ValueError("indent must be a positive integer")
        n = 0
        with open(target, "w", encoding="utf-8") as file:
            for row in self.read(spark).withColumn("crawled_at", _iso("crawled_at")).toLocalIterator():
                file.write(("[\n" if not n else ",\n") + json.dumps(row.asDict(True), ensure_ascii=False, indent=indent))
                n += 1
            file.write("\n]\n" if n else "[]\n")
        return n


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that is one JSON array of objects, as ``export_pretty`` writes it; other content fails when read."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def pending(saved: int, batch: int) -> int:
    """Rows of ``saved`` ones that a sink with such batches has not yet committed."""
    return saved % batch


class Csv:
    """Append-only CSV with a header in each file; links and metadata are JSON."""

    def __init__(self, path: str, encoding: str = "utf-8"):
        self.path, self.encoding = path, encoding

    def save(self, records: DataFrame) -> None:
        self._writer(records).mode("append").csv(self.path)

    def save_once(self, records: DataFrame, key: str) -> None:
        """Save under a key; what was saved under it before is replaced."""
        self._writer(records).mode("overwrite").csv(f"{self.path}/key={key}")

    def _writer(self, records: DataFrame):
        return _flat(normalized(records)).write.option("header", True).option("escape", '"').option("encoding", self.encoding)

    def read(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.option("recursiveFileLookup", True).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", self.encoding).option("enforceSchema", False).schema(", ".join(f"{c} string" for c in COLUMNS)).csv(self.path)
        return _nested(rows)


class Sqlite:
    """A SQLite file with one row for each url: later records replace earlier ones, ids stay.

    Later is by ``order``, columns of the records, or the place in the input.  One
    transaction writes all or nothing, so a save that is tried again does no harm.
    The file must be below the shared folder, unless ``shared`` says that all
    executors see it or the session is local; it suits outputs that one file holds.
    """

    def __init__(self, path: str, batch: int = 100, order: Sequence[str] = (), shared: bool = False):
        if isinstance(batch, bool) or not isinstance(batch, int) or batch < 1:
            raise ValueError("batch must be a positive integer")
        self.path, self.batch, self.order, self.shared = path, batch, list(order), shared

    def _format(self, spark: SparkSession):
        spark.dataSource.register(sqlite.SqliteSource)
        return sqlite.shared_path(spark, self.path, self.shared)

    def save(self, records: DataFrame) -> None:
        path = self._format(records.sparkSession)
        order = self.order or [F.monotonically_increasing_id()]
        held = records.select("*", F.struct(*order).alias("_place"))
        flat = _flat(normalized(held, "_place"), "_place")
        sqlite.last_of_each(flat, ["_place"]).write.format("weft_sqlite").option("path", path).option("batch", self.batch).mode("append").save()

    def read(self, spark: SparkSession, ids: bool = False) -> DataFrame:
        """The records, in as many tasks as there are ranges of ids; with ``ids`` also the column id, which tells their order."""
        path = self._format(spark)
        return _nested(spark.read.format("weft_sqlite").option("path", path).load(), *(["id"] if ids else []))


class SinkFailure(RuntimeError):
    """Some sinks of a composite failed."""

    def __init__(self, operation: str, failed: list[str]):
        super().__init__(f"{operation} failed for: {', '.join(failed)}")
        self.operation, self.failed = operation, failed


class Composite:
    """Writes the same records to all sinks; names those that fail after all have been tried."""

    def __init__(self, sinks: Sequence):
        if not sinks or len({id(x) for x in sinks}) != len(sinks):
            raise ValueError("a composite needs sinks, each once")
        self.sinks = list(sinks)
        seen: dict[str, int] = {}
        self.names = []
        for sink in sinks:
            name = type(sink).__name__
            seen[name] = seen.get(name, 0) + 1
            self.names.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
        self.stats = {name: {"saved": 0, "failed": 0} for name in self.names}

    def save(self, records: DataFrame) -> None:
        records = records.persist()
        failed = []
        try:
            n = records.count()
            for name, sink in zip(self.names, self.sinks):
                try:
                    sink.save(records)
                    self.stats[name]["saved"] += n
                except RecordError:
                    raise
                except Exception:  # whatever a sink raises counts for that sink alone
                    self.stats[name]["failed"] += n
                    failed.append(name)
        finally:
            records.unpersist()
        if failed:
            raise SinkFailure("save", failed)


def build_sinks(settings: Sequence[dict]):
    """None, one sink, or a composite, in the order of ``settings`` ({"type": .., "path": ..})."""
    kinds: dict[str, Callable] = {"json": JsonLines, "csv": Csv, "sqlite": Sqlite}
    sinks = [kinds[x["type"]](**{k: v for k, v in x.items() if k != "type"}) for x in settings]
    return None if not sinks else sinks[0] if len(sinks) == 1 else Composite(sinks)


def disagreements(first: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two sets of records has, with the side they are on."""
    comparable = lambda x: x.select(*[F.to_json(c).alias(c) if c in ("links", "metadata") else F.col(c) for c in COLUMNS])
    a, b = comparable(first), comparable(other)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("other")))
