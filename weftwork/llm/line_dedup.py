"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` is a log-structured index of line keys.  Each batch of documents
is counted, merge-anti-joined with the keys already settled (found in enough
documents) and written as one sorted run, bucketed by key.  When a level has
``fanout`` runs they are merged into one run of the next level, and keys that
have reached ``min_docs`` move to the settled runs, which are levelled and merged
in the same way.  All runs are bucketed and sorted alike, so the joins between
them need no exchange of the runs.  Buckets and batches follow the number of keys.

Null and empty texts have one empty line, whose empty key is never dropped.  A
row of the input is a document, even where a doc_id repeats; rows that agree in
doc_id and text have the same result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftwork.llm.common import columns_of, free_names, fresh_path, join_counts, saved, text_key
from weftwork.llm.text import SPACES, encoded, lean

KEY = ["__k1", "__k2"]
_SEED2 = xxhash.xxh64_intdigest(struct.pack("<q", 7), 42)


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACES).lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits of a line key as two signed longs."""
    one, two = xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key, _SEED2)
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


def _document_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and distinct line key of at least one character."""
    for batch in batches:
        ids, marks = batch.column("doc_id"), batch.column("__h")
        rows, ones, twos = [], [], []
        for i, text in enumerate(encoded(batch.column("text"))):
            for one, two in {key_hash(k) for line in text.split(b"\n") if (k := line_key(line))}:
                rows.append(i)
                ones.append(one)
                twos.append(two)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([ids.take(at), marks.take(at), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], ["doc_id", "__h", *KEY])


#: Keys of a batch in one bucket, about, and the bounds of a run's number of buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 2_000_000, 16, 50_000


def layout(keys: int, least_batches: int = 4) -> tuple[int, int]:
    """Batches and buckets for so many keys: buckets grow first, then batches."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-keys // (least_batches * BUCKET_ROWS))))
    return max(least_batches, -(-keys // (buckets * BUCKET_ROWS))), buckets


class LineRuns:
    """Levelled sorted runs of (line key, number of documents) in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int = LEAST_BUCKETS):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[list[DataFrame]] = [[]]
        self.tables: list[str] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        """Write one run, hash-bucketed and sorted by key."""
        name = f"linerun_{uuid.uuid4().hex}"
        writer = rows.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY).write
        writer.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", fresh_path(self.spark, name)).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"))

    def _settle(self, run: DataFrame, level: int = 0) -> None:
        """Add a settled run; ``fanout`` settled runs of a level become one of the next."""
        if level == len(self.settled):
            self.settled.append([])
        self.settled[level].append(run)
        if len(self.settled[level]) >= self.fanout:
            runs, self.settled[level] = self.settled[level], []
            self._settle(self._run(self._merged(runs)), level + 1)

    def add(self, keys: DataFrame) -> None:
        """Add a batch: one row for each document and distinct key."""
        fresh = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"))
        for run in [run for level in self.settled for run in level]:
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._run(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._run(self._merged(self.levels[level]))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level] = []
            self._settle(self._run(merged.where(F.col("n_docs") >= self.min_docs)))
            self.levels[level + 1].append(merged.where(F.col("n_docs") < self.min_docs))
            level += 1

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches, saved.

        ``n_docs`` of a settled key is what it was when the key settled.
        """
        rest = [run for level in self.levels for run in level]
        runs = [run for level in self.settled for run in level]
        if rest:
            runs.append(self._merged(rest).where(F.col("n_docs") >= self.min_docs))
        return saved(self._merged(runs).select(*KEY, "n_docs"), "common-lines")

    def close(self) -> None:
        """Take the runs out of the catalog."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last two columns are the text and its drops: the others, then what is kept."""
    for batch in batches:
        kept, lines, dropped = [], [], []
        *rest, text_column, drop_column = batch.columns
        for text, drop in zip(encoded(text_column), drop_column.to_pylist()):
            own = text.split(b"\n")
            left = own
            if drop:
                gone = set(drop)
                left = [x for x in own if not (k := line_key(x)) or key_hash(k)[0] not in gone]
            kept.append(b"\n".join(left))
            lines.append(len(own))
            dropped.append(len(own) - len(left))
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            [*batch.schema.names[:-2], "__kept", "__lines", "__dropped"],
        )


def drop_common_lines(docs: DataFrame, min_docs: int = 10, batches: int | None = None, fanout: int = 2) -> DataFrame:
    """``docs`` with ``__kept`` (text without common lines), ``__lines`` and ``__dropped``.

    ``docs`` needs doc_id and text; the column text is replaced by the three, and
    so are columns of their names.  Every other column is kept, whatever its
    name.  An empty table gives an empty result.  The 128 bits of a key decide
    what is common; within a document the first 64 tell its lines apart.
    """
    spark = docs.sparkSession
    keys = saved(docs.select("doc_id", text_key(F.col("text")).alias("__h"), "text").mapInArrow(lean(_document_keys), "doc_id long, __h long, __k1 long, __k2 long"), "line-keys")
    n = keys.count()
    planned, buckets = layout(n)
    batches = batches or planned
    runs = LineRuns(spark, min_docs, fanout, buckets)
    for i in range(batches):
        runs.add(keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    frequent = runs.frequent()
    runs.close()
    found = join_counts(keys, frequent, KEY, "n_docs", n, "left_semi")
    rest = [x for x in docs.columns if x not in ("text", "__kept", "__lines", "__dropped")]
    h, g, d, drops = free_names(docs.columns, "__h", "__g", "__d", "__drops")
    small = found.groupBy(F.col("doc_id").alias(d), F.col("__h").alias(g)).agg(F.collect_set("__k1").alias(drops))
    keyed = docs.withColumn(h, text_key(F.col("text")))
    met = keyed.join(small.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(small[d]) & (keyed[h] == small[g]), "left")
    met = met.select(*columns_of(met, rest), "text", drops)
    fields = [*[x for x in met.schema.fields if x.name in rest], StructField("__kept", StringType()), StructField("__lines", LongType()), StructField("__dropped", LongType())]
    return met.mapInArrow(lean(_rewritten), StructType(fields))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: lines, dropped lines and the SHA-256 of the kept text."""
    out = drop_common_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


