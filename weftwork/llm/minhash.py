"""MinHash near-dedup with sequential Bayesian verification.

Each distinct set of shingles (a class) has a signature of minima under many hash
functions, in bands of ROWS; classes that agree in a band are candidates.  The
number of bands follows from the chosen miss probability at the threshold.

Candidates are not expanded into pairs: each class of a band's bucket meets two
pivots of its bucket, links are merged into components, and what stays open is
compared in blocks, as in the n-gram Jaccard join, whose frame this shares.  A
pair's signatures are compared batch by batch.  After each batch the posterior
of the pair's similarity, under a uniform prior, is a beta distribution; a pair
is given up once its chance to reach the threshold is below the chosen miss
probability.  The survivors are confirmed on their whole sets.

So every link returned is exact, and a pair just at the threshold is missed with
a chance of about MISS for the bands and as much for each batch, unless other
links join its documents.

Null or wordless texts have an empty set and are linked with nothing.  Rows that
agree in all columns are copies; a null doc_id is never the smallest of a
component unless all are null.  Columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import Bits, kept, near, saved, text_key
from weftwork.llm.jaccard_join import JaccardJoin, _each_set, _spanning
from weftwork.llm.text import digest, lean, mix

#: Minima of a band, the miss probability chosen, and minima compared before a pair is judged again.
ROWS, MISS, STEP = 6, 1e-6, 18
#: Hashes of a set that are taken at once.
SLICE = 256


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a pair at the threshold without a common band with a chance of ``miss`` at most."""
    return ceil(log(miss) / log1p(-(threshold**rows)))


def _binomial_tail(most: int, n: int, p: float) -> float:
    """The chance of at most ``most`` successes of ``n``, each with a chance of ``p`` below 1."""
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(most + 1)]
    return float(np.exp(np.array(terms)).sum())


def least_matches(threshold: float, length: int, step: int = STEP, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, matches): a pair with fewer matches among the first ``compared`` minima is given up.

    With m matches of n under a uniform prior the similarity is beta distributed
    (m + 1, n - m + 1); it exceeds t as often as n + 1 trials at t succeed at most
    m times.
    """
    out = []
    for n in [*range(step, length, step), length]:
        m = 0
        while m <= n and _binomial_tail(m, n + 1, threshold) < miss:
            m += 1
        out.append((n, m))
    return out


def _multipliers(length: int) -> np.ndarray:
    return mix(np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def signature(tokens: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minima of a set of mixed 64-bit hashes under each function, as 32 bits."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max)
    for low in range(0, len(tokens), SLICE):
        out = np.minimum(out, (tokens[low : low + SLICE, None] * multipliers).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _survey(k: int, length: int):
    """Rows of documents: doc_id, text key, class, size, and the signature of each class that is new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        by = _multipliers(length)
        for batch in batches:
            classes, sizes, made = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i, tokens in _each_set(batch, k):
                classes[i], sizes[i] = c, n = digest(tokens), len(tokens)
                if n and c not in met:
                    met.add(c)
                    made[i] = signature(mix(tokens), by).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(classes), pa.array(sizes), pa.array(made, pa.binary())], ["doc_id", "h", "c", "n", "sig"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint32)


def _band_rows(rows: int):
    """Rows (t, c): the hash of each band of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                minima = _signatures(part.column("sig")).astype(np.uint64)
                bands = minima.shape[1] // rows
                keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(minima), 1))
                for i in range(rows):
                    keys = mix(keys + minima[:, i::rows][:, :bands])
                classes = np.repeat(part.column("c").to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(classes)], ["t", "c"])

    return run


def _in_buckets(known):
    """The rows whose band hash the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.has(batch.column("t").to_numpy().view(np.uint64))))

    return run


def survivors(one: np.ndarray, two: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """The places of the pairs of signatures (rows of both) that no batch gives up."""
    alive, matches, low = np.arange(len(one)), np.zeros(len(one), np.int64), 0
    for high, wanted in least:
        matches = matches + (one[alive, low:high] == two[alive, low:high]).sum(axis=1)
        stay = matches >= wanted
        alive, matches, low = alive[stay], matches[stay], high
    return alive


def _sequential(least: list[tuple[int, int]]):
    """Rows (a, b, n1, n2) of the pairs that survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(survivors(_signatures(batch.column("s1")), _signatures(batch.column("s2")), least))
            yield batch.select(["a", "b", "n1", "n2"]).take(at)

    return run


class MinHashJoin(JaccardJoin):
    """Links and components of a table of texts; see the module's text."""

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 85, den: int = 100, rows: int = ROWS, miss: float = MISS):
        self.spark: SparkSession = docs.sparkSession
        self.k, self.num, self.den, self.per_band = k, num, den, rows
        length = rows * bands_for(num / den, rows, miss)
        self.least = least_matches(num / den, length, STEP, miss)
        self.docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("h"))
        self.survey = saved(self.docs.mapInArrow(lean(_survey(k, length)), "doc_id long, h long, c long, n long, sig binary"), "survey")
        self.rows = self.survey.drop("sig")
        self.links = self._linked()

    def _lists(self) -> DataFrame:
        signed = self.survey.where("sig is not null").select("c", "sig")
        postings = saved(signed.mapInArrow(lean(_band_rows(self.per_band)), "t long, c long"), "postings")
        buckets = postings.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        buckets = saved(buckets.where("lo < hi").select("t"), "buckets")
        known = self.spark.sparkContext.broadcast(Bits(buckets, "t"))
        # few rows pass the bitmap; the join drops those that pass by chance, and Spark splits a bucket that is too large for a task
        return postings.mapInArrow(_in_buckets(known), "t long, c long").join(buckets.hint("shuffle_merge"), "t").select("t", "c")

    def _filters(self) -> DataFrame:
        signed = self.survey.where("sig is not null").join(near(self.chosen.select("c")), "c", "left_semi")
        return signed.groupBy("c").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))

    def _passed(self, pairs: DataFrame) -> DataFrame:
        x = self.filters.select(F.col("c").alias("a"), F.col("n").alias("n1"), F.col("sig").alias("s1"))
        y = self.filters.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("s2"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "n1", "n2", "s1", "s2")
        return both.mapInArrow(lean(_sequential(self.least)), "a long, b long, n1 long, n2 long")

    def _block_sets(self, classes: DataFrame) -> DataFrame:
        return self._sets(classes).join(self.filters.select("c", "sig"), "c")

    def _comparison(self):
        num, den, least = self.num, self.den, self.least

        def compared(table: pa.Table) -> pa.Table:
            minima = _signatures(table["sig"].combine_chunks())

            def may(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                out = np.zeros((len(left), len(right)), bool)
                for i, x in enumerate(left):
                    out[i, survivors(np.broadcast_to(minima[x], (len(right), minima.shape[1])), minima[right], least)] = True
                return out

            return _spanning(table, num, den, may)

        return compared


def minhash_report(docs: DataFrame) -> DataFrame:
    """Per document: size of its shingle set, its component, and whether it stays."""
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    report = lambda: MinHashJoin(docs).result().select("doc_id", F.col("n").alias("n_shingles"), "component_id", stays.alias("kept"))
    return kept(docs.sparkSession, report, "report")
