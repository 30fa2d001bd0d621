"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Containment |Q & X| / |Q| of a short item Q in a long document X is not seen by
MinHash, since their Jaccard similarity is tiny.  So documents are cut into
overlapping segments, in partitions by size: partition k has segments of
2**(k+1) shingles, one every 2**k, and takes the items of 2**k/2 to 2**k
shingles.  A passage of an item's length lies whole in a segment, of which it is
a quarter or more, so item and segment share one of MINIMA minima with a
probability of over 0.9999 at containment 1, and over 0.9995 at the threshold.
An item and a document that share a minimum in any segment are a candidate, and
the exact containment of the item's distinct shingles in the whole document
decides.

The items' minima are a table, never a driver's index.  Its keys set the bits of
a bitmap of at most 2**MOST_BITS bits, which is broadcast, so one scan of the
documents finds the segments that may share a minimum, however many items there
are; these meet the table in a join.  Candidates meet their texts and the items'
sets document by document, where containment is counted.

Shingles are 5 words, A-Z in lower case; a text of fewer words has one shingle,
the whole sequence, so it is contained only in texts of the same words.  Null or
wordless texts contain nothing and are contained in nothing.  Rows of the
benchmark are items and rows of documents are documents, repeated or not; items
of equal sets are searched as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import columns_of, free_names, join_counts, near, saved, text_key
from weftwork.llm.text import chunks, digest, encoded, lean, mix, shingles, word_hashes

#: Words in a shingle, and the least containment in hundredths.
WORDS, PERCENT = 5, 80
#: Minima a segment is known by.
MINIMA = 40
#: The bitmap has about so many bits for each minimum of an item, and at most 2**MOST_BITS.
BITS_EACH, MOST_BITS = 256, 28
#: Bits of one piece of the bitmap: those of Spark's bitmap functions.
PIECE = 32_768

_FACTORS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ITEM = "item_id long, c long, tokens array<long>, k int, keys array<long>, slots array<int>"


def _hashes(tokens: np.ndarray, m: int) -> np.ndarray:
    """The m-th hash of shingles, 32 bits."""
    x = (tokens >> np.uint64(32)).astype(np.uint32) * _FACTORS[m]
    return x ^ (tokens.astype(np.uint32) * _FACTORS[-1 - m] >> np.uint32(7))


def _keys(least: np.ndarray, k: int, m: int) -> np.ndarray:
    """Keys of m-th minima in partition k."""
    return least.astype(np.uint64) | np.uint64((k * MINIMA + m) << 32)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys in a bitmap of 2**bits bits."""
    return ((keys * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items that have words: class, shingles, partition and minima."""
    for batch in batches:
        texts, rows, out = [x.lower() for x in encoded(batch.column("text"))], [], []
        for start, end in chunks(texts):
            words, bounds = word_hashes(texts[start:end])
            runs, to = shingles(words, bounds, WORDS)
            for i in range(end - start):
                tokens = np.unique(runs[to[i] : to[i + 1]])
                if len(tokens):
                    k = max(1, int(len(tokens) - 1).bit_length())
                    keys = np.array([_keys(_hashes(tokens, m).min(), k, m) for m in range(MINIMA)], np.uint64)
                    rows.append(start + i)
                    out.append((digest(tokens), tokens.view(np.int64), k, keys.view(np.int64), _slots(keys, MOST_BITS)))
        lists = pa.list_(pa.int64())
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), lists, pa.int32(), lists, pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows, pa.int64())), *columns], ["item_id", "c", "tokens", "k", "keys", "slots"])


def _pieces_of(minima: DataFrame, bits: int) -> DataFrame:
    """The bitmap in pieces (piece, bytes), made by an aggregate."""
    rows = minima.select(F.shiftright("slot", MOST_BITS - bits).alias("slot"))
    return rows.groupBy(F.floor(F.col("slot") / PIECE).cast("long").alias("piece")).agg(F.bitmap_construct_agg((F.col("slot") % PIECE).cast("long")).alias("bytes"))


class Segments:
    """Finds the keys of documents' segments whose bits are set."""

    def __init__(self, bitmap: np.ndarray, bits: int, partitions: list[int]):
        self.bitmap, self.bits, self.partitions = bitmap, bits, partitions

    def found(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, keys) of segments; the documents' shingles lie between ``bounds``.

        All documents are cut at once: each is padded to whole half-segments.
        """
        documents, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        if not self.partitions or not len(tokens):
            return documents[0], keys[0]
        unit = 1 << self.partitions[0]
        counts = np.diff(bounds)
        units = -(-counts // unit)
        starts = np.concatenate([[0], np.cumsum(units)])
        owner = np.repeat(np.arange(len(counts)), units)
        place = np.arange(len(tokens)) + np.repeat(starts[:-1] * unit - bounds[:-1], counts)
        for m in range(MINIMA):
            padded = np.full(starts[-1] * unit, 0xFFFFFFFF, np.uint32)
            padded[place] = _hashes(tokens, m)
            least = padded.reshape(-1, unit).min(axis=1)
            of = owner
            for k in range(self.partitions[0], self.partitions[-1] + 1):
                if k in self.partitions:
                    halves = least.copy()  # a segment is two neighbours of one document
                    halves[:-1] = np.where(of[:-1] == of[1:], np.minimum(least[:-1], least[1:]), least[:-1])
                    key = _keys(halves, k, m)
                    slot = _slots(key, self.bits)
                    at = np.flatnonzero(self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    documents.append(of[at])
                    keys.append(key[at])
                least, of = _joined(least, of)
        return np.concatenate(documents), np.concatenate(keys)


def _joined(least: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours of the same document become one; an odd one stays alone."""
    if not len(owner):
        return least, owner
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    inside = np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate([first, [len(owner)]])))
    heads = np.flatnonzero(inside % 2 == 0)
    return np.minimum.reduceat(least, heads), owner[heads]


def _hits(segments):
    """Rows (doc_id, h, key) of segments that may share a minimum with an item, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Segments = segments.value
        for batch in batches:
            texts = [x.lower() for x in encoded(batch.column("text"))]
            for start, end in chunks(texts):
                words, bounds = word_hashes(texts[start:end])
                documents, keys = s.found(*shingles(words, bounds, WORDS))
                order = np.lexsort((keys, documents))
                documents, keys = documents[order] + start, keys[order]
                fresh = np.ones(len(keys), bool)
                fresh[1:] = (documents[1:] != documents[:-1]) | (keys[1:] != keys[:-1])
                at = pa.array(documents[fresh])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(keys[fresh].view(np.int64))], ["doc_id", "h", "key"])

    return run


def _contained(docs: pa.Table, items: pa.Table) -> pa.Table:
    """What one document's text contains of its candidates, for each of its rows."""
    names = ["doc_id", "h", "c", "n_shared", "n_item"]
    out: list[tuple[int, int, int]] = []
    if docs.num_rows and items.num_rows:
        words, bounds = word_hashes([x.lower() for x in encoded(docs["text"].slice(0, 1).combine_chunks())])
        own = np.unique(shingles(words, bounds, WORDS)[0])
        for c, tokens in zip(items["c"].to_pylist(), items["tokens"]):
            wanted = tokens.values.to_numpy().view(np.uint64)
            both = int(np.isin(wanted, own).sum())
            if 100 * both >= PERCENT * len(wanted):
                out.append((c, both, len(wanted)))
    rows = pa.array(np.repeat(np.arange(docs.num_rows if out else 0), len(out)))
    columns = [pa.array([x[i] for x in out] * docs.num_rows, pa.int64()) for i in range(3)]
    return pa.Table.from_arrays([docs["doc_id"].take(rows), docs["h"].take(rows), *columns], names)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, h, item_id, n_shared, n_item): items that documents contain; h is the text's key."""
    spark = docs.sparkSession
    thin = docs.select("doc_id", "text", text_key(F.col("text")).alias("h"))
    items = saved(benchmark.select("item_id", "text").mapInArrow(lean(_items), _ITEM), "items")
    classes = items.dropDuplicates(["c"])
    minima = saved(classes.select("c", "k", F.explode(F.arrays_zip("keys", "slots")).alias("x")).select("c", "k", F.col("x.keys").alias("key"), F.col("x.slots").alias("slot")), "minima")
    partitions = sorted(r["k"] for r in minima.select("k").distinct().collect())  # one for each power of two
    bits = min(MOST_BITS, max(20, ceil(log2(BITS_EACH * minima.count() + 1))))
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for r in _pieces_of(minima, bits).toLocalIterator():  # 2**bits bits in all
        piece = np.frombuffer(r["bytes"], np.uint8)
        bitmap[r["piece"] * PIECE // 8 :][: len(piece)] = piece
    segments = spark.sparkContext.broadcast(Segments(bitmap, bits, partitions))
    hits = saved(thin.select("doc_id", "h", "text").mapInArrow(lean(_hits(segments)), "doc_id long, h long, key long"), "hits")
    found = minima.select("key", "c").join(hits.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    pairs = saved(join_counts(hits, saved(found, "met"), ["key"], "m", hits.count()).select("doc_id", "h", "c").distinct(), "candidates")
    wanted = near(saved(pairs.select("doc_id", "h").distinct(), "candidate-documents")).alias("w")
    texts = thin.alias("d").join(wanted, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.h") == F.col("w.h")), "left_semi")
    sets = pairs.join(near(classes.select("c", "tokens"), F.size("tokens")), "c")
    both = texts.groupBy("doc_id", "h").cogroup(sets.groupBy("doc_id", "h")).applyInArrow(_contained, "doc_id long, h long, c long, n_shared long, n_item long")
    return both.join(near(items.select("item_id", "c")), "c").select("doc_id", "h", "item_id", "n_shared", "n_item")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it contains, with the shared and all shingles of the item."""
    return contaminated(docs, benchmark).select("doc_id", "item_id", "n_shared", "n_item")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with the columns of ``docs``, whatever their names."""
    d, h, g = free_names(docs.columns, "__d", "__h", "__g")
    bad = saved(contaminated(docs, benchmark).select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct(), "contaminated")
    met = docs.withColumn(g, text_key(F.col("text")))
    out = met.join(near(bad), met["doc_id"].eqNullSafe(bad[d]) & (met[g] == bad[h]), "left_anti")
    return out.select(*columns_of(out, docs.columns))
