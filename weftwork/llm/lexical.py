"""Ranked lexical search by windowed bucket scoring.

Terms are maximal runs of letters and digits (any character beyond ASCII counts
as one).  One pass over the documents writes their postings for the terms that
some item holds: known by a bitmap of the items' terms, so that other terms are
never stored.  An aggregate counts in how many documents each term occurs.

Items are dealt to blocks whose terms have a bound, and each block's weights are
broadcast.  A task takes its postings WINDOW documents at a time, in order of
doc_id, inverts them, and scores one item after the other: each posting list of
the item's terms is added into an array with one cell a document of the window,
a bitset tells which cells are occupied, and these are harvested into the item's
heap.  The heaps of all tasks are merged by a ranking of at most ``top`` rows a
task and item.

Null texts and texts without terms match nothing and do not count.  Each row of
documents is a document, also if its id or all of it repeats; a null doc_id comes
last among equal scores.  Rows of items that agree in id and text are one item;
an item without terms, or none of whose terms occurs, has no rows.  Columns but
doc_id, item_id and text are not read.  Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import Bits, saved
from weftwork.llm.text import lean, text_chunks, word_hashes

#: Documents that an item gets.
TOP = 10
#: Documents of a window (their scores take 256 kB), and postings of a window at most (of one document, if it has more).
WINDOW, POSTINGS = 1 << 15, 1 << 22
#: Terms of all items of a block, about.
BLOCK = 1 << 18

#: The bytes between terms: ASCII but letters and digits.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, t): each item's distinct terms."""
    for batch in batches:
        q = batch.column("q").to_numpy()
        for low, texts in text_chunks(batch):
            terms, bounds = word_hashes(texts, GAP)
            own = [np.unique(terms[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            names = np.repeat(q[low : low + len(texts)], [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(own).view(np.int64))], ["q", "t"])


def _postings(wanted):
    """Rows (doc_id, n, ts, tfs) of documents with a term: its number of terms, and how often it has each wanted one."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_chunks(batch):
                terms, bounds = word_hashes(texts, GAP)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(texts)), n)
                hit = np.flatnonzero(wanted.value.has(terms))
                by = hit[np.lexsort((terms[hit], owner[hit]))]
                fresh = np.ones(len(by), bool)
                fresh[1:] = (terms[by[1:]] != terms[by[:-1]]) | (owner[by[1:]] != owner[by[:-1]])
                first = np.flatnonzero(fresh)
                tf = np.diff(np.append(first, len(by))).astype(np.int32)
                to = np.searchsorted(owner[by[first]], np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(to, pa.array(x)) for x in (terms[by[first]].view(np.int64), tf)]
                rows = pa.array(np.flatnonzero(n))
                ids = batch.column("doc_id").slice(low, len(texts))
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(n.astype(np.int64)).take(rows), *(x.cast(k).take(rows) for x, k in zip(lists, kinds))], ["doc_id", "n", "ts", "tfs"])

    return run


class Block:
    """The items of one block: their terms (numbers of ``terms``, sorted hashes) and the terms' weights."""

    def __init__(self, table: pa.Table, documents: int, occurrences: int):
        q, t = table["q"].to_numpy(), table["t"].to_numpy().view(np.uint64)
        self.terms, at, number = np.unique(t, return_index=True, return_inverse=True)
        self.weights = table["w"].to_numpy()[at]
        self.items, item = np.unique(q, return_inverse=True)
        by = np.argsort(item, kind="stable")
        self.bounds = np.searchsorted(item[by], np.arange(len(self.items) + 1))
        self.numbers = number[by]
        self.documents, self.occurrences = documents, occurrences

    def impacts(self, number: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each posting adds to a score, in 64-bit integers."""
        m = 100 - 90 + 90 * n * self.documents // self.occurrences
        return self.weights[number] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Heaps:
    """The best documents of each item so far."""

    def __init__(self, block: Block, top: int):
        self.block, self.top = block, top
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in block.items]

    def window(self, ids: np.ndarray, known: np.ndarray, slot: np.ndarray, number: np.ndarray, impact: np.ndarray) -> None:
        """Score one window: ``ids`` by slot (``known`` is false for null), and its postings."""
        by = np.argsort(number, kind="stable")
        slot, impact = slot[by], impact[by]
        to = np.searchsorted(number[by], np.arange(len(self.block.terms) + 1)).tolist()
        cells, bits = slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64)
        scores, occupied = np.zeros(len(ids), np.int64), np.zeros((len(ids) + 63) // 64, np.uint64)
        numbers, bounds = self.block.numbers.tolist(), self.block.bounds.tolist()
        for item in range(len(self.heaps)):
            for t in numbers[bounds[item] : bounds[item + 1]]:
                low, high = to[t], to[t + 1]
                if low < high:  # a list has a document once
                    scores[slot[low:high]] += impact[low:high]
                    np.bitwise_or.at(occupied, cells[low:high], bits[low:high])
            full = np.flatnonzero(occupied)
            if len(full):
                flags = np.unpackbits(occupied[full].view(np.uint8), bitorder="little").reshape(-1, 64)
                cell, bit = np.nonzero(flags)
                at = full[cell] * 64 + bit
                self._harvest(self.heaps[item], at, scores[at], ids, known)
                scores[at] = 0
                occupied[full] = 0

    def _harvest(self, heap: list, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        least = max(1, heap[0][0]) if len(heap) == self.top else 1
        if len(scores) > self.top:
            least = max(least, int(np.partition(scores, -self.top)[-self.top]))
        good = np.flatnonzero(scores >= least)
        at, scores = at[good], scores[good]
        order = np.lexsort((ids[at], ~known[at], -scores))[: self.top]
        for i in order.tolist():
            entry = (int(scores[i]), bool(known[at[i]]), -int(ids[at[i]]))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)

    def rows(self) -> pa.RecordBatch:
        found = [(q, -minus if known else None, score) for q, heap in zip(self.block.items.tolist(), self.heaps) for score, known, minus in heap]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["q", "doc_id", "score"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of WINDOW documents, fewer if they have many postings, in order of doc_id."""
    held: list[pa.RecordBatch] = []

    def cut() -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()  # nulls last
        held.clear()
        ends = table["ts"].combine_chunks().offsets.to_numpy().astype(np.int64)
        low = 0
        while low < table.num_rows:
            high = min(low + WINDOW, int(np.searchsorted(ends, ends[low] + POSTINGS, "right")) - 1)
            yield table.slice(low, max(high, low + 1) - low)
            low = max(high, low + 1)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= WINDOW or sum(len(x.column("ts").flatten()) for x in held) >= POSTINGS:
            yield from cut()
    if held:
        yield from cut()


def _scored(block, top: int):
    """Rows (q, doc_id, score): the best of what a task has for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        heaps = Heaps(b, top)
        for table in _windows(batches):
            lists, n = table["ts"].combine_chunks(), table["n"].to_numpy()
            terms, tf = lists.flatten().to_numpy().view(np.uint64), table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            slot = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
            number = np.minimum(np.searchsorted(b.terms, terms), len(b.terms) - 1)
            own = np.flatnonzero(b.terms[number] == terms)
            slot, number, tf = slot[own], number[own], tf[own]
            known = table["doc_id"].is_valid().to_numpy()
            heaps.window(table["doc_id"].fill_null(0).to_numpy(), known, slot, number, b.impacts(number, tf, n[slot]))
        yield heaps.rows()

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, text, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    queries = saved(items.select("item_id", "text").distinct().withColumn("q", F.monotonically_increasing_id()), "items")
    terms = saved(queries.select("q", "text").mapInArrow(lean(_item_terms), "q long, t long"), "item-terms")
    wanted = saved(terms.select("t").distinct(), "wanted-terms")
    known = spark.sparkContext.broadcast(Bits(wanted, "t"))
    postings = saved(docs.select("doc_id", "text").mapInArrow(lean(_postings(known)), "doc_id long, n long, ts array<long>, tfs array<int>"), "postings")
    documents, occurrences = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = postings.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = wanted.join(held, "t").select("t", weight.alias("w"))
    weighted = saved(terms.join(weights, "t").where("w > 0").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(ceil(terms.count() / BLOCK) or 1))), "weights")
    found = None
    for number in sorted(r["block"] for r in weighted.select("block").distinct().collect()):  # one for each BLOCK terms
        block = spark.sparkContext.broadcast(Block(weighted.where(F.col("block") == number).select("q", "t", "w").toArrow(), documents, occurrences))
        part = postings.mapInArrow(lean(_scored(block, top)), "q long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(queries, "q").select("item_id", "text", "rank", "doc_id", "score")


def lexical_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each item's TOP documents."""
    return ranked(docs, items).select("item_id", "rank", "doc_id", "score")
