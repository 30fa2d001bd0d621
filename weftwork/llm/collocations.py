"""Phrase collocations by contiguous pattern growth.

Phrases of 2 to LONGEST words that occur MIN times or more grow to the right,
depth first, as in PrefixSpan.  Words are counted first; then pairs of frequent
words; a bitmap of each is sent to all tasks.  Every occurrence of a frequent
pair is projected on its first word: the row holds the words that follow as long
as each next pair is frequent too (no frequent phrase can go on beyond).  Equal
rows of a task are one row with a count.  The rows of one prefix go to one task,
which sorts them, so that what a longer prefix projects is a range of pointers
into them, and extends the prefix by each word that has support in its range.
The rows of a frequent word's projection are dealt by the second word, and those
of a frequent pair's by all words; what tasks count of one phrase is summed.

Everything is counted per language; a word's hash holds its language.  Words are
known by 64-bit hashes until the phrases are ranked.  Null lang is ``und``, null
text is empty; an empty table gives no phrases; equal rows count each; columns
but lang and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import HOT_SHARE, Bits, near, saved
from weftwork.llm.text import lean, mix, span_hashes, summed, text_chunks, word_spans

#: Occurrences and words of a phrase, and how much of a phrase's occurrences a longer one must have to stand for it.
MIN, LONGEST, INSIDE = 30, 4, 80
#: Phrases of a language that are reported.
TOP = 2000
#: Steps of a doubled score, by which the first phrases are told from the rest.
STEPS = 64
#: Rows of counts that a task holds before it ships them, and sorted rows that are grown at once.
HELD, BLOCK = 1 << 21, 1 << 20

#: The characters that end a piece, and those between words.
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP = ENDS_PIECE.copy()
GAP[list(b" \t")] = True

_LEFT, _RIGHT = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + right * _RIGHT)


class Words:
    """The words of some texts: bytes, spans, hashes, and whether each begins a piece."""

    def __init__(self, texts: list[bytes], languages: np.ndarray):
        self.joined, self.starts, self.ends, bounds = word_spans(texts, GAP)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        self.hashes = mix(span_hashes(self.joined, self.starts, self.ends) ^ languages[self.owner])
        pieces = np.concatenate([[0], np.cumsum(ENDS_PIECE[self.joined])])
        self.begins = np.ones(len(self.starts), bool)
        self.begins[1:] = (self.owner[1:] != self.owner[:-1]) | (pieces[self.starts[1:]] != pieces[self.ends[:-1]])

    def linked(self, known: Bits) -> np.ndarray:
        """Whether each word and the next one are both known and in one piece."""
        own = known.has(self.hashes)
        out = np.zeros(len(own), bool)
        out[:-1] = own[:-1] & own[1:] & ~self.begins[1:]
        return out


def _language_hash(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang if lang is not None else "und").encode(), digest_size=8).digest(), "little")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        hashes = {x: _language_hash(x) for x in set(langs)}
        for low, texts in text_chunks(batch):
            own = langs[low : low + len(texts)]
            yield Words(texts, np.array([hashes[x] for x in own], np.uint64)), own


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, h, f), summed over what a task holds."""
    met: dict[int, list] = {}

    def told() -> pa.RecordBatch:
        langs, words, counts = zip(*met.values())
        h = pa.array(np.fromiter(met, np.uint64, len(met)).view(np.int64))
        out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), h, pa.array(counts, pa.int64())], ["lang", "word", "h", "f"])
        met.clear()
        return out

    for words, langs in _each(batches):
        kinds, at, counts = np.unique(words.hashes, return_index=True, return_counts=True)
        raw = words.joined.tobytes()
        for h, i, n in zip(kinds.tolist(), at.tolist(), counts.tolist()):
            if h in met:
                met[h][2] += n
            else:
                lang = langs[words.owner[i]]
                met[h] = ["und" if lang is None else lang, raw[words.starts[i] : words.ends[i]], n]
        if len(met) > HELD // 8:
            yield told()
    if met:
        yield told()


def _counted_pairs(known):
    """Rows (p, f) of pairs of known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def told(kinds: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(counts)], ["p", "f"])

        size = 0
        for words, _ in _each(batches):
            at = np.flatnonzero(words.linked(known.value))
            kinds, counts = np.unique(_pair(words.hashes[at], words.hashes[at + 1]), return_counts=True)
            held[0].append(kinds)
            held[1].append(counts)
            size += len(kinds)
            if size > HELD:
                kinds, _, counts = summed(np.concatenate(held[0]), np.concatenate(held[1]))
                if len(kinds) > HELD // 2:
                    yield told(kinds, counts)
                    kinds, counts = kinds[:0], counts[:0]
                held, size = ([kinds], [counts]), len(kinds)
        kinds, _, counts = summed(np.concatenate(held[0]), np.concatenate(held[1]))
        if len(kinds):
            yield told(kinds, counts)

    return run


class Projection:
    """What tasks need to project: known words, known pairs, and those whose rows are dealt out."""

    def __init__(self, words: Bits, pairs: Bits, hot_words: np.ndarray, hot_pairs: np.ndarray):
        self.words, self.pairs, self.hot_words, self.hot_pairs = words, pairs, hot_words, hot_pairs

    def rows(self, words: Words) -> np.ndarray:
        """One row of LONGEST hashes for each occurrence of a known pair; 0 stands for no further word."""
        linked = words.linked(self.words)
        at = np.flatnonzero(linked)
        linked[at] = self.pairs.has(_pair(words.hashes[at], words.hashes[at + 1]))
        at = np.flatnonzero(linked)
        out = np.zeros((LONGEST, len(at)), np.uint64)
        out[0] = words.hashes[at]
        goes = np.ones(len(at), bool)
        for k in range(1, LONGEST):
            goes = goes & linked[np.minimum(at + k - 1, len(linked) - 1)]
            out[k, goes] = words.hashes[at[goes] + k]
        return out

    def deal(self, rows: np.ndarray) -> np.ndarray:
        """0, or for a frequent first word a number by the second, or for a frequent pair one by all words (negative)."""
        out = np.zeros(rows.shape[1], np.int64)
        second = np.isin(rows[0], self.hot_words)
        out[second] = (mix(rows[1, second]) >> np.uint64(33)).astype(np.int64) + 1
        split = np.isin(_pair(rows[0], rows[1]), self.hot_pairs)
        out[split] = -(_row_hash(rows[:, split]) >> np.uint64(33)).astype(np.int64) - 1
        return out


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = rows[0]
    for row in rows[1:]:
        out = _pair(out, row)
    return out


_NAMES = [f"w{k + 1}" for k in range(LONGEST)]
_ROW = ", ".join(f"{x} long" for x in _NAMES)


def _projected(projection):
    """Rows (w1 .. w4, deal, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate([x for x, _ in held], axis=1)
            _, at, counts = summed(_row_hash(rows), np.concatenate([n for _, n in held]))
            return rows[:, at], counts

        def told(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in rows), pa.array(projection.value.deal(rows)), pa.array(counts)], [*_NAMES, "deal", "f"])

        size = 0
        for words, _ in _each(batches):
            rows = projection.value.rows(words)
            _, at, counts = np.unique(_row_hash(rows), return_index=True, return_counts=True)
            held.append((rows[:, at], counts))
            size += len(at)
            if size > HELD // 2:
                rows, counts = merged()
                if len(counts) > HELD // 4:
                    yield told(rows, counts)
                    rows, counts = rows[:, :0], counts[:0]
                held, size = [(rows, counts)], len(counts)
        if held:
            yield told(*merged())

    return run


class Growth:
    """Extends prefixes depth first over one block of sorted rows."""

    def __init__(self, rows: np.ndarray, deal: np.ndarray, counts: np.ndarray, least: int):
        self.rows, self.deal, self.counts, self.least = rows, deal, counts, least
        self.found: list[tuple[int, ...]] = []

    def extend(self, low: int, high: int, prefix: tuple[int, ...]) -> None:
        """The rows from ``low`` to ``high`` begin with ``prefix``; pointers to them are all that is projected.

        A phrase at an edge of the block, or of a frequent pair, may have more
        occurrences in another block or task, so it is grown and told whatever
        its support here.
        """
        column = self.rows[len(prefix), low:high]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
        ends = np.append(starts[1:], len(column))
        support = np.add.reduceat(self.counts[low:high], starts)
        partial = (self.deal[low + starts] < 0) | (starts + low == 0) | (ends + low == len(self.counts))
        grown = np.flatnonzero((column[starts] != 0) & ((support >= self.least) | partial)) if prefix else np.arange(len(starts))
        for start, end, word, n in zip(starts[grown].tolist(), ends[grown].tolist(), column[starts[grown]].tolist(), support[grown].tolist()):
            longer = (*prefix, word)
            if prefix:
                self.found.append((*longer, *[0] * (LONGEST - len(longer)), n))
            if len(longer) < LONGEST:
                self.extend(low + start, low + end, longer)


def _grown(least: int):
    """Rows (w1 .. w4, f) of phrases, from sorted rows of projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            columns = [table[x].to_numpy() for x in (*_NAMES, "deal", "f")]
            growth = Growth(np.stack(columns[:LONGEST]), columns[-2], columns[-1], least)
            growth.extend(0, table.num_rows, ())
            found = np.array(growth.found, np.int64).reshape(-1, LONGEST + 1)
            for low in range(0, len(found), HELD // 8):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found[low : low + HELD // 8].T], [*_NAMES, "f"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= BLOCK:
                yield from told()
        if held:
            yield from told()

    return run


def _hot(counts: DataFrame, name: str) -> np.ndarray:
    """The keys that have more than one in HOT_SHARE of all occurrences: HOT_SHARE keys at most."""
    total = counts.agg(F.sum("f")).first()[0] or 0
    return counts.where(F.col("f") > max(1, total // HOT_SHARE)).select(name).toArrow()[name].to_numpy().view(np.uint64)


class Phrases:
    """Counts of a table's words (lang, word, h, f), of its languages (lang, n) and of its phrases (ws, f)."""

    def __init__(self, docs: DataFrame, least: int = MIN):
        spark, thin = docs.sparkSession, docs.select("lang", "text")
        counted = saved(thin.mapInArrow(lean(_counted_words), "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f")), "words")
        self.totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
        self.words = counted.where(F.col("f") >= least)
        known = Bits(self.words, "h")
        sent = spark.sparkContext.broadcast(known)
        pairs = saved(thin.mapInArrow(lean(_counted_pairs(sent)), "p long, f long").groupBy("p").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "pairs")
        projection = spark.sparkContext.broadcast(Projection(known, Bits(pairs, "p"), _hot(self.words, "h"), _hot(pairs, "p")))
        rows = thin.mapInArrow(lean(_projected(projection)), f"{_ROW}, deal long, f long")
        grown = rows.repartition("w1", "deal").sortWithinPartitions(*_NAMES).mapInArrow(lean(_grown(least)), f"{_ROW}, f long")
        grown = grown.groupBy(*_NAMES).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        #: The phrases of two words or more.
        self.phrases = saved(grown.select(F.filter(F.array(*_NAMES), lambda w: w != 0).alias("ws"), "f"), "phrases")


def scored(phrases: Phrases) -> DataFrame:
    """(ws, a, l, r, score): each phrase by its lowest-scoring cut, the first of equal ones."""
    counts = phrases.phrases.unionByName(phrases.words.select(F.array("h").alias("ws"), "f"))
    cuts = phrases.phrases.select("ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ws", 1, F.col("k"))).withColumn("right", F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")))
    met = cuts.join(counts.select(F.col("ws").alias("left"), F.col("f").alias("l")), "left")
    met = met.join(counts.select(F.col("ws").alias("right"), F.col("f").alias("r")), "right")
    met = met.withColumn("score", F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)"))
    return met.groupBy("ws", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("ws", "a", "x.l", "x.r", "x.score")


def not_inside(phrases: Phrases, candidates: DataFrame, percent: int = INSIDE) -> DataFrame:
    """The candidates that no longer phrase stands for."""
    sizes = F.sequence(F.lit(2), F.size("ws") - 1)
    places = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("ws") - m + 1), lambda i: F.slice("ws", i, m))))
    parts = phrases.phrases.where(F.size("ws") > 2).select("f", F.explode(places).alias("ws"))
    most = parts.groupBy("ws").agg(F.max("f").alias("most"))
    return candidates.join(most, "ws", "left").where(F.coalesce(F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * percent, F.lit(True))).drop("most")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    phrases = Phrases(docs, least)
    kept = saved(not_inside(phrases, scored(phrases)), "candidates")
    spelled = kept.select("*", F.posexplode("ws").alias("at", "h")).join(phrases.words.select("h", "lang", "word"), "h")
    spelled = spelled.groupBy("ws", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.withColumn("phrase", F.array_join(F.transform("words", lambda x: x["word"]), " "))
    spelled = saved(spelled.select("lang", "phrase", "a", "l", "r", "score", F.floor(F.log2(F.col("score") + 1) * STEPS).cast("int").alias("step")), "spelled")
    # only steps of score that begin within the first ``top`` are ranked: about ``top`` rows a language go to one task
    falling = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = spelled.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(falling), F.lit(0)))
    cuts = saved(steps.where(F.col("before") < top).groupBy("lang").agg(F.min("step").alias("cut")), "cuts")
    high = spelled.join(near(cuts), "lang").where("step >= cut")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = high.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(phrases.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_report(docs: DataFrame) -> DataFrame:
    """Each language's first TOP phrases."""
    return collocations(docs)
