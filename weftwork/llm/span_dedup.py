"""Substring dedup by sliding spans of sentences.

A text is cut into units: sentences, which end at a line's end or at a word that
ends with ``.``, ``!`` or ``?``, and the pieces of sentences of over PIECE words.
A long sentence is cut after each word whose hash is the least among its NEAR
neighbours on both sides, so where a piece ends depends on the words around only,
and a passage has the same pieces wherever it stands, changed words nearby or
not.  Every run of SPAN consecutive units is hashed and the runs are joined over
all documents.  The first place of a run is the one with the smallest (doc_id,
position); units that any other place covers are removed.  Words are compared
with A-Z in lower case, white space not at all.

Null, empty and wordless texts have no runs and stay as they are.  Rows that
agree in doc_id and text are one document; a null doc_id comes before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import join_counts, saved, text_key
from weftwork.llm.text import chunks, encoded, shingles, word_hashes, word_spans

#: Units in a run, words in the longest sentence that is not cut, neighbours that a cut looks at.
SPAN, PIECE, NEAR = 3, 12, 3
#: A piece in which no word is least among its neighbours (as in repeated words) ends after so many words.
LONGEST = 12

_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lower-cased texts: words' hashes, words' first bytes, each unit's first word, each text's first unit."""
    joined, starts, ends, bounds = word_spans(texts)
    words, _ = word_hashes(texts)
    n = len(words)
    lines = np.cumsum(joined == 10)
    ended = _STOPS[joined[ends - 1]] | (lines[np.append(starts[1:], len(joined)) - 1] > lines[ends - 1])
    ended[bounds[1:][np.diff(bounds) > 0] - 1] = True
    sentence = np.concatenate([[0], np.cumsum(ended)[:-1]]) if n else np.zeros(0, np.int64)
    cut = (np.bincount(sentence) > PIECE)[sentence] if n else np.zeros(0, bool)
    for d in range(1, NEAR + 1):
        same = sentence[d:] == sentence[:-d]
        cut[:-d] &= same & (words[:-d] < words[d:])
        cut[d:] &= same & (words[d:] < words[:-d])
        cut[:d] = False
        cut[-d:] = False
    cut |= ended
    first = np.flatnonzero(np.concatenate([[True], cut[:-1]])) if n else np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    first = np.union1d(first, np.flatnonzero((place > 0) & (place % LONGEST == 0)))
    return words, starts, first, np.searchsorted(first, bounds)


def units_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Each text's units, with the white space around them; joined they are the text."""
    for begin, end in chunks(texts):
        own = texts[begin:end]
        _, starts, first, to = _cut([x.lower() for x in own])
        at = starts[first]
        base = 1
        for i, text in enumerate(own):
            places = [0, *(at[to[i] + 1 : to[i + 1]] - base).tolist(), len(text)]
            yield [text[x:y] for x, y in zip(places, places[1:])] if text else []
            base += len(text) + 1


def units(text: bytes) -> list[bytes]:
    """The units of one text."""
    return next(units_of([text]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, doc_id, h, at) of all runs of SPAN units."""
    for batch in batches:
        texts = [x.lower() for x in encoded(batch.column("text"))]
        for start, end in chunks(texts):
            words, _, first, to = _cut(texts[start:end])
            # a unit's hash is that of its sequence of words
            own = _sequence_hashes(words, np.append(first, len(words)))
            runs, ends = shingles(own, to, SPAN)
            counts = np.diff(ends)
            whole = np.repeat(np.diff(to) >= SPAN, counts)
            rows = np.repeat(np.arange(start, end), counts)[whole]
            at = (np.arange(len(runs)) - np.repeat(ends[:-1], counts))[whole]
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(runs[whole].view(np.int64)), batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array(at.astype(np.int32))], ["run", "doc_id", "h", "at"])


def _sequence_hashes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each group of words, which depends on their order."""
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    weighed = words * (np.uint64(2) * place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ words >> np.uint64(7)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)])
    return sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts, gone_units, gone_words = [], [], [], []
        for cut, places in zip(units_of(encoded(batch.column("text"))), batch.column("__at").to_pylist()):
            gone = {i for at in places or () for i in range(at, at + SPAN)}
            kept.append(b"".join(u for i, u in enumerate(cut) if i not in gone))
            counts.append(len(cut))
            gone_units.append(len(gone))
            gone_words.append(sum(len(cut[i].split()) for i in gone))
        names = [x for x in batch.schema.names if x not in ("text", "__at")]
        numbers = [pa.array(x, pa.int64()) for x in (counts, gone_units, gone_words)]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(kept, pa.binary()).cast(pa.string()), *numbers], [*names, "text", "n_units", "n_dropped", "n_dropped_words"])


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the text without repeated spans, its units, dropped units and words."""
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("h"))
    runs = saved(keyed.mapInArrow(_runs, "run long, doc_id long, h long, at int"), "runs")
    first = F.min(F.struct("doc_id", "h", "at")).alias("first")
    repeated = saved(runs.groupBy("run").agg(first, F.count(F.lit(1)).alias("m")).where("m > 1"), "repeated")
    met = join_counts(runs, repeated, ["run"], "m", runs.count())
    here = F.struct("doc_id", "h", "at")
    later = met.where(~here.eqNullSafe(F.col("first")))
    drops = later.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(F.collect_set("at").alias("__at"))
    out = keyed.join(drops.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(drops["__d"]) & (keyed["h"] == drops["__h"]), "left").select("doc_id", "text", "__at")
    return out.mapInArrow(_removed, "doc_id long, text string, n_units long, n_dropped long, n_dropped_words long")


def span_report(docs: DataFrame) -> DataFrame:
    """Per document: what was dropped, and the kept text with its SHA-256."""
    out = drop_repeated_spans(docs)
    return out.select("doc_id", "n_units", "n_dropped", "n_dropped_words", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")
