"""Language identification as multilingual mixture inference.

Each language has smoothed probabilities of hashed byte trigrams.  A document's
words are drawn from a mixture of languages; expectation-maximisation estimates
its proportions from the words' trigram likelihoods.  Sets of its one, two and
more likeliest languages are fitted as long as the likelihood less PENALTY *
log(words) for each further language rises; the last set that raised it is
selected.  A text of over CHUNK bytes is known by its different words and how
often each occurs, which gives the same proportions in less memory.

The model is fitted on a bounded sample: about SAMPLE different texts of each
language, drawn by hash, so copies count once and every language has some.  A
text that is null or has no letter is ``und`` with score 0.  A single known language is predicted with score 1; with no labelled
row at all everything is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import near, saved, text_key
from weftwork.llm.text import CHUNK, SPACES, chunks, encoded, word_spans

#: Different labelled texts of a language that the model is fitted on, about.
SAMPLE = 4_000
PENALTY, STEPS = 2.0, 6
BUCKETS = 1 << 15


def held(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams of lower-cased words with one space around, each word's first, each text's first word."""
    joined, starts, ends, bounds = word_spans([x.lower() for x in texts])
    spaced = np.where(joined <= 32, np.uint8(32), joined).astype(np.uint32)
    code = spaced[:-2] | spaced[1:-1] << np.uint32(8) | spaced[2:] << np.uint32(16)
    bucket = code * np.uint32(0x9E3779B1) >> np.uint32(17)
    # the word at [s, e) has the trigrams that start at s - 1 to e - 2
    inside = np.zeros(len(joined) + 1, np.int8)
    inside[starts - 1] += 1
    inside[ends - 1] -= 1
    keep = np.cumsum(inside)[: len(bucket)] > 0
    lengths = ends - starts
    return bucket[keep], np.concatenate([[0], np.cumsum(lengths)]), bounds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = encoded(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            total = np.zeros(BUCKETS, np.int64)
            for a, b in chunks(own):
                total += np.bincount(_grams(own[a:b])[0], minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "gram", "n"])


def _tallied(text: bytes) -> tuple[bytes, np.ndarray]:
    """The different words of a text and how often each occurs, counted a piece at a time."""
    count: Counter[bytes] = Counter()
    start = 0
    while start < len(text):
        end = start + CHUNK
        while end < len(text) and text[end] not in SPACES:
            end += 1
        count.update(text[start:end].lower().split())
        start = end
    return b" ".join(count), np.fromiter(count.values(), np.float64, len(count))


class MixtureModel:
    """Log probabilities of trigram buckets by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smoothed = counts + 0.1
        self.log = np.ascontiguousarray(np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32).T) if langs else None

    def mixtures(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the selected languages of each text (0 for others), and the texts' numbers of words."""
        times = None
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            text, times = _tallied(texts[0])
            texts = [text]
        grams, word_at, bounds = _grams(texts)
        kinds, size = np.diff(bounds), len(self.langs)
        if not len(grams):
            return np.zeros((len(texts), size)), kinds
        log = np.stack([np.add.reduceat(own[grams], word_at[:-1]) for own in self.log], axis=1)
        top = log.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(log - top, -30.0))
        if times is None:
            times = np.ones(len(like))
        full = np.flatnonzero(kinds)
        owner = np.repeat(np.arange(len(full)), kinds[full])
        base = np.bincount(owner, weights=top[:, 0] * times)
        totals = np.bincount(owner, weights=times)
        share = np.full((len(full), size), 1 / size)
        share = self._fitted(like, times, share, owner, totals)
        order = np.argsort(-share, axis=1, kind="stable")
        best, chosen = np.full(len(full), -np.inf), np.zeros_like(share)
        at = np.arange(len(full))  # the texts whose last set raised the likelihood
        for k in range(1, size + 1):
            allowed = np.zeros((len(at), size))
            np.put_along_axis(allowed, order[at, :k], 1.0, axis=1)
            fitted = np.maximum(share[at], 1e-6) * allowed
            fitted /= fitted.sum(axis=1, keepdims=True)
            if k > 1:
                fitted = self._fitted(like, times, fitted, owner, totals[at])
            own = np.log((like * fitted[owner]).sum(axis=1) + 1e-300) * times
            score = base[at] + np.bincount(owner, weights=own, minlength=len(at)) - PENALTY * (k - 1) * np.log(totals[at] + 1)
            better = score > best[at]
            best[at[better]], chosen[at[better]] = score[better], fitted[better]
            if not better.any():
                break
            kept = better[owner]
            like, times, owner = like[kept], times[kept], (np.cumsum(better) - 1)[owner[kept]]
            at = at[better]
        out = np.zeros((len(texts), size))
        out[full] = chosen
        return out, kinds

    @staticmethod
    def _fitted(like, times, share, owner, totals):
        """Proportions after STEPS steps of expectation-maximisation over all texts at once; words are in the order of texts."""
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for _ in range(STEPS):
            part = like * share[owner]
            part *= (times / (part.sum(axis=1) + 1e-300))[:, None]
            share = np.add.reduceat(part, first, axis=0) / totals[:, None]
        return share


def fit(labelled: DataFrame) -> MixtureModel:
    """A model from (doc_id, text, lang) rows; rows with a null lang are left out."""
    rows = labelled.where("lang is not null").select("doc_id", "text", "lang", text_key(F.col("text")).alias("h"))
    texts = saved(rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")), "labelled-texts")
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    drawn = texts.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("h"), F.col("n")) < SAMPLE).select("lang", "h", "doc_id")
    drawn = near(saved(drawn, "drawn")).alias("k")
    met = rows.alias("d").join(drawn, (F.col("d.h") == F.col("k.h")) & (F.col("d.lang") == F.col("k.lang")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    sample = met.dropDuplicates(["lang", "h"]).select("text", "lang")
    table = sample.mapInArrow(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = table.toArrow()  # BUCKETS rows for each language at most
    langs = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    counts[table["gram"].to_numpy(), [at[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    return MixtureModel(langs, counts)


def predict(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """``docs`` (text and others) with lang_pred, score and the selected languages, without text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x for x in docs.columns if x != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: MixtureModel = shared.value
        for batch in batches:
            plain = batch.column("text").to_pylist()
            texts = encoded(batch.column("text"))
            pred, score, found = [], [], []
            for a, b in chunks(texts):
                mixed, words = model.mixtures(texts[a:b]) if model.langs else (None, None)
                for i in range(a, b):
                    row = mixed[i - a] if model.langs and words[i - a] else None
                    if row is None or not any(map(str.isalpha, plain[i] or "")):
                        pred.append("und")
                        score.append(0.0)
                        found.append([])
                        continue
                    top = int(row.argmax())
                    pred.append(model.langs[top])
                    score.append(min(1.0, max(0.0, float(row[top]))))
                    found.append([model.langs[j] for j in np.argsort(-row) if row[j] > 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))], [*names, "lang_pred", "score", "languages"])

    fields = [f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in names]
    return docs.select(*names, "text").mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, languages array<string>"]))


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: held_out, predicted language, its share, and all selected languages."""
    thin = docs.select("doc_id", "text", "lang")
    model = fit(thin.where(~held(F.col("doc_id"), 4, 2)))
    return predict(thin.select("doc_id", held(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model)
