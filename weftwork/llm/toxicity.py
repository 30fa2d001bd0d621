"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character 3- to 6-grams of its words (hashed bytes, A-Z
in lower case, with marks at a word's ends), so an unseen misspelling shares most
of its vectors with what it misspells.  The vectors of all known n-grams of the
whole text are averaged, and SCALE times the average goes into a two-class linear
softmax; without SCALE the few toxic n-grams of a text would hardly move its
average in so few steps.  Vectors and softmax are trained jointly in numpy by
Adam on a bounded sample: about TOXIC and CLEAN labelled documents, drawn by hash.
One in APART of these is left out of that and then sets the softmax's bias, so that
a score of 0.5 parts the labels of texts that the vectors were not fitted to.

A text without known n-grams (as an empty or null one) scores by the softmax's
bias alone.  Without labels of both kinds every score is close to 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from weftwork.llm.common import columns_of
from weftwork.llm.langid import held
from weftwork.llm.text import encoded, lean

#: Labelled documents of each kind in the training sample, about.
TOXIC, CLEAN = 1_200, 2_000
DIMENSIONS, BUCKETS, SCALE = 4, 1 << 18, 50.0
STEPS, RATE, DECAY = 40, 0.1, 1e-4
#: The toxic documents weigh so much in all, the clean ones 1.
WEIGHT = 0.5
#: One in so many sampled documents sets the bias, if there are FEW of each kind at least; a clean one called toxic costs COST toxic ones missed.
APART, FEW, COST = 5, 8, 5.0
#: An n-gram is known if it is in so many words of training documents.
SEEN = 10
#: Words a worker remembers the sums of; n-grams whose vectors are gathered at once.
REMEMBERED, GATHERED = 400_000, 400_000


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams, and where each word's begin (with the end)."""
    marked = [b"<" + w + b">" for w in words]
    joined = np.frombuffer(b"".join(marked) + b"\0" * 6, np.uint8).astype(np.uint32)
    lengths = np.array([len(x) for x in marked], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    left = np.repeat(ends, lengths) - np.arange(int(lengths.sum()))  # bytes to the word's end
    code = joined[: len(owner)] * np.uint32(0x01000193)
    grams, owners = [], []
    for n in range(2, 7):
        code = (code ^ joined[n - 1 : n - 1 + len(owner)]) * np.uint32(0x01000193)
        if n >= 3:
            whole = left >= n
            value = code[whole] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            grams.append((value ^ value >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(14))
            owners.append(owner[whole])
    owners_all = np.concatenate(owners)
    by = np.argsort(owners_all, kind="stable")
    counts = np.bincount(owners_all, minlength=len(words))
    return np.concatenate(grams)[by].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def _grouped(values: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[rows]`` over groups that begin at ``first``, gathered piece by piece."""
    out = np.zeros((len(first), values.shape[1]), np.float32)
    ends = np.append(first[1:], len(rows))
    low = 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(ends, first[low] + GATHERED, "right")))
        out[low:high] = np.add.reduceat(values[rows[first[low] : ends[high - 1]]], first[low:high] - first[low], axis=0)
        low = high
    return out


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Where each group of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)


@dataclass
class Bags:
    """Training texts as words and known n-grams, sorted for sums both ways."""

    words: np.ndarray  # the different words of all texts, text by text
    counts: np.ndarray  # how often
    text_first: np.ndarray
    word_order: np.ndarray  # the same by word
    grams: np.ndarray  # known n-grams by word, numbered by ``used``
    owners: np.ndarray  # their words
    gram_order: np.ndarray
    used: np.ndarray  # buckets
    sizes: np.ndarray  # known n-grams of each text, 1 at least

    @classmethod
    def of(cls, split: list[list[bytes]]) -> Bags:
        names = sorted(set().union(*split))
        number = {w: i for i, w in enumerate(names)}
        parts = [np.unique(np.fromiter((number[w] for w in words), np.int32, len(words)), return_counts=True) for words in split]
        del number
        words, counts = np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.float32)
        lengths = np.array([len(w) for w, _ in parts])
        del parts
        grams, at = subwords(names)
        owners = np.repeat(np.arange(len(names), dtype=np.int32), np.diff(at))
        often = np.bincount(grams, weights=np.bincount(words, minlength=len(names))[owners], minlength=BUCKETS) >= SEEN
        known = often[grams]
        grams, owners = grams[known], owners[known]
        used = np.flatnonzero(often)
        place = np.zeros(BUCKETS, np.int32)
        place[used] = np.arange(len(used))
        grams = place[grams]
        text_first = np.cumsum(lengths) - lengths
        sizes = np.add.reduceat(counts * np.bincount(owners, minlength=len(names)).astype(np.float32)[words], text_first)
        return cls(words, counts, text_first, np.argsort(words, kind="stable"), grams, owners, np.argsort(grams, kind="stable"), used, np.maximum(sizes, 1))


class SubwordModel:
    """Subword vectors and a two-class softmax over SCALE times their average in a text."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.weights = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.array([1.0, -1.0], np.float32)
        self.known = np.zeros(BUCKETS, bool)

    def train(self, texts: list[bytes], labels: list[int]) -> None:
        kept = [i for i, x in enumerate(texts) if x.split()]
        apart = kept[::APART]
        if min(sum(labels[i] == y for i in apart) for y in (0, 1)) >= FEW:
            self._fit([texts[i] for j, i in enumerate(kept) if j % APART], np.array([labels[i] for j, i in enumerate(kept) if j % APART]))
            self._set_bias([texts[i] for i in apart], np.array([labels[i] for i in apart]))
        else:
            self._fit([texts[i] for i in kept], np.array([labels[i] for i in kept]))

    def _set_bias(self, texts: list[bytes], y: np.ndarray) -> None:
        """Move the bias to where the errors on these texts cost least."""
        if not self.known.any():
            return
        logits = Scorer(self).logits(texts)
        order = np.argsort(logits)
        found, y = logits[order], y[order]
        # with the limit below place i, toxic ones before it are missed and clean ones from it on are called toxic
        missed = np.append(0, np.cumsum(y == 1)) / (y == 1).sum()
        called = np.append(0, np.cumsum((y == 0)[::-1]))[::-1] / (y == 0).sum()
        best = np.flatnonzero((missed + COST * called)[1:-1] == (missed + COST * called)[1:-1].min())
        at = int(best[len(best) // 2])
        shift = (found[at] + found[at + 1]) / 4
        self.bias += np.array([shift, -shift], np.float32)

    def _fit(self, texts: list[bytes], y: np.ndarray) -> None:
        if len(set(y.tolist())) < 2:
            return
        bags = Bags.of([x.lower().split() for x in texts])
        self.known[bags.used] = True
        cost = np.where(y == 1, WEIGHT / (y == 1).sum(), 1.0 / (y == 0).sum())
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.vectors[bags.used], self.weights, self.bias)]
        for step in range(1, STEPS + 1):
            for k, (gradient, (slow, fast)) in enumerate(zip(self.gradients(bags, y, cost), moments)):
                slow *= 0.9
                slow += 0.1 * gradient
                fast *= 0.99
                fast += 0.01 * gradient**2
                move = RATE * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
                if k == 0:
                    self.vectors[bags.used] -= move
                elif k == 1:
                    self.weights -= move
                else:
                    self.bias -= move

    def gradients(self, bags: Bags, y: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss and DECAY / 2 of the vectors' squares, by vectors, weights and bias."""
        own = self.vectors[bags.used]
        first = _firsts(bags.owners)
        by_word = np.zeros((int(bags.words.max()) + 1, DIMENSIONS), np.float32)
        by_word[bags.owners[first]] = _grouped(own, bags.grams, first)
        average = np.add.reduceat(by_word[bags.words] * bags.counts[:, None], bags.text_first, axis=0) * (SCALE / bags.sizes)[:, None].astype(np.float32)
        logits = average @ self.weights + self.bias
        toxic = 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))
        two = ((toxic - y) * cost)[:, None] * np.array([-1.0, 1.0])
        to_text = ((two @ self.weights.T) * (SCALE / bags.sizes)[:, None]).astype(np.float32)
        text = np.repeat(np.arange(len(y)), np.diff(np.append(bags.text_first, len(bags.words))))
        order = bags.word_order
        first = _firsts(bags.words[order])
        by_word[:] = 0
        by_word[bags.words[order][first]] = np.add.reduceat(to_text[text[order]] * bags.counts[order, None], first, axis=0)
        to_vectors = DECAY * own
        first = _firsts(bags.grams[bags.gram_order])
        if len(first):
            to_vectors += _grouped(by_word, bags.owners[bags.gram_order], first)
        return [to_vectors, (average.T @ two).astype(np.float32), two.sum(axis=0).astype(np.float32)]

    def sums(self, words: list[bytes]) -> list[complex]:
        """For each word, what its known n-grams add to the difference of the logits (real) and their number (imaginary)."""
        grams, at = subwords(words)
        value = np.where(self.known, self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), 0) + 1j * self.known
        return np.add.reduceat(value[grams], at[:-1]).tolist()


class Scorer(dict):
    """Scores texts; remembers the sums of words within a bound."""

    def __init__(self, model: SubwordModel):
        super().__init__()
        self.model = model
        self.offset = float(model.bias[1] - model.bias[0]) if model.known.any() else -20.0

    def scores(self, texts: list[bytes]) -> list[float]:
        return (1 / (1 + np.exp(-np.clip(self.logits(texts), -700, 700)))).tolist()

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """The differences of the two logits."""
        out = []
        for start in range(0, len(texts), 256):
            split = [x.lower().split() for x in texts[start : start + 256]]
            new = [w for w in set().union(*split) if w not in self]
            if new:
                self.update(zip(new, self.model.sums(new)))
            for words in split:
                whole = sum(map(self.__getitem__, words), 0j)
                out.append(self.offset + (SCALE * whole.real / whole.imag if whole.imag else 0.0))
            if len(self) > REMEMBERED:
                self.clear()
        return np.array(out)


def fit(docs: DataFrame, labels: DataFrame) -> SubwordModel:
    """A model from documents and their labels (doc_id, toxic); null labels are left out."""
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    model = SubwordModel()
    if len(counts) < 2:
        return model
    part = F.pmod(F.xxhash64("doc_id"), F.when(F.col("toxic") == 1, F.lit(counts[1])).otherwise(F.lit(counts[0])))
    drawn = known.where(part < F.when(F.col("toxic") == 1, F.lit(TOXIC)).otherwise(F.lit(CLEAN)))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").toArrow()
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    sample = sample.take(order)
    model.train(encoded(sample["text"]), [int(x) for x in sample["toxic"].to_pylist()])
    return model


def predict(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """``docs`` with score and predicted instead of text (and of columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x for x in docs.columns if x not in ("text", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = model.__dict__.get("scorer") or Scorer(model)
        model.scorer = scorer  # lasts as long as the broadcast does in this worker
        for batch in batches:
            scores = scorer.scores(encoded(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())], [*names, "score", "predicted"])

    schema = StructType([*(docs.schema[x] for x in names), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select(*columns_of(docs, names), "text").mapInArrow(lean(run), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted."""
    model = fit(docs, labels.where(~held(F.col("doc_id"), 5, 0)))
    return predict(docs.select("doc_id", held(F.col("doc_id"), 5, 0).alias("held_out"), "text"), model)
