"""Language-model scoring by a hashed maximum-entropy model.

The next token's chance is factored along a tree: a class first, then a class in
it, down to the word.  The tree has WAYS branches and is built by falling count
(Huffman), so it grows with the vocabulary.  Its leaves are all words of the
dictionary (those that training has OWN times or more), the end of a text and, for
all other words, met or not, SHAPES classes by shape (last byte, bytes beyond
ASCII), in each of which a word's chance is its smoothed count.  Each branching is a softmax over features: a
constant, the previous word, its last three letters, those of the word before it
(a skip), and those of the TIED words before these, which share one feature each
wherever they stand.  Endings are known of words that training never met.  A feature and a branching together are hashed to a
row of weights; there are PER_ROOT rows for each of the root of the counted
number of different word pairs, so rows grow with the corpus, but slower than
its pairs, and features share rows.  The constants are the log frequencies.  The
other weights are trained in synchronous updates, STEPS and one more for each time
the training tokens are four times as many, beyond a million; each takes the documents of one
hash slice, so all training documents are used once.  A gradient is, for each
weight, how often its branch was taken where the model expected it: the numbers
that were taken less those of one draw from the model at each branching, whose
mean is the expectation.  Tasks count both in sparse numpy batches and send them as
half floats (a task that counts over four million of one branch says four million); a
shuffle adds them up.

Word counts are exact.  The DICTIONARY most frequent words are broadcast at
most; the counts of rarer words are joined by a shuffle.

Null and empty texts are one end token.  Rows that agree in doc_id and text have
the same scores.  With no training document all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import saved, text_key
from weftwork.llm.langid import held
from weftwork.llm.text import _tables, chunks, encoded, mix, word_spans

WAYS, SHAPES = 16, 8
#: Rows of weights for each of the root of the number of word pairs; of pairs, one in PAIR_SAMPLE is counted.
PER_ROOT, PAIR_SAMPLE = 32, 64
#: Keys of weights that a task counts at once: few enough for what they touch to stay in a core's own cache.
KEYS = 4096
#: Rows of weights that are added up together.
BLOCK = 64
#: Words whose counts are broadcast at most, about 25 bytes each.
DICTIONARY = 1_000_000
STEPS, RATE = 4, 0.18
#: Occurrences from which a word is a leaf of its own: of rarer ones training learns
#: little, and their classes stand for words that it has not met at all.
OWN = 8
#: Words before the two last ones whose endings are features.
TIED = 6
#: What a weight's spread is raised by in a step, so that rarely met weights move little,
#: times the root of 1 + the features that a row is met by in a step: the more share it, the less each is told.
PRIOR = 6.0

# What stands for the words before a text, and odd factors that tell the features of one word apart.
_START = np.uint64(0x5107_5107_5107_5107)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: The factors of a context and of a node in the key of a row.
_OF_CONTEXT, _OF_NODE = (np.uint64(int(_FACTORS[i]) * int(_FACTORS[0]) % 2**64) for i in (1, 3))
#: A row of WAYS numbers times this gives its running sums; the product is several times as fast as cumsum.
_UP_TO = np.triu(np.ones((WAYS, WAYS), np.float32))


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.astype(np.float16).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 2 * size, "zstd", asbytes=True), np.float16).astype(np.float32)


def _trues(rows: np.ndarray) -> np.ndarray:
    """How many of each row's WAYS values are true."""
    counts = np.bitwise_count(rows.view(np.uint64))  # of eight values of one byte, 0 or 1, each
    return sum(counts.T.astype(np.int32))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of all words, and the bounds of each text's words."""
    return _tokens(*word_spans(texts))


def _tokens(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, back = _tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)], out=sums[1:])
    beyond = np.concatenate([[0], np.cumsum(joined >= 128, dtype=np.int32)])
    last = joined[ends - 1]
    mark = np.where(last == ord("."), 1, np.where(last == ord(","), 2, np.where((last < 48) | ((last > 57) & (last < 97)), 3, 0)))
    shape = mark + 4 * (beyond[ends] > beyond[starts])
    return mix((sums[ends] - sums[starts]) * back[starts]), shape.astype(np.int64), bounds


def endings_of(texts: list[bytes]) -> np.ndarray:
    """Hashes of the last three bytes of all words, without up to two signs at the end."""
    return _endings(*word_spans(texts)[:3])


def _endings(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = ends - 1
    for _ in range(2):
        byte = joined[last]
        last = last - (((byte < 48) | ((byte > 57) & (byte < 97))) & (last > starts))
    out = np.full(len(last), 1, np.uint64)
    for i in range(3):
        byte = np.where(last - i >= starts, joined[np.maximum(last - i, 0)], 0).astype(np.uint64)
        out = out << np.uint64(8) | byte
    return mix(out)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, shape, number), counted over about two million words; sampled pairs have the shape -1."""
    block: list[tuple[np.ndarray, np.ndarray]] = []
    block_pairs: list[np.ndarray] = []

    def told() -> pa.RecordBatch:
        words, shapes = (np.concatenate(x) for x in zip(*block))
        # a word has one shape; without places to keep, sorting is several times as fast
        kinds = [np.unique(words[shapes == s], return_counts=True) for s in range(SHAPES)]
        pairs = np.unique(np.concatenate(block_pairs))
        shapes = np.repeat([*range(SHAPES), -1], [*(len(w) for w, _ in kinds), len(pairs)])
        words = np.concatenate([*(w for w, _ in kinds), pairs])
        counts = np.concatenate([*(n for _, n in kinds), np.ones(len(pairs), np.int64)])
        block.clear()
        block_pairs.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shapes.astype(np.int32)), pa.array(counts)], ["w", "s", "n"])

    size = 0
    for batch in batches:
        texts = [x.lower() for x in encoded(batch.column("text"))]
        for start, end in chunks(texts, 1 << 17):
            words, shapes, bounds = tokens_of(texts[start:end])
            block.append((words, shapes))
            if len(words):
                inside = np.ones(len(words), bool)
                inside[bounds[:-1][np.diff(bounds) > 0]] = False
                pairs = mix(words + np.roll(words, 1) * _FACTORS[0])
                block_pairs.append(np.unique(pairs[inside & (pairs % np.uint64(PAIR_SAMPLE) == 0)]))
            size += len(words)
            if size > 2_000_000:
                yield told()
                size = 0
    if size:
        yield told()


def _tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents and branches of a Huffman tree's leaves and nodes, and the nodes' log chances of branches; the root is last."""
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    leaves, rest = weights[order].tolist(), order.tolist()
    nodes = 1 + (n - 2) // (WAYS - 1)
    parent, branch = np.zeros(n + nodes, np.int32), np.zeros(n + nodes, np.int8)
    made: list[float] = []
    i, j = 0, n
    for node in range(n, n + nodes):
        children, mass = [], 0.0
        for _ in range(WAYS if node > n else 2 + (n - 2) % (WAYS - 1)):
            if i < n and (j >= node or leaves[i] <= made[j - n]):
                children.append(rest[i])
                mass += leaves[i]
                i += 1
            else:
                children.append(j)
                mass += made[j - n]
                j += 1
        made.append(mass)
        parent[children], branch[children] = node, np.arange(len(children))
    log = np.full((nodes, WAYS), -30.0, np.float32)
    below = slice(0, n + nodes - 1)
    mass = np.concatenate([weights, made])
    log[parent[below] - n, branch[below]] = np.log(mass[below] / mass[parent[below]])
    return parent, branch, log


@dataclass
class Vocabulary:
    """Counts of the training tokens: totals, and the dictionary of frequent words with their tree."""

    total: int
    distinct: int
    ends: int
    pairs: int  # different pairs of words, about
    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    shape_total: np.ndarray  # of words outside the dictionary
    shape_distinct: np.ndarray
    parent: np.ndarray = field(init=False)
    branch: np.ndarray = field(init=False)
    log: np.ndarray = field(init=False)
    bits: int = field(init=False)
    places: np.ndarray = field(init=False)  # of the first word whose first bits are not less than each

    def __post_init__(self) -> None:
        self.bits = 1 + ceil(log2(len(self.words) + 1))
        self.places = np.searchsorted(self.words, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        tails = self.shape_total + 0.5 * (self.shape_distinct + 1)
        self.parent, self.branch, self.log = _tree(np.concatenate([self.counts + 0.5, [self.ends + 0.5], tails]))

    @property
    def end(self) -> int:
        """The leaf of a text's end; those of the shapes follow."""
        return len(self.words)

    def leaves(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """The word's own leaf, or that of its shape if it is not in the dictionary."""
        if not len(self.words):
            return self.end + 1 + shapes
        at = self.places.take((words >> np.uint64(64 - self.bits)).view(np.int64)).astype(np.int64)
        on = np.arange(len(words))
        while len(on):  # hashes are spread evenly, so few words share their first bits
            on = on[self.words.take(at[on], mode="clip") < words[on]]
            at[on] += 1
            on = on[at[on] < len(self.words)]
        return np.where(self.words.take(at, mode="clip") == words, at, self.end + 1 + shapes)


def count_words(train: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training documents, and the counts of words outside its dictionary."""
    rows = train.select("text").mapInArrow(_word_counts, "w long, s int, n long")
    counts = saved(rows.groupBy("w").agg(F.min("s").alias("s"), F.sum("n").alias("n")), "word-counts")
    pairs = PAIR_SAMPLE * counts.where("s < 0").count()
    counts = counts.where("s >= 0")
    ends = train.count()
    shapes = {r["s"]: (r["n"], r["v"]) for r in counts.groupBy("s").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # SHAPES rows
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # eight rows for each power of two
    room, least = DICTIONARY, 1 << 30
    for x in sorted(sizes, reverse=True):
        room -= sizes[x]
        if room < 0:
            break
        least = x
    own = (level >= least) & (F.col("n") >= OWN)
    known = counts.where(own).select("w", "s", "n").toArrow()  # DICTIONARY rows at most
    words, number, shape = known["w"].to_numpy().view(np.uint64), known["n"].to_numpy(), known["s"].to_numpy()
    total, distinct = np.zeros(SHAPES), np.zeros(SHAPES)
    for s, (n, v) in shapes.items():
        total[s], distinct[s] = n, v
    np.subtract.at(total, shape, number)
    np.subtract.at(distinct, shape, 1)
    order = np.argsort(words)
    vocabulary = Vocabulary(int(sum(n for n, _ in shapes.values())) + ends, sum(v for _, v in shapes.values()) + (ends > 0), ends, pairs, words[order], number[order], total, distinct)
    return vocabulary, counts.where(~own).select("w", "n")


class MaxEnt:
    """The weights: a row of WAYS branches for each hashed feature at a node of the tree."""

    def __init__(self, pairs: int):
        self.bits = max(12, ceil(log2(PER_ROOT * sqrt(pairs + 1))))
        self.weights = np.zeros((1 << self.bits, WAYS), np.float32)
        self.unit = np.float32(1)

    def __getstate__(self) -> tuple[int, np.float32, bytes]:
        """Tasks get the weights as 16-bit multiples of the least power of 2 by which no sum of a context's weights overflows.

        That is about as exact as half floats; such rows are half as long as those of
        floats, and a task's time goes into fetching rows that are in no cache.
        """
        unit = np.float32(2.0 ** ceil(log2(max(1e-3, (3 + TIED) * float(np.abs(self.weights).max())) / 32_000)))
        return self.bits, unit, pa.compress(np.rint(self.weights / unit).astype(np.int16).tobytes(), "zstd", asbytes=True)

    def __setstate__(self, state: tuple[int, np.float32, bytes]) -> None:
        self.bits, self.unit, packed = state
        self.weights = np.frombuffer(pa.decompress(packed, 2 * WAYS << self.bits, "zstd", asbytes=True), np.int16).reshape(-1, WAYS)

    @staticmethod
    def contexts(words: np.ndarray, endings: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Hashes of the features of each token's context; ``first`` are the places of the texts' first tokens."""
        place = np.arange(len(words))
        begin = np.zeros(len(words), np.int64)
        begin[first] = first
        begin = np.maximum.accumulate(begin)

        def back(x: np.ndarray, k: int) -> np.ndarray:
            """What is k places before, or beyond the text's begin the last value."""
            return np.where(place - k >= begin, x[np.maximum(place - k, 0)], x[-1])

        endings = np.append(endings, _START)
        near = [back(np.append(words, _START), 1), *(back(mix(endings + np.uint64(k)), k) for k in (1, 2))]
        tied = mix(endings + np.uint64(3))
        return near + [back(tied, k) for k in range(3, 3 + TIED)]

    def levels(self, v: Vocabulary, leaves: np.ndarray, contexts: list[np.ndarray]):
        """From the leaves up: which tokens, their branches, rows of weights, and logits of all branches."""
        at, child, inner, root = np.arange(len(leaves)), leaves, len(v.parent) - len(v.log), len(v.parent) - 1
        mixed = [(x ^ x >> np.uint64(29)) * _OF_CONTEXT for x in contexts]
        shift = np.uint64(64 - self.bits)
        while len(at):
            node = v.parent[child]
            own = (node - inner).astype(np.uint64) * _OF_NODE
            logits, rows = v.log.take(node - inner, axis=0), []
            sums = np.zeros(logits.shape, self.weights.dtype)
            met = np.empty_like(sums)
            for x in mixed:
                row = x.take(at)
                row += own
                row >>= shift
                rows.append(row.view(np.int64))  # as numpy's indices are, so none is converted
                sums += self.weights.take(rows[-1], axis=0, out=met, mode="clip")
            logits += sums * self.unit
            yield at, v.branch[child], rows, logits
            on = node != root
            at, child = at[on], node[on]

    def logs(self, v: Vocabulary, leaves: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """Log chances of the leaves."""
        out = np.zeros(len(leaves))
        for at, branch, _, logits in self.levels(v, leaves, contexts):
            taken = logits[np.arange(len(at)), branch]
            out[at] += taken - np.log(np.exp(logits, out=logits) @ _UP_TO[:, -1])
        return out

    def update(self, block: int, sums: bytes, prior: float) -> None:
        """One step for a block of rows against the gradient, scaled by the variance of a weight's outcome and ``prior``."""
        gradient, expected = np.frombuffer(sums, np.float32).reshape(2, BLOCK, WAYS)
        spread = expected * (1 - expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-6))
        self.weights[block * BLOCK : (block + 1) * BLOCK] -= np.clip(RATE * gradient / (spread + prior), -1, 1)


def _gradient(vocabulary, model):
    """Blocks of a task's gradients and drawn numbers by branch, as packed half floats of 1/64 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocabulary.value, model.value
        size, rng = m.weights.size, np.random.default_rng(7)  # the same draws if the task runs again
        counts = np.zeros(2 * size, np.float32)  # of each weight, taken and drawn side by side, as both are counted in turn
        one = np.float32(1)

        def count(keys: np.ndarray, branch: np.ndarray, drawn: np.ndarray) -> None:
            for low in range(0, len(keys), KEYS):
                part = slice(low, low + KEYS)
                np.add.at(counts, keys[part] + branch[part], one)
                np.add.at(counts, keys[part] + drawn[part], one)

        for batch in batches:
            texts = [x.lower() for x in encoded(batch.column("text"))]
            for start, end in chunks(texts, 1 << 17):
                leaves, first, tokens, _ = _with_ends(v, texts[start:end])
                for _, branch, rows, logits in m.levels(v, leaves, m.contexts(*tokens, first)):
                    below = np.exp(logits, out=logits) @ _UP_TO  # the sums of the first chances
                    draw = rng.random(len(branch), np.float32) * below[:, -1]
                    drawn = np.minimum(_trues(below < draw[:, None]), WAYS - 1)
                    branch, drawn = 2 * branch.astype(np.int64), 2 * drawn.astype(np.int64) + 1
                    for row in rows:
                        row *= 2 * WAYS
                        count(row, branch, drawn)
        found, expected = (counts[i::2].reshape(-1, BLOCK, WAYS) for i in (0, 1))
        both = np.stack([expected - found, expected], axis=1)
        del counts, found, expected
        used = np.flatnonzero(both.any(axis=(1, 2, 3)))
        for i in range(0, len(used), 256):
            some = used[i : i + 256]
            scaled = np.clip(both[some] / 64, -65_000, 65_000)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_packed(x) for x in scaled], pa.binary())], ["block", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each block's half floats, as floats."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            part = _unpacked(part, 2 * BLOCK * WAYS) * 64
            sums[block] = sums[block] + part if block in sums else part
    for block, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "sums"])


def _with_ends(v: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple]:
    """Leaves of all tokens with each text's end, where texts begin, the tokens' hashes and endings, and the words behind them."""
    spans = word_spans(texts)
    words, shapes, bounds = _tokens(*spans)
    leaves = np.insert(v.leaves(words, shapes), bounds[1:], v.end)
    return leaves, bounds[:-1] + np.arange(len(texts)), (np.insert(words, bounds[1:], _START), np.insert(_endings(*spans[:3]), bounds[1:], _START)), (words, shapes, bounds)


def train_model(train: DataFrame, vocabulary, model: MaxEnt) -> None:
    """STEPS updates and more for large corpora, each over one slice of the training documents."""
    context = train.sparkSession.sparkContext
    steps = STEPS + max(0, int(log2(max(1, vocabulary.value.total) / 1e6) / 2))
    slices, tasks, schema = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)), context.defaultParallelism, "block int, sums binary"
    prior = PRIOR * sqrt(1 + 3 * vocabulary.value.total / steps / len(model.weights))
    for step in range(steps):
        sent = context.broadcast(model)
        rows = train.where(slices == step).select("text").coalesce(tasks).mapInArrow(_gradient(vocabulary, sent), schema)
        found = rows.repartition(tasks, "block").mapInArrow(_added, schema).toArrow()  # the size of the weights twice at most
        for block, sums in zip(found["block"], found["sums"]):
            model.update(block.as_py(), sums.as_py(), prior)
        sent.destroy()  # the step's sums are here, so no task can ask for it again


def _rare(words: np.ndarray, document: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many different words each document has, these document by document, and how often each occurs there."""
    order = np.lexsort((words, document))
    words, document = words[order], document[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), (words[1:] != words[:-1]) | (document[1:] != document[:-1])]))
    times = np.diff(np.append(first, len(words)))
    return np.bincount(document[first], minlength=documents), words[first].view(np.int64), times.astype(np.int32)


def _scored(vocabulary, model):
    names = ["doc_id", "h", "held_out", "n_tokens", "known", "base", "score", "cold", "cold_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        base_least = np.log10(v.total + 0.5 * (v.distinct + 1))
        shape_least = np.log10(v.shape_total + 0.5 * (v.shape_distinct + 1))
        for batch in batches:
            texts = [x.lower() for x in encoded(batch.column("text"))]
            parts = []
            for start, end in chunks(texts, 1 << 17):
                leaves, first, tokens, (words, shapes, bounds) = _with_ends(v, texts[start:end])
                log = model.value.logs(v, leaves, MaxEnt.contexts(*tokens, first)) / np.log(10)
                count = np.diff(bounds)
                own_leaf = np.delete(leaves, bounds[1:] + np.arange(len(count)))
                known = own_leaf < v.end
                value = np.zeros(len(words))
                value[known] = np.log10(v.counts[own_leaf[known]] + 0.5)
                own = np.where(known, 0.0, -shape_least[shapes])
                document = np.repeat(np.arange(len(count)), count)
                sums = lambda x: np.bincount(document, weights=x, minlength=len(count))  # noqa: B023, E731
                base = sums(value) + np.log10(v.ends + 0.5) - (count + 1) * base_least
                score = np.add.reduceat(log, first) + sums(own)
                parts.append((count + 1, sums(known) + (v.ends > 0), base, score, *_rare(words[~known], document[~known], len(count))))
            if not parts:
                continue
            whole = [np.concatenate([x[i] for x in parts]) for i in range(7)]
            at = pa.array(np.concatenate([[0], np.cumsum(whole[4])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in whole[5:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), batch.column("held_out"), pa.array(whole[0].astype(np.int64)), pa.array(whole[1].astype(np.int64)), pa.array(whole[2]), pa.array(whole[3]), *lists],
                names,
            )

    return run


def lm_report(docs: DataFrame) -> DataFrame:
    """Per document: held_out, counts of tokens, the unigram base score and the model's score."""
    context = docs.sparkSession.sparkContext
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("h"), held(F.col("doc_id"), 5, 1).alias("held_out"))
    train = keyed.where("not held_out")
    counted, rest = count_words(train)
    model = MaxEnt(counted.pairs)
    vocabulary = context.broadcast(counted)
    train_model(train, vocabulary, model)
    schema = "doc_id long, h long, held_out boolean, n_tokens long, known long, base double, score double, cold array<long>, cold_n array<int>"
    rows = saved(keyed.mapInArrow(_scored(vocabulary, context.broadcast(model)), schema), "scored")
    rare = rows.where("size(cold) > 0").select("doc_id", "h", F.explode(F.arrays_zip("cold", "cold_n")).alias("x"))
    rare = rare.select(F.col("x.cold").alias("w"), F.col("x.cold_n").alias("times"), F.col("doc_id").alias("__d"), F.col("h").alias("__h"))
    met = rare.join(rest, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("__value")
    # equal rows each bring their words, so their sums are shared out among them
    sums = met.groupBy("__d", "__h").agg(value, F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("__known"), F.sum("times").alias("__times"))
    own = F.coalesce(F.aggregate("cold_n", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    out = rows.join(sums, rows["doc_id"].eqNullSafe(sums["__d"]) & (rows["h"] == sums["__h"]), "left").withColumn("__part", F.coalesce(own / F.col("__times"), F.lit(0.0)))
    more = F.coalesce(F.col("__value") * F.col("__part"), F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.round(F.col("__known") * F.col("__part")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(counted.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
