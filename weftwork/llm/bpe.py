"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list of parts.  Each adjacent pair that a
merge knows sits in the bucket of its rank.  Three levels of 64-bit words tell
which buckets have entries, so the next rank is three find-first-set steps away
however long the pre-token is.  A merge changes its neighbours' pairs; their old
bucket entries stay and are skipped as stale when their bucket comes up.  The
work is about linear in the number of bytes.

Null texts are empty; an empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from weftwork.llm.common import columns_of
from weftwork.llm.text import lean

#: Pre-tokens a worker remembers in a generation, and the longest it keeps for long, in characters.
REMEMBERED, REMEMBERED_CHARS = 150_000, 60
#: Texts that are held as Python strings at once.
ROWS = 500
#: Characters of text that are encoded at once, and of new pre-tokens that are merged in one run of the queue.
AT_ONCE, MERGED = 500_000, 200_000


class RankQueue:
    """Buckets of positions by rank (below 2**18); the lowest rank comes first."""

    __slots__ = ("buckets", "low", "middle", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[group] = self.middle.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank with entries, and all of them, from left to right."""
        group = (self.top & -self.top).bit_length() - 1
        word = group << 6 | (self.middle[group] & -self.middle[group]).bit_length() - 1
        rank = word << 6 | (self.low[word] & -self.low[word]).bit_length() - 1
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.middle[group] &= self.middle[group] - 1
            if not self.middle[group]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def ascii_pattern(pattern: str) -> Callable[[str], list[str]]:
    r"""The findall of ``pattern`` for ASCII texts, by ``re`` with the classes spelled out.

    On ASCII ``re`` scans about three times as fast as ``regex`` but lacks
    ``\p{..}``, and its ``\s`` differs.  A pattern with anything else that ``re``
    lacks stays as it is.
    """

    def spelled(name: str) -> str:
        return "".join(f"\\x{i:02x}" for i in range(128) if regex.fullmatch(name, chr(i)))

    out, inside = [], False
    for token in regex.findall(r"\\[pP]\{[^}]*\}|\\.|.", pattern, flags=regex.DOTALL):
        if regex.fullmatch(r"\\p\{.*\}|\\s", token):
            out.append(spelled(token) if inside else f"[{spelled(token)}]")
        elif token == r"\S" and not inside:
            out.append(f"[^{spelled(chr(92) + 's')}]")
        elif regex.fullmatch(r"\\[pPSwWdDbB].*", token):
            return regex.compile(pattern).findall
        else:
            inside = token == "[" or inside and token != "]"
            out.append(token)
    return re.compile("".join(out)).findall


class Encoder:
    """Encodes texts to packed ids (little-endian, unsigned, 32 bits) and decodes them.

    All pre-tokens of some texts that are not remembered are merged in a few runs
    of the queue.  What is remembered has two generations: when the younger is
    full it becomes the older, and what is still used moves up again.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank_file, self.pattern = rank_file, pattern
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _lines(self) -> Iterator[tuple[bytes, int]]:
        for line in self.rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                yield base64.b64decode(token), int(rank)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return dict(self._lines())

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self._lines()}

    @cached_property
    def finders(self) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
        return regex.compile(self.pattern).findall, ascii_pattern(self.pattern)

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.finders[text.isascii()](text)

    @cached_property
    def pairs(self) -> tuple[dict[int, dict[int, int]], dict[int, dict[int, int]]]:
        """The ranks that parts merge to: of each left part by the right one, and of each right part by the left one."""
        rights: dict[int, dict[int, int]] = {}
        lefts: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    rights.setdefault(left, {})[right] = rank
                    lefts.setdefault(right, {})[left] = rank
        return rights, lefts

    @cached_property
    def byte_ids(self) -> list[int]:
        return [self.ranks[bytes([i])] for i in range(256)]

    @cached_property
    def first_pairs(self) -> np.ndarray:
        """The rank that two adjacent bytes merge to, -1 if none."""
        out = np.full((256, 256), -1, np.int64)
        for a, left in enumerate(self.byte_ids):
            ranks = self.pairs[0].get(left, {})
            out[a] = [ranks.get(right, -1) for right in self.byte_ids]
        return out

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """The ids of pre-tokens; see ``packed``."""
        return [memoryview(x).cast("I").tolist() for x in self.packed(tokens)]

    def packed(self, tokens: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens: those that are tokens, and others by merges."""
        known = list(map(self.ranks.get, tokens))
        merged = iter(self._merged([x for x, rank in zip(tokens, known) if rank is None]))
        return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in known]

    def _merged(self, tokens: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens: in each, merges by rising rank, the leftmost first.

        All lie in one linked list, with a part that pairs with nothing before and
        after each, so each is merged as if it were alone.
        """
        (rights, lefts), gone, wall, nothing = self.pairs, -1, (1 << 18) - 1, {}
        text = np.frombuffer(b" " + b" ".join(tokens) + b" ", np.uint8)
        walls = np.cumsum([0, *(len(x) + 1 for x in tokens)])
        first = np.array(self.byte_ids)[text]
        first[walls] = wall
        ranks = np.append(self.first_pairs[text[:-1], text[1:]], gone)
        ranks[walls] = gone
        ranks[walls[1:] - 1] = gone
        parts, pair, n = first.tolist(), ranks.tolist(), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        push, buckets = queue.push, queue.buckets
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        kinds, starts = np.unique(ranks[places], return_index=True)
        for rank, bucket in zip(kinds.tolist(), np.split(places, starts[1:])):
            push(rank, 0)
            buckets[rank] = bucket.tolist()
        while queue.top:
            rank, bucket = queue.pop()
            on_right, on_left = rights.get(rank, nothing).get, lefts.get(rank, nothing).get
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                right = after[j]
                left = before[i]
                parts[i] = rank
                parts[j] = pair[j] = gone
                after[i] = right
                before[right] = i
                pair[i] = found = on_right(parts[right], gone)
                pair[left] = other = on_left(parts[left], gone)
                if found >= 0:
                    if found in buckets:
                        buckets[found].append(i)
                    else:
                        push(found, i)
                if other >= 0:
                    if other in buckets:
                        buckets[other].append(left)
                    else:
                        push(other, left)
                if 0 <= found < rank or 0 <= other < rank:  # a lower rank has appeared and goes first
                    for x in bucket[k + 1 :]:
                        push(rank, x)
                    break
        final = np.array(parts)
        left = (final != gone) & (final != wall)
        ids = final[left].astype("<u4").tobytes()
        ends = (4 * np.cumsum(left)[walls]).tolist()
        return [ids[x:y] for x, y in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out, found, size = [], [], 0
        for text in texts:
            found.append(self.find(text))
            size += len(text)
            if size > AT_ONCE:
                out += self._packed(found)
                found, size = [], 0
        return out + self._packed(found)

    def _packed(self, found: list[list[str]]) -> list[bytes]:
        young, old = self.young, self.old
        new, size = [], 0
        for token in set().union(*found):
            if token not in young:
                known = old.get(token)
                if known is not None:
                    young[token] = known
                    continue
                new.append(token)
                size += len(token)
                if size > MERGED:
                    self._learn(new)
                    new, size = [], 0
        self._learn(new)
        out = [b"".join(map(young.__getitem__, tokens)) for tokens in found]
        if len(young) > REMEMBERED:
            self.old, self.young = {k: v for k, v in young.items() if len(k) <= REMEMBERED_CHARS}, {}
        return out

    def _learn(self, tokens: list[str]) -> None:
        self.young.update(zip(tokens, self.packed([x.encode() for x in tokens])))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


_encoders: dict[bytes, Encoder] = {}


def encoder_of(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker process; what it remembers lasts."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(rank_file, pattern)
    return _encoders[key]


class BytePairCodec:
    """Encodes and decodes columns with the vocabulary in ``path``.

    The file (under 1 MB for 50,000 ranks) is read on the driver and broadcast.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.file = spark.sparkContext.broadcast(file.read())
        self.pattern = pattern

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
        """``docs`` with the column ``text`` replaced by ``ids``: packed ids, 4 bytes each.

        With ``decoded`` that column has the bytes that the ids stand for; both
        are made in one worker, which holds the vocabulary once.  The other
        columns must not have these names.
        """
        file, pattern = self.file, self.pattern
        names = [x for x in docs.columns if x != text]
        made = [ids] if decoded is None else [ids, decoded]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = encoder_of(file.value, pattern)
            for whole, low in ((x, i) for x in batches for i in range(0, x.num_rows, ROWS)):
                batch = whole.slice(low, ROWS)
                packed = encoder.encode([x or "" for x in batch.column(len(names)).to_pylist()])
                columns = [packed] if decoded is None else [packed, map(encoder.decode, packed)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(x, pa.binary()) for x in columns)], [*names, *made])

        fields = [StructField(x, BinaryType()) for x in made]
        return docs.select(*columns_of(docs, names), text).mapInArrow(lean(run), StructType([*(docs.schema[x] for x in names), *fields]))

    def decode(self, ids: Column) -> Column:
        """The bytes that packed ids stand for."""
        file, pattern = self.file, self.pattern

        @F.arrow_udf("binary")
        def run(packed: pa.Array) -> pa.Array:
            encoder = encoder_of(file.value, pattern)
            parts = [pa.array([encoder.decode(x or b"") for x in packed.slice(i, ROWS).to_pylist()], pa.binary()) for i in range(0, len(packed), ROWS)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

        return run(ids)


def bpe_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, and the SHA-256 of the ids and of the decoded bytes."""
    codec = BytePairCodec(docs.sparkSession, path, pattern)
    out = codec.encode(docs.select("doc_id", "text"), decoded="decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def public_bpe_report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``bpe_report`` with the public 50k vocabulary, unless another is named."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return bpe_report(docs, path, pattern)
