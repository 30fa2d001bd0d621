"""Things the training-data operators share: the shared folder, row keys and hot keys."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.storage import fresh_path, kept, passing, saved, shared_folder, written  # noqa: F401

#: A key that holds more than one row in HOT_SHARE is hot.  By the pigeonhole
#: principle there are at most HOT_SHARE such keys, however large the input,
#: which is the bound that lets them be broadcast.
HOT_SHARE = 10_000
#: Numbers (rows of long keys, or elements of their arrays) that are broadcast at most.
SMALL = 500_000


def text_key(text: Column) -> Column:
    """With the document's id, tells documents apart even if ids repeat."""
    return F.xxhash64(text.isNull(), F.coalesce(text, F.lit("")))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once for each row, whatever the optimizer does with the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no name in ``taken`` is the same."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def columns_of(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [df[f"`{x.replace('`', '``')}`"] for x in names]


def near(keys: DataFrame, size: Column | None = None) -> DataFrame:
    """``keys``, marked for broadcast if they, or the numbers that ``size`` counts in each row, are within SMALL."""
    held = keys.count() if size is None else keys.agg(F.sum(size + 1)).first()[0] or 0
    return F.broadcast(keys) if held <= SMALL else keys


def join_counts(rows: DataFrame, counts: DataFrame, keys: list[str], size: str, all_rows: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``counts`` (one row per key, ``size`` = rows of that key).

    Hot keys are matched by a broadcast of at most HOT_SHARE keys; the other rows
    meet their key in a shuffle in which no key has more than 1/HOT_SHARE of the
    rows.  ``how`` is inner or left_semi.
    """
    limit = max(1, all_rows // HOT_SHARE)
    hot = counts.where(F.col(size) > limit)
    cold = counts.where(F.col(size) <= limit)
    hot_keys = hot.select(*keys)
    on_hot = rows.join(F.broadcast(hot), keys, how)
    on_cold = rows.join(F.broadcast(hot_keys), keys, "left_anti").join(cold, keys, how)
    return on_hot.unionByName(on_cold)


class Bits:
    """A set of 64-bit hashes as a bitmap of at most 2**``most`` bits; it may also say yes to others."""

    #: Bits that one group of the aggregate holds.
    PIECE = 32_768

    def __init__(self, hashes: DataFrame, name: str, most: int = 28, each: int = 16):
        self.bits = min(most, max(20, ceil(log2(each * hashes.count() + 1))))
        slot = F.shiftrightunsigned(name, 64 - self.bits)
        pieces = hashes.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / self.PIECE).cast("long").alias("piece")).agg(F.bitmap_construct_agg(F.col("slot") % self.PIECE).alias("bytes"))
        self.bitmap = np.zeros(1 << self.bits - 3, np.uint8)
        for r in pieces.toLocalIterator():  # 2**bits bits in all
            piece = np.frombuffer(r["bytes"], np.uint8)
            self.bitmap[r["piece"] * self.PIECE // 8 :][: len(piece)] = piece

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
