"""N-gram Jaccard self-join by prefix filters under several global token orders.

Two sets with Jaccard similarity of t or more share a token among the first
``n - ceil(t * n) + 1`` of each, whatever one global order of tokens both are
sorted by.  Here three orders are used.  All put frequent shingles last (by a
table of frequent shingles that only guides the order and never the result) and
shuffle the rest by different hashes.  The first order gives posting lists; a
candidate pair must also share a prefix token under the other two, and enough of
them, before its whole sets are compared.

The table is of one size, so the larger the input, the more shingles that it does
not hold come again and again.  Of the shingles that the first order's hash puts
first, more than prefixes need, all that COMMON documents or more have are found;
the first order puts them (by a bitmap) behind those that fewer have, so that
posting lists stay short.

Documents with equal sets form a class and are joined as one.  Posting lists are
not expanded into pairs.  In rounds, each member of a list meets two pivots of
its list; links are merged into components; a list whose members are all in one
component is done.  What the rounds leave (members of one list in different
components whose pairs have not been compared) is compared pair by pair, so no
link between components is lost.

Shingles and classes are known by 64-bit hashes.  Null or wordless texts have an
empty set and are linked with nothing.  Rows that agree in all columns are
copies; a null doc_id is never the smallest of a component unless all are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm.common import HOT_SHARE, SMALL, Bits, columns_of, free_names, fresh_path, join_counts, kept, near, passing, saved, text_key, written
from weftwork.llm.text import chunks, digest, encoded, lean, mix, shingles, word_hashes

#: Shingles in the table of frequent ones, at most; it guides the orders only.
FREQUENT = 500_000
#: A shingle counts as frequent from so many documents of a block of BLOCK shingles.
LOCAL, BLOCK = 2, 2_000_000
#: A shingle is put back from so many documents on; looked at are TESTED times the share of a set that its prefix is,
#: in PIECES groups by hash.
COMMON, TESTED, PIECES = 4, 1.75, 1024
#: Edges that a task contracts to stars at once (two numbers each).
EDGES = 250_000
#: Pivot rounds before the remaining pairs are compared one by one.
ROUNDS = 1
#: Lists of at most so many members are then compared pair by pair; in longer ones,
#: blocks of about MEMBERS members or SHINGLES shingles by products of incidence matrices, COLUMNS shingles at a time.
SHORT, MEMBERS, SHINGLES, COLUMNS = 32, 1024, 1 << 21, 4096


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles."""
    words, bounds = word_hashes(texts)
    runs, to = shingles(words, bounds, k)
    for i in range(len(texts)):
        yield np.unique(runs[to[i] : to[i + 1]])


def _each_set(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for low in range(0, batch.num_rows, 512):
        texts = [x.lower() for x in encoded(batch.column("text").slice(low, 512))]
        for start, end in chunks(texts):
            yield from enumerate(_sets(texts[start:end], k), low + start)


def _first(tokens: np.ndarray) -> np.ndarray:
    """The 58-bit hashes by which the first order shuffles shingles."""
    return mix(tokens ^ np.uint64(0x1F3D5B79)) >> np.uint64(6)


def _below(num: int, den: int) -> int:
    """Shingles whose first hash is below it are looked at: are they common?"""
    return int(min(1, TESTED * (den - num) / den) * (1 << 58))


def _pieces(tokens: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sorted shingles by their first bits: the pieces that have some, and the next 32 bits of each one's."""
    piece = (tokens // np.uint64(2**64 // PIECES)).astype(np.int64)
    kinds, at = np.unique(piece, return_index=True)
    rest = (tokens * np.uint64(PIECES) >> np.uint64(32)).astype(np.uint32)
    bounds = np.append(at, len(tokens)).astype(np.int32) * 4
    return kinds, pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(rest)])


def _common(table: pa.Table) -> pa.Table:
    """The shingles of a piece (all bits but the last) that come COMMON times or more."""
    rest, counts = np.unique(np.frombuffer(b"".join(table["b"].to_pylist()), np.uint32), return_counts=True)
    rest = rest[counts >= COMMON].astype(np.uint64)
    tokens = np.uint64(table["c"][0].as_py() * (2**64 // PIECES)) + (rest << np.uint64(32)) // np.uint64(PIECES)
    return pa.table({"t": pa.array(tokens.view(np.int64))})


def _survey(k: int, below: int):
    """Rows of documents (kind 0: doc_id, text key, class, size), of locally frequent shingles (kind 1) and of the pieces of those below ``below`` (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "h", "c", "n", "b"]
        block: list[np.ndarray] = []
        size = 0

        def row(kind: int, c: np.ndarray, n: pa.Array, b: pa.Array) -> pa.RecordBatch:
            none = pa.nulls(len(c), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), none, none, pa.array(c), n, b], names)

        def told() -> Iterator[pa.RecordBatch]:
            tokens, counts = np.unique(np.concatenate(block), return_counts=True)
            block.clear()
            often = counts >= LOCAL
            yield row(1, tokens[often].view(np.int64), pa.array(counts[often].astype(np.int64)), pa.nulls(int(often.sum()), pa.binary()))
            tested = _first(tokens) < np.uint64(below)
            pieces, b = _pieces(np.repeat(tokens[tested], np.minimum(counts[tested], COMMON)))
            yield row(2, pieces, pa.nulls(len(pieces), pa.int64()), b)

        for batch in batches:
            classes, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, tokens in _each_set(batch, k):
                classes[i], sizes[i] = digest(tokens), len(tokens)
                block.append(tokens)
                size += len(tokens)
                if size >= BLOCK:
                    yield from told()
                    size = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("doc_id"), batch.column("h"), pa.array(classes), pa.array(sizes), pa.nulls(batch.num_rows, pa.binary())], names)
        if block:
            yield from told()

    return run


class Orders:
    """Global orders of shingles: rarer levels first, then by hash.

    In the first order the lowest level is of shingles found not to be common,
    the next of those not looked at, then of common ones, then those of the table.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, num: int, den: int, common: Bits):
        by = np.argsort(tokens)
        self.tokens = tokens[by]
        self.levels = (np.log2(counts[by]).astype(np.uint64)) if len(tokens) else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.num, self.den = num, den
        self.common, self.below = common, np.uint64(_below(num, den))

    def prefixes(self, tokens: np.ndarray, orders: range) -> list[np.ndarray]:
        """The prefix of a set under each order."""
        n = len(tokens)
        length = n - -(-self.num * n // self.den) + 1
        level = np.zeros(n, np.uint64)
        maybe = np.flatnonzero(self.seen[(tokens & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            known = self.tokens[at] == tokens[maybe]
            level[maybe[known]] = self.levels[at[known]]
        out = []
        for order in orders:
            if order:
                rank = level << np.uint64(58) | mix(tokens ^ np.uint64(0x1F3D5B79 * (order + 1))) >> np.uint64(6)
            else:
                rank = _first(tokens)
                place = np.ones(n, np.uint64)
                tested = np.flatnonzero(rank < self.below)
                place[tested] = self.common.has(tokens[tested]) * np.uint64(2)
                rank |= np.where(level > 0, level + np.uint64(2), place) << np.uint64(58)
            out.append(tokens[np.argpartition(rank, length - 1)[:length]] if length < n else tokens)
        return out


def _postings(orders, k: int):
    """Rows (shingle, class) of each class's prefix under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            tokens_out, classes_out = [], []
            for _, tokens in _each_set(batch, k):
                if len(tokens) and (c := digest(tokens)) not in met:
                    met.add(c)
                    (prefix,) = orders.value.prefixes(tokens, range(1))
                    tokens_out.append(prefix)
                    classes_out.append(np.full(len(prefix), c))
            if tokens_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens_out).view(np.int64)), pa.array(np.concatenate(classes_out))], ["t", "c"])

    return run


def _filters(orders, k: int):
    """Rows of a class: its size and, as 16-bit hashes, its prefixes under the second and third order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, tokens in _each_set(batch, k):
                prefixes = orders.value.prefixes(tokens, range(1, 3))
                rows.append((digest(tokens), len(tokens), *(np.unique(x >> np.uint64(48)).astype(np.uint16).view(np.int16) for x in prefixes)))
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int16())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["c", "n", "p2", "p3"])

    return run


def _whole(k: int):
    """Rows of a class: its whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(digest(tokens), tokens.view(np.int64)) for _, tokens in _each_set(batch, k)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], ["c", "s"])

    return run


def _told(known, make: Callable):
    """What ``make`` gives for the documents whose key x the bitmap has, a row each, with doc_id and h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(known.value.has(batch.column("x").to_numpy().view(np.uint64))))
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                for made in make(iter([part])):
                    yield pa.RecordBatch.from_arrays([*made.columns, part.column("doc_id"), part.column("h")], [*made.schema.names, "doc_id", "h"])

    return run


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the smallest of each component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        for end in (x, y):
            np.minimum.at(root, root[end], low)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v), EDGES of them at a time, as stars around the smallest nodes."""
    block: list[pa.RecordBatch] = []

    def told() -> pa.RecordBatch:
        table = pa.Table.from_batches(block)
        u, v = _roots(table["u"].to_numpy(), table["v"].to_numpy())
        block.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    size = 0
    for batch in batches:
        for low in range(0, batch.num_rows, EDGES):
            part = batch.slice(low, EDGES)
            if block and size + part.num_rows > EDGES:
                yield told()
                size = 0
            block.append(part)
            size += part.num_rows
    if block:
        yield told()


def components(links: DataFrame) -> DataFrame:
    """(c, comp): every node of ``links`` (a, b) with the smallest node it reaches.

    In each round tasks contract blocks of EDGES edges to stars.  One block's stars
    are the components; with more blocks a large-star and a small-star step follow,
    until nothing changes.  Each round is written to the shared folder.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").mapInArrow(lean(_contracted), "u long, v long"), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if now == before:
            break
        before = now
        if now[0] <= EDGES:
            edges = edges.coalesce(1).mapInArrow(lean(_contracted), "u long, v long")  # one block
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        edges = saved(small.mapInArrow(lean(_contracted), "u long, v long"), "edges")
    pairs = edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "c")
    return saved(pairs.unionByName(pairs.select(F.col("comp").alias("c"), "comp").distinct()), "components")


def _spanning(table: pa.Table, num: int, den: int, may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pa.Table:
    """Links that span the components among the sets of two blocks (or of one).

    ``may`` tells of the rows on the left and on the right which pairs to compare.
    """
    names, sizes = table["c"].to_numpy(), table["n"].to_numpy()
    lists = table["s"].combine_chunks()
    tokens, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(names)), sizes)
    kinds, token = np.unique(tokens, return_inverse=True)
    shared = np.bincount(token) > 1
    column = np.cumsum(shared) - 1
    keep = shared[token]
    right = np.flatnonzero(table["right"].to_numpy(zero_copy_only=False))
    left = np.setdiff1d(np.arange(len(names)), right) if len(right) else np.arange(len(names))
    right = right if len(right) else left
    wanted = may(left, right) if may else None
    if wanted is not None and not wanted.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    inter = np.zeros((len(left), len(right)), np.float32)
    own_column, own_row = column[token[keep]], owner[keep]
    by = np.argsort(own_column, kind="stable")
    own_column, own_row = own_column[by], own_row[by]
    for low in range(0, int(shared.sum()), COLUMNS):  # a slice of the shared tokens at a time
        x, y = np.searchsorted(own_column, [low, low + COLUMNS])
        matrix = np.zeros((len(names), COLUMNS), np.float32)
        matrix[own_row[x:y], own_column[x:y] - low] = 1
        inter += matrix[left] @ matrix[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    near_by = den * inter >= num * union
    if wanted is not None:
        near_by &= wanted
    label = np.arange(len(names))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in zip(*np.nonzero(near_by)):
        x, y = root(left[i]), root(right[j])
        if x != y:
            label[x] = y
            out.append((names[left[i]], names[right[j]]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


class JaccardJoin:
    """Links and components of a table of texts; see the module's text."""

    def __init__(self, docs: DataFrame, k: int = 4, num: int = 85, den: int = 100):
        self.spark: SparkSession = docs.sparkSession
        self.k, self.num, self.den = k, num, den
        self.docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("h"))
        rows, frequent = fresh_path(self.spark, "rows"), fresh_path(self.spark, "frequent")
        with passing(self.spark):
            schema = "kind int, doc_id long, h long, c long, n long, b binary"
            survey = saved(self.docs.mapInArrow(lean(_survey(k, _below(num, den))), schema), "survey")
            self.rows = written(survey.where("kind = 0").drop("kind", "b"), rows)
            top = survey.where("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(FREQUENT)
            self.frequent = written(top, frequent)
            common = Bits(saved(survey.where("kind = 2").select("c", "b").groupBy("c").applyInArrow(_common, "t long"), "common"), "t", each=8)
        top = self.frequent.toArrow()  # FREQUENT rows at most
        orders = Orders(top["c"].to_numpy().view(np.uint64), top["n"].to_numpy(), num, den, common)
        self.orders = self.spark.sparkContext.broadcast(orders)
        self.links = self._linked()

    def _lists(self) -> DataFrame:
        """(t, c): the posting lists of two classes or more."""
        postings = saved(self.docs.mapInArrow(lean(_postings(self.orders, self.k)), "t long, c long"), "postings")
        # lists with more than 1/HOT_SHARE of all rows: of frequent shingles, so the table of those has them
        limit = max(1, postings.count() // HOT_SHARE)
        hot = F.broadcast(self.frequent.where(F.col("n") > limit).select(F.col("c").alias("t")))
        by_list = Window.partitionBy("t")
        cold = postings.join(hot, "t", "left_anti").select("t", "c", F.min("c").over(by_list).alias("lo"), F.max("c").over(by_list).alias("hi"))
        lists = postings.join(hot, "t", "left_semi").groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        rows = cold.unionByName(postings.join(F.broadcast(lists), "t"))
        return rows.where("lo < hi").select("t", "c")

    def _filters(self) -> DataFrame:
        """What is known of each class in a list before whole sets are compared."""
        return self._of_classes(_filters(self.orders, self.k), self.chosen, "c long, n long, p2 array<smallint>, p3 array<smallint>")

    def _linked(self) -> DataFrame:
        self.shared = kept(self.spark, self._lists, "shared")
        wanted = saved(self.shared.select("c").distinct(), "wanted")
        chosen = self.rows.join(near(wanted), "c", "left_semi").groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("x"))
        #: One document of each class in a posting list of two or more.
        self.chosen = saved(chosen.select("c", "x.doc_id", "x.h"), "chosen")
        self.filters = saved(self._filters(), "filters")
        tested = links = labels = None
        size = self.shared.count()
        for step in range(ROUNDS + 1):
            rows = self.shared
            if labels is not None:
                rows = rows.join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
            else:
                rows = rows.withColumn("comp", F.col("c"))
            open_lists = rows.groupBy("t").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), *self._pivots(step)).where("x < y").drop("x", "y")
            open_lists = saved(open_lists, "open")
            if open_lists.isEmpty():
                break
            met = join_counts(rows, open_lists, ["t"], "m", size)
            if step < ROUNDS:
                pairs = met.select("c", "comp", F.explode(F.array("p", "q")).alias("z")).select("c", "comp", F.col("z.c").alias("d"), F.col("z.comp").alias("dcomp"))
            else:
                met = saved(met.select("t", "c", "comp", "m", "lo"), "residual")
                long = kept(self.spark, lambda rows=met.where(F.col("m") > SHORT): self._compared_in_blocks(rows), "block-links")
                links = long if links is None else links.unionByName(long)
                short = met.where(F.col("m") <= SHORT).groupBy("t").agg(F.collect_list(F.struct("c", "comp")).alias("all"))
                pairs = short.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("z")).where("x.c < z.c").select(F.col("x.c").alias("c"), F.col("x.comp").alias("comp"), F.col("z.c").alias("d"), F.col("z.comp").alias("dcomp"))
            pairs = pairs.where("comp <> dcomp").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = saved(pairs, "pairs")
            found = kept(self.spark, lambda: self._verified(pairs), "links")  # noqa: B023
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        self.labels = labels
        return links

    def _compared_in_blocks(self, rows: DataFrame) -> DataFrame:
        """Links among the members of long lists that the pivots left open.

        Lists that share members form a group.  Its members are dealt to blocks of
        about MEMBERS members or SHINGLES shingles: a component that fills half a
        block has blocks of its own, the others share blocks, each component in one.
        A task compares two blocks by one product of their incidence matrices; no
        task has two blocks of one component.  It returns links that span what it
        found, not pairs.
        """
        groups = components(rows.select(F.col("c").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct()).withColumnRenamed("comp", "g")
        members = saved(groups.join(rows.select("c", "comp").distinct(), "c").join(self.filters.select("c", "n"), "c"), "members")
        load = F.greatest(F.count(F.lit(1)) / MEMBERS, F.sum("n") / SHINGLES)
        count = members.count()
        own = members.groupBy("g", "comp").agg(load.alias("load"), F.count(F.lit(1)).alias("m"))
        own = saved(own.withColumn("alone", F.col("load") > 0.5), "component-loads")
        pooled = own.where("not alone").groupBy("g").agg(F.ceil(F.sum("load")).cast("int").alias("pools"), F.sum("m").alias("m"))
        # a block is known by its group, a name and a number
        alone = join_counts(members, own.where("alone"), ["g", "comp"], "m", count).select("c", "n", "g", F.col("comp").alias("of"), F.pmod(F.xxhash64("c"), F.ceil("load")).cast("int").alias("i"))
        rest = join_counts(members, own.where("not alone").select("g", "comp", "m"), ["g", "comp"], "m", count).drop("m")
        rest = join_counts(rest, saved(pooled, "pools"), ["g"], "m", count).select("c", "n", "g", F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("comp"), F.col("pools")).cast("int").alias("i"))
        dealt = saved(alone.unionByName(rest), "dealt")
        blocks = saved(dealt.groupBy("g", "of", "i").agg(F.count(F.lit(1)).alias("m")), "blocks")
        left, right = (blocks.select("g", F.struct(F.col("of").isNull().alias("pool"), "of", "i").alias(x), F.col("m").alias(f"m_{x}")) for x in ("x", "y"))
        pairs = left.join(right, "g").where("x <= y and (x.pool or not x.of <=> y.of)")
        pairs = pairs.select(F.xxhash64("g", "x", "y").alias("task"), F.col("g").alias("bg"), "x", F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))
        pairs = saved(pairs.select("task", "bg", "b", (F.col("b") > F.col("x")).alias("right")), "block-pairs")
        met = dealt.join(pairs, (F.col("g") == F.col("bg")) & F.col("of").eqNullSafe(F.col("b.of")) & (F.col("i") == F.col("b.i")))
        sets = met.select("task", "right", "c", "n").join(self._block_sets(dealt.select("c").distinct()), "c")
        return sets.groupBy("task").applyInArrow(self._comparison(), "a long, b long")

    def _block_sets(self, classes: DataFrame) -> DataFrame:
        """(c, s) for the comparison of blocks."""
        return self._sets(classes)

    def _comparison(self):
        num, den = self.num, self.den
        return lambda table: _spanning(table, num, den)

    @staticmethod
    def _pivots(step: int) -> list:
        by = F.xxhash64("c", F.lit(step))
        one = F.struct(by.alias("o"), "c", "comp")
        return [F.min(one).alias("p"), F.max(one).alias("q")]

    def _of_classes(self, make: Callable, chosen: DataFrame, schema: str) -> DataFrame:
        """What ``make`` gives for the documents that stand for classes; no text is shuffled.

        Where the keys of ``chosen`` are too many for a broadcast a bitmap tells the
        documents, and what it says yes to by chance goes once it is made.
        """
        same_row = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.h") == F.col("k.h"))
        if chosen.count() <= SMALL:
            return self.docs.alias("d").join(F.broadcast(chosen).alias("k"), same_row, "left_semi").mapInArrow(lean(make), schema)
        key = F.xxhash64("doc_id", "h").alias("x")
        known = self.spark.sparkContext.broadcast(Bits(chosen.select(key), "x"))
        made = self.docs.select("*", key).mapInArrow(lean(_told(known, make)), f"{schema}, doc_id long, h long")
        return made.alias("d").join(chosen.alias("k").hint("shuffle_hash"), same_row & (F.col("d.c") == F.col("k.c")), "left_semi").drop("doc_id", "h")

    def _sets(self, classes: DataFrame) -> DataFrame:
        """The whole sets of classes, from the documents that stand for them."""
        chosen = self.chosen.join(near(saved(classes, "classes")), "c", "left_semi")
        return saved(self._of_classes(_whole(self.k), saved(chosen, "chosen"), "c long, s array<long>"), "sets")

    def _may_link(self, one: str, two: str) -> Column:
        """Whether two prefixes of one order share enough.

        Of the two sets, the one whose prefix ends first has no unshared prefix
        token in the other, so the sets share at most its size less those tokens.
        Equal hashes of different tokens only raise what is shared.
        """
        shared = F.size(F.array_intersect(one, two))
        most = F.greatest(F.col("n1") - F.size(one), F.col("n2") - F.size(two)) + shared
        return (shared > 0) & ((self.num + self.den) * most >= self.num * (F.col("n1") + F.col("n2")))

    def _passed(self, pairs: DataFrame) -> DataFrame:
        """(a, b, n1, n2): the pairs that the other orders let pass."""
        f = self.filters
        x = f.select(F.col("c").alias("a"), F.col("n").alias("n1"), F.col("p2").alias("p21"), F.col("p3").alias("p31"))
        y = f.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("p2").alias("p22"), F.col("p3").alias("p32"))
        passed = pairs.join(x, "a").join(y, "b").where(self._may_link("p21", "p22") & self._may_link("p31", "p32"))
        return passed.select("a", "b", "n1", "n2")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the size filter, the filters before whole sets and the comparison."""
        sizes = self.filters.select("c", "n")
        fit = pairs.join(sizes.select(F.col("c").alias("a"), F.col("n").alias("m1")), "a").join(sizes.select(F.col("c").alias("b"), F.col("n").alias("m2")), "b")
        fit = fit.where(self.den * F.least("m1", "m2") >= self.num * F.greatest("m1", "m2")).select("a", "b")
        passed = saved(self._passed(fit), "passed")
        sets = self._sets(passed.select(F.explode(F.array("a", "b")).alias("c")).distinct())
        both = passed.join(sets.select(F.col("c").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("s2")), "b")
        inter = F.size(F.array_intersect("s1", "s2"))
        return both.where(self.den * inter >= self.num * (F.col("n1") + F.col("n2") - inter)).select("a", "b")

    def _labelled(self) -> DataFrame:
        if self.labels is None:
            return self.rows.withColumn("comp", F.col("c"))
        return self.rows.join(near(self.labels), "c", "left").withColumn("comp", F.coalesce("comp", "c"))

    def representatives(self) -> DataFrame:
        """(doc_id, h, copies) of the document that stays for each component.

        It has the smallest doc_id; ``copies`` counts rows equal in doc_id and text.
        Documents with an empty set all stay.
        """
        rows = self._labelled()
        alone = rows.where("n = 0").groupBy("doc_id", "h").agg(F.lit(1).cast("long").alias("copies"))
        own = rows.where("n > 0").groupBy("comp", "doc_id", "h").agg(F.count(F.lit(1)).alias("copies"))
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
        first = own.groupBy("comp").agg(F.min_by(F.struct("doc_id", "h", "copies"), order).alias("x"))
        return first.select("x.doc_id", "x.h", "x.copies").unionByName(alone)

    def result(self) -> DataFrame:
        """Every row's doc_id, text key, set size and component (the smallest doc_id in it)."""
        rows = self._labelled()
        alone = rows.where("n = 0").select("doc_id", "h", "n", F.col("doc_id").alias("component_id"))
        rows = rows.where("n > 0")
        groups = saved(rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m")), "groups")
        size = self.rows.count()
        out = join_counts(rows, groups, ["comp"], "m", size).select("doc_id", "h", "n", "component_id")
        return out.unionByName(alone)


def jaccard_report(docs: DataFrame) -> DataFrame:
    """Per document: size of its shingle set and its component."""
    report = lambda: JaccardJoin(docs).result().select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return kept(docs.sparkSession, report, "report")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, all columns kept, whatever their names."""
    stay = kept(docs.sparkSession, lambda: JaccardJoin(docs, k, num, den).representatives(), "kept")
    d, h, copies, g = free_names(docs.columns, "__d", "__h", "__copies", "__g")
    stay = stay.select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("copies").alias(copies))
    met = docs.withColumn(g, text_key(F.col("text")))
    met = met.join(stay.hint("shuffle_hash"), met["doc_id"].eqNullSafe(stay[d]) & (met[g] == stay[h]))
    if not stay.where(F.col(copies) > 1).isEmpty():
        met = met.where(F.col(copies) == 1).unionByName(met.where(F.col(copies) > 1).dropDuplicates(["doc_id", g]))
    return met.select(*columns_of(met, docs.columns))
