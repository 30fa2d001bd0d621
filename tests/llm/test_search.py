"""MinHash near-dedup, lexical search, collocations and the language model's chances against brute force."""

import math
import pickle
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import collocations, common, jaccard_join, lexical, maxent_lm, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def shingle_set(s, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(s))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies around one text, chains, nulls, empty, short and long texts, repeated ids and rows, no language."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdeéf", k=rng.randrange(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, base = [], text(150).split()
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):  # near the base, often not near each other
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words), "en", "a", 1))
    chain = text(120).split()
    for i in range(12):  # each near the next only
        rows.append((200 - i, " ".join(chain), "de", "a", 1))
        chain = chain[3:] + text(3).split()
    rows += [(300 + i, text(rng.randrange(1, 200)) + rng.choice([".", "! x", ""]), rng.choice(["en", "de", None, "und"]), "b", 1) for i in range(40)]
    rows += [(400 + i, "One two, three Four. " + "in the end; " * rng.randrange(1, 4) + text(5), rng.choice(["en", None]), "b", 1) for i in range(60)]
    rows += [(500, None, None, None, None), (501, "", "en", "b", 0), (502, " \n\t", "en", "b", 3), (503, text(6000), "en", "a", 1), (504, "!!! 123", "de", "a", 7), (505, "a b", "de", "a", 7), (506, "A B", "de", "a", 7), (None, "a b", "en", "a", 5), (None, "zz top", "en", "a", 5)]
    rows += [rows[3], rows[3], (3, text(60), "de", "b", 5), (507, rows[0][1].upper(), "en", "a", 2)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


def _linked(corpus, k, num, den):
    sets = [shingle_set(t, k) for _, t, *_ in corpus]
    root = list(range(len(corpus)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(corpus)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (doc_id, *_) in enumerate(corpus):
        smallest[find(i)].append(doc_id)
    return Counter((doc_id, len(sets[i]), min((x for x in smallest[find(i)] if x is not None), default=None)) for i, (doc_id, *_) in enumerate(corpus))


@pytest.mark.parametrize("short", [jaccard_join.SHORT, 1])
def test_minhash_near_dedup(docs, corpus, short, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)  # 1: all that pivots leave open goes to blocks
    monkeypatch.setattr(jaccard_join, "MEMBERS", 8)
    got = minhash.minhash_report(docs).collect()
    want = _linked(corpus, 5, 85, 100)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.JaccardJoin(docs, 5).result().select("doc_id", F.col("n").alias("n_shingles"), "component_id").collect()) == want


def test_bands_and_posterior():
    b = minhash.bands_for(0.85)
    assert (1 - 0.85**minhash.ROWS) ** b <= minhash.MISS < (1 - 0.85**minhash.ROWS) ** (b - 1)
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, least in minhash.least_matches(0.85, b * minhash.ROWS):
        for m in (least - 1, least):  # the posterior under a uniform prior, summed on a grid
            if m >= 0:
                with np.errstate(divide="ignore"):
                    log = m * np.log(grid) + (n - m) * np.log1p(-grid)
                density = np.exp(log - log.max())
                assert (density[grid > 0.85].sum() / density.sum() < minhash.MISS) == (m < least)
    assert [n for n, _ in minhash.least_matches(0.85, 40, 18)] == [18, 36, 40]


def test_signatures_estimate_similarity_and_survivors_are_a_loops():
    rng = np.random.default_rng(1)
    by = minhash._multipliers(1800)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (0, 500, 900, 1000):
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 1000 - shared).astype(np.uint64)])
        agree = (minhash.signature(a, by) == minhash.signature(b, by)).mean()
        assert abs(agree - shared / (2000 - shared)) < 0.04
    one, two = rng.integers(0, 3, (300, 36)), rng.integers(0, 3, (300, 36))
    least = [(18, 5), (36, 12)]
    assert minhash.survivors(one, two, least).tolist() == [i for i in range(300) if all((one[i, :n] == two[i, :n]).sum() >= m for n, m in least)]


def test_blocks_lose_no_link(spark, monkeypatch):
    """A star: all near one text, few near each other; and two stars that share a bucket."""
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 16)
    rng = random.Random(2)
    centre = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(centre), "en", "a", 1)]
    for i in range(1, 150):
        words = list(centre)
        for j in rng.sample(range(300), rng.choice([3, 4, 5, 6, 8])):
            words[j] = f"x{i}-{j}"
        rows.append((i, " ".join(words), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = _linked(rows, 5, 85, 100)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.minhash_report(docs).collect()) == want
    assert Counter((r.doc_id, r.n, r.component_id) for r in jaccard_join.JaccardJoin(docs, 5).result().collect()) == want


def _search(corpus, items, top):
    terms = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(s))
    found = [(d, Counter(terms(t))) for d, t, *_ in corpus]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = Counter()
    for item, text in set(items):
        scored = []
        for d, c in found:
            size, score = sum(c.values()), 0
            m = 10 + (90 * size * n) // total
            for t in set(terms(text)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored)[:top], 1):
            out[item, rank, d, -s] += 1
    return out


ITEMS = [(1, "in THE end three"), (2, None), (3, ""), (4, "nowhere-to.be found zzz"), (5, "a b"), (1, "in THE end three"), (6, "one two one two"), (7, "End. 123"), (None, "zz")]


@pytest.mark.parametrize(("window", "postings", "block"), [(1 << 15, 1 << 22, 1 << 18), (7, 1 << 22, 1 << 18), (64, 20, 3)])
def test_lexical_search(spark, docs, corpus, window, postings, block, monkeypatch):
    for name, value in (("WINDOW", window), ("POSTINGS", postings), ("BLOCK", block)):
        monkeypatch.setattr(lexical, name, value)
    words = corpus[1][1].split()
    items = [*ITEMS, (8, " ".join(words[:30]))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(7))
    got = lexical.lexical_report(docs, table).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == _search(corpus, items, 10)


def test_heaps_keep_the_best_whatever_the_order():
    rng = random.Random(5)
    block = type("B", (), {"items": np.arange(2), "terms": np.arange(3), "numbers": np.array([0, 1, 2, 2]), "bounds": np.array([0, 3, 4])})()
    for _ in range(50):
        heaps, seen = lexical.Heaps(block, 4), [[], []]
        for _ in range(rng.randrange(1, 5)):
            size = rng.randrange(1, 200)
            ids, known = np.array([rng.randrange(50) for _ in range(size)]), np.array([rng.random() < 0.9 for _ in range(size)])
            postings = [(s, t, rng.randrange(1, 4)) for s in range(size) for t in range(3) if rng.random() < 0.4]
            slot, number, impact = (np.array([p[i] for p in postings], np.int64) for i in range(3))
            heaps.window(ids, known, slot, number, impact)
            for q, mine in enumerate(((0, 1, 2), (2,))):
                scores = Counter()
                for s, t, i in postings:
                    if t in mine:
                        scores[s] += i
                seen[q] += [(-v, not known[s], ids[s] if known[s] else 0) for s, v in scores.items()]
        table = heaps.rows()
        for q in (0, 1):
            got = [(-s, d is None, d or 0) for x, d, s in zip(*(table.column(i).to_pylist() for i in range(3))) if x == q]
            assert sorted(got) == sorted(seen[q])[:4]


def test_lexical_search_of_empty_tables(spark, docs):
    none, items = docs.where("false"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.lexical_report(none, items).collect() == [] and lexical.lexical_report(docs, items.where("false")).collect() == []
    assert lexical.lexical_report(docs.where("text is null or text = ''"), items).collect() == []


def _phrases(corpus, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in corpus:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    counts[lang][tuple(w[i : i + m])] += 1
    out = set()
    for lang, c in counts.items():
        frequent = {p: n for p, n in c.items() if n >= least}
        inside = {q for p, n in frequent.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * n >= 80 * frequent[q := p[i : i + m]]}
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in inside:
                score, _, left, right = min(((2000000 * a) // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize(("held", "block", "hot", "top"), [(1 << 21, 1 << 20, 10_000, 2000), (1 << 8, 64, 10_000, 3), (1 << 12, 16, 20, 2000)])
def test_collocations(docs, corpus, held, block, hot, top, monkeypatch):
    for name, value in (("HELD", held), ("BLOCK", block), ("HOT_SHARE", hot)):  # small: counts are shipped and grown in pieces; many keys are dealt out
        monkeypatch.setattr(collocations, name, value)
    got = {tuple(r) for r in collocations.collocations(docs, top, 20).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    want = _phrases(corpus, 20, top)
    assert got == want and len(want) > 5


def test_collocations_are_exact_beyond_64_bits(spark):
    both = spark.createDataFrame([(1, 9_000_000_000_000_000, 9_000_000_000_000_001)], "k int, a long, b long")
    phrases = type("P", (), {})()
    phrases.phrases = both.select(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("ws"), F.col("a").alias("f"))
    phrases.words = both.select(F.explode(F.array(F.struct(F.lit(1).cast("long").alias("h"), F.col("a").alias("f")), F.struct(F.lit(2).cast("long").alias("h"), F.col("b").alias("f")))).alias("x")).select("x.*")
    assert [r.score for r in collocations.scored(phrases).collect()] == [2_000_000 * 9_000_000_000_000_000 // 18_000_000_000_000_001]


def test_collocations_of_awkward_tables(spark, docs):
    assert collocations.collocation_report(docs.where("false")).collect() == []
    rows = spark.createDataFrame([(1, "a b " * 40, None, 5), (2, "A\tb", "und", 6), (3, None, "xx", 7)], "doc_id long, text string, lang string, rank int")
    assert {(r.lang, r.phrase, r.a) for r in collocations.collocation_report(rows).collect()} == {("und", "a b a b", 39), ("und", "b a b a", 38)} | {("und", p, n) for p, n in ()}


def test_bits_hold_all_they_were_given(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = common.Bits(hashes, "h", most=16)
    own = hashes.toPandas()["h"].to_numpy().view(np.uint64)
    assert bits.has(own).all() and common.Bits(hashes, "h").has(own * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.2
    assert not common.Bits(hashes.where("false"), "h").has(own).any()


def test_language_model_against_brute_force():
    """Chances of all leaves by a walk over the tree, one branching and feature at a time."""
    rng = np.random.default_rng(4)
    texts = [b"the cat sat on the mat.", b"a dog, a cat", b"", b"unseen words here thing"]
    words, shapes, bounds = maxent_lm.tokens_of(texts[:2])
    kinds, counts = np.unique(words, return_counts=True)
    v = maxent_lm.Vocabulary(len(words) + 2, len(kinds) + 1, 2, 8, kinds, counts, np.full(8, 3.0), np.full(8, 2.0))
    model = maxent_lm.MaxEnt(8)
    model.weights[:] = rng.normal(0, 1, model.weights.shape)
    leaves, first, tokens, _ = maxent_lm._with_ends(v, texts)
    contexts = maxent_lm.MaxEnt.contexts(*tokens, first)
    assert len(contexts) == 3 + maxent_lm.TIED
    n, root = len(v.parent) - len(v.log), len(v.parent) - 1

    def chance(leaf, i):
        log, child = 0.0, leaf
        while child != root:
            node = int(v.parent[child])
            logits = v.log[node - n].astype(float).copy()
            for x in contexts:
                mixed = int(x[i]) ^ int(x[i]) >> 29
                key = (mixed * int(maxent_lm._FACTORS[1]) + (node - n) * int(maxent_lm._FACTORS[3])) * int(maxent_lm._FACTORS[0]) % 2**64 >> 64 - model.bits
                logits += model.weights[key]
            log += logits[v.branch[child]] - math.log(np.exp(logits).sum())
            child = node
        return log

    got = model.logs(v, leaves, contexts)
    for i in range(len(leaves)):
        assert abs(got[i] - chance(int(leaves[i]), i)) < 1e-4
        assert abs(sum(math.exp(chance(leaf, i)) for leaf in range(n)) - 1) < 1e-6


def test_tasks_score_by_weights_of_two_bytes(monkeypatch):
    """What tasks get takes half the memory of floats, never overflows, and gives the same scores; texts are split once."""
    rng, split = np.random.default_rng(6), []
    words, shapes, _ = maxent_lm.tokens_of([b"the cat sat on the mat.", b"a dog, a cat"])
    kinds, counts = np.unique(words, return_counts=True)
    v = maxent_lm.Vocabulary(len(words) + 2, len(kinds) + 1, 2, 8, kinds, counts, np.full(8, 3.0), np.full(8, 2.0))
    monkeypatch.setattr(maxent_lm, "word_spans", lambda texts, f=maxent_lm.word_spans: split.append(1) or f(texts))
    leaves, first, tokens, _ = maxent_lm._with_ends(v, [b"the cat sat on a mat. the dog, the cat", b"", b"new words"])
    assert len(split) == 1
    contexts = maxent_lm.MaxEnt.contexts(*tokens, first)
    model = maxent_lm.MaxEnt(8)
    for spread in (0, 1e-3, 0.3, 1, 7):  # updates move a weight by 1 at most
        model.weights[:] = np.clip(rng.normal(0, spread, model.weights.shape), -7, 7)
        sent = pickle.loads(pickle.dumps(model))
        assert sent.weights.itemsize == 2 and np.abs(sent.weights * sent.unit - model.weights).max() <= sent.unit / 2
        assert np.abs(sent.logs(v, leaves, contexts) - model.logs(v, leaves, contexts)).max() < 0.1 * max(spread, 1e-3)
        sent.weights = np.full_like(sent.weights, np.abs(sent.weights).max())  # all features of a context at their largest
        assert all((logits >= v.log.min() - 1e-3).all() for *_, logits in sent.levels(v, leaves, contexts))


def test_leaves_of_words():
    rng = np.random.default_rng(7)
    near = np.uint64(5) << np.uint64(60) | np.arange(0, 40, 2, dtype=np.uint64)  # all with the same first bits
    known = np.unique(np.concatenate([rng.integers(0, 2**64, 500, np.uint64), near]))
    words = np.concatenate([known, known + np.uint64(1), near, np.array([0, 2**64 - 1], np.uint64)])
    shapes = (words % np.uint64(8)).astype(np.int64)
    for own in (known, known[:1], known[:0]):
        v = maxent_lm.Vocabulary(1000, 600, 2, 8, own, np.full(len(own), 9), np.full(8, 3.0), np.full(8, 2.0))
        place = {int(w): i for i, w in enumerate(own)}
        assert v.leaves(words, shapes).tolist() == [place.get(int(w), len(own) + 1 + int(s)) for w, s in zip(words, shapes)]


def test_words_are_counted_with_their_shapes():
    texts = ["the cat. sat, the B\u00e9 the cat.", None, "", "Z9 the \u00e9, 9"]
    got = [r for b in maxent_lm._word_counts(iter([maxent_lm.pa.RecordBatch.from_arrays([maxent_lm.pa.array(texts)], ["text"])])) for r in b.to_pylist() if r["s"] >= 0]
    words, shapes, _ = maxent_lm.tokens_of([(x or "").encode().lower() for x in texts])
    assert {(r["w"], r["s"]): r["n"] for r in got} == dict(Counter(zip(words.view(np.int64).tolist(), shapes.tolist()))) and len({r["w"] for r in got}) == len(got)


def test_endings():
    same = maxent_lm.endings_of([b"walking talking, x", b"king.", b"\xc3\xa9 a."])
    assert same[0] == same[1] == same[3] != same[2] and len(same) == 6
    assert maxent_lm.endings_of([b"", b" "]).tolist() == []


def test_language_models_of_tiny_tables(spark):
    for rows in ([(0, "a", "en", "a", 1)], [(i, "a a a", "en", "a", 1) for i in range(40)], [(i, None, None, None, None) for i in range(10)], [(4, "only held out", "en", "a", 1)]):
        for r in maxent_lm.lm_report(spark.createDataFrame(rows, SCHEMA)).collect():
            assert math.isfinite(r.score) and math.isfinite(r.base_score) and r.score <= 0


def test_rare_words_of_documents_are_counted_together():
    import numpy as np

    from weftwork.llm.maxent_lm import _rare

    rng = np.random.default_rng(2)
    for size, documents in ((500, 40), (1, 3), (0, 2), (0, 0)):
        document = np.sort(rng.integers(0, max(1, documents), size))
        words = rng.integers(0, 9, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n, kinds, times = _rare(words, document, documents)
        want = [np.unique(words[document == i], return_counts=True) for i in range(documents)]
        assert n.tolist() == [len(x) for x, _ in want]
        assert kinds.tolist() == [y for x, _ in want for y in x.view(np.int64).tolist()]
        assert times.tolist() == [y for _, x in want for y in x.tolist()]
