"""The training-data operators against brute-force versions, and on awkward tables."""

import hashlib
import html as html_lib
import json
import math
import random
import re
import struct
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import bpe, decontaminate, html_main, jaccard_join, langid, line_dedup, maxent_lm, quality, span_dedup, stages, toxicity
from weftwork.llm.text import chunks, shingles, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def shingle_set(s, k):
    w = words(lower(s))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, a common line, nulls, empty and long texts, repeated ids and rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéf", k=rng.randrange(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    rows, base = [], text(120)
    for i in range(60):
        body = "\n".join(text(rng.randrange(10, 40)) for _ in range(3))
        if i % 4 == 0:
            body = "  Common LINE here \n" + body
        if i % 5 == 0:
            w = base.split()
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            body = " ".join(w)
        rows.append((i, body, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(body)))
    rows += [(100, None, None, None, None), (101, "", "en", "b", 0), (102, " \n\t", "en", "b", 3), (103, text(6000), "en", "a", 1), (104, "!!! 123", "de", "a", 7)]
    rows += [rows[3], (None, text(30), "en", "a", 5), (None, text(70), "en", "a", 5), (3, text(60), "de", "b", 5), (105, rows[0][1], "en", "a", 2)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_counter(rows):
    return Counter(tuple(r) for r in rows)


def test_hashing_of_words_and_shingles():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "c\n", "é", " "]) for _ in range(rng.randrange(12))).encode() for _ in range(200)] + [b"", b"  ", b"x" * 3_000_000]
    assert [t for a, b in chunks(texts) for t in texts[a:b]] == texts
    h, bounds = word_hashes(texts)
    s, to = shingles(h, bounds, 4)
    plain = [[tuple(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([tuple(w)] if w else []) for w in (re.findall(rb"[^ \t-\r]+", t) for t in texts)]
    assert [len(x) for x in plain] == list(np.diff(to))
    flat = [x for p in plain for x in p]
    assert len(set(zip(flat, s.tolist()))) == len(set(flat)) == len(set(s.tolist()))


def test_line_dedup(docs, corpus):
    keyed = [(i, [(line, lower(line.strip(SPACES))) for line in (t or "").split("\n")]) for i, t, *_ in corpus]
    found = Counter(k for _, lines in keyed for k in {k for _, k in lines})
    want = Counter()
    for i, lines in keyed:
        kept = [x for x, k in lines if not k or found[k] < 10]
        want[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    assert as_counter(line_dedup.line_dedup_report(docs).collect()) == want


@pytest.mark.parametrize("fanout,batches", [(2, 5), (3, 4)])
def test_line_runs_do_not_depend_on_batches(docs, fanout, batches):
    one = line_dedup.drop_common_lines(docs, batches=1).select("doc_id", "__kept").collect()
    many = line_dedup.drop_common_lines(docs, batches=batches, fanout=fanout).select("doc_id", "__kept").collect()
    assert as_counter(one) == as_counter(many)


def test_span_dedup(docs, corpus):
    rows = sorted({(i, t) for i, t, *_ in corpus}, key=lambda r: (r[0] is not None, r[0] or 0))
    places = defaultdict(list)
    cut = {r: span_dedup.units((r[1] or "").encode()) for r in rows}
    for r in rows:
        tokens = [tuple(u.lower().split()) for u in cut[r]]
        for at in range(len(tokens) - 2):
            places[tuple(tokens[at : at + 3])].append((r, at))
    gone = defaultdict(set)
    order = {}
    for span, found in places.items():
        ids = {(r[0] is not None, r[0] or 0) for r, _ in found}
        if len(found) > 1:
            order[span] = len(ids)
            first = min(found, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
            for r, at in found:
                if (r, at) != first:
                    gone[r] |= {at, at + 1, at + 2}
    got = span_dedup.drop_repeated_spans(docs).collect()
    want = Counter()
    for i, t, *_ in corpus:
        units = cut[(i, t)]
        want[(i, "".join(u.decode() for j, u in enumerate(units) if j not in gone[(i, t)]), len(units), len(gone[(i, t)]))] += 1
    assert as_counter((r.doc_id, r.text, r.n_units, r.n_dropped) for r in got) == want
    passage = " ".join(f"w{i}" for i in range(55))
    units = span_dedup.units(passage.encode())
    assert len(units) >= span_dedup.SPAN and b"".join(units) == passage.encode()


def _measures(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, corpus):
    got = quality.quality_report(docs)
    want = Counter()
    for i, t, *_ in corpus:
        m = _measures(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert as_counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == want
    assert got.where("kept and base_failed").isEmpty()


def test_quality_rejects_bad_hosts_only(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    rows = [(i, good() if i % 4 else "short", None, "bad" if i < 400 and i % 4 == 1 else "good", 1) for i in range(800)]
    rows += [(1000 + i, "short", None, "bad", 1) for i in range(900)]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[r[0]] for r in rows if r[3] == "bad" or r[1] == "short")
    assert all(got[r[0]] for r in rows if r[3] == "good" and r[1] != "short")


def test_html():
    page = """<html><head><title>T</title></head><body><div id="site-header"><h1>Site</h1></div><div class="cookie-notice">We use cookies to do things ok</div>
<main><div class="post-content"><h1>Title &amp; more</h1><p>First para with <a href=x>a link</a> in <b>bo</b>ld text and more words here to be long.</p>
<div class="ad-slot">Buy now our things please</div><ul><li>one item of list</li></ul><p>Second&nbsp;para x &lt; y.</p></div></main>
<section id="comments"><p>Reader said that something very long happened here and it goes on and on and on.</p></section><footer>foot</footer></body>"""
    assert html_main.main_text(page) == "Title & more\nFirst para with a link in bold text and more words here to be long.\none item of list\nSecond para x < y."
    assert html_main.main_text("") == "" and html_main.main_text("<nav><a>x</a></nav>") == ""
    assert html_main.main_text("<p>a<p>b " + "c " * 1000) == "a\nb " + "c " * 999 + "c"
    assert html_main.main_text("<a href='x>y <p>1 < 2") is not None


def test_html_with_mixed_names():
    long = "word " * 80 + "end."
    for open_, close in (("<main class=has-sidebar>", "</main>"), ("<div class='content with-sidebar'>", "</div>"), ("<article class='post category-legal'>", "</article>"), ("<div class='site-sidebar'>", "</div>"), ("<form id=search-form>", "</form>")):
        for title in ("entry-title", "post-title"):
            page = f"<body><nav><a>home</a> <a>other</a></nav>{open_}<h1 class={title}>The headline</h1><p>{long}</p><div class=ad-slot>buy now</div><p>{long}</p>{close}<div class='footer section'>legal words of a foot</div></body>"
            assert html_main.main_text(page) == f"The headline\n{long}\n{long}", (open_, title)


def test_html_on_tables(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>x &copy; y</p>")], "page_id long, url string, html string")
    assert as_counter(html_main.extract_main_text(pages).collect()) == Counter({(1, "u", "", 0): 2, (None, None, "x © y", 5): 1})


def test_decontamination(spark, docs, corpus):
    rng = random.Random(8)
    items = []
    for n in range(40):
        w = words(rng.choice([t for _, t, *_ in corpus if t and len(words(t)) > 30]))
        at = rng.randrange(len(w) - 20)
        piece = w[at : at + rng.randrange(6, 60)]
        if n % 3 == 0 and len(piece) > 20:
            piece[5] = "changed"
        items.append((n, " ".join(piece)))
    items += [(90, None), (91, ""), (92, "one two"), (93, items[0][1]), (None, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t, *_ in corpus:
        own = shingle_set(t, 5)
        for item, x in items:
            s = shingle_set(x, 5)
            if s and 100 * len(s & own) >= 80 * len(s):
                want[(i, item, len(s & own), len(s))] += 1
    assert as_counter(decontaminate.contamination_report(docs, benchmark).collect()) == want and want
    left = decontaminate.without_contaminated(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} & {k[0] for k in want} <= {3, None}


def test_bpe_is_what_tiktoken_makes():
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as file:
        encoder = bpe.Encoder(file.read(), public.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "ab  \n\t1'sé漢字🙂!#-_'ll\x85 　\x1c​<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", "a" * 50_000, "ab" * 20_000, " " * 30_000, "".join(rng.choice("abcde") for _ in range(40_000))]
    for text, packed in zip(texts, encoder.encode(texts)):
        ids = [x for (x,) in struct.iter_unpack("<I", packed)]
        assert ids == known.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()


def test_bpe_looks_up_merges_only():
    """Bytes that pair with nothing cost no call each."""
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as file:
        encoder = bpe.Encoder(file.read(), public.PATTERN)
    alone = [bytes([a, b]) for a in range(1, 9) for b in range(1, 9)]
    assert not any(x in encoder.ranks for x in alone)
    rng = random.Random(2)
    tokens = [b"ab", b"xq", *(bytes(rng.choices(range(1, 9), k=50)) for _ in range(400))]
    want = [[encoder.ranks[bytes([x])] for x in t] for t in tokens[2:]]
    assert encoder.merge(tokens)[2:] == want and encoder.merge([]) == []
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        encoder.merge(tokens)
    finally:
        sys.setprofile(None)
    assert calls["c_call"] < 10 * len(tokens) < sum(map(len, tokens))


def test_rank_queue():
    rng, queue, want = random.Random(0), bpe.RankQueue(), defaultdict(list)
    for _ in range(500):
        rank, place = rng.randrange(1 << 18), rng.randrange(1000)
        queue.push(rank, place)
        want[rank].append(place)
    got = []
    while queue.top:
        got.append(queue.pop())
    assert got == [(r, sorted(want[r])) for r in sorted(want)]


def test_bpe_report(spark, docs, corpus):
    pytest.importorskip("public_tokenizers")
    got = as_counter((r.doc_id, r.decoded_sha256) for r in bpe.public_bpe_report(docs).collect())
    assert got == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus)


def test_language_id(spark, docs, corpus):
    truth = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_report(truth).join(truth.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    own = {(r.doc_id, r.lang_pred, r.score) for r in langid.language_report(docs).collect()}
    assert {(100, "und", 0.0), (101, "und", 0.0), (104, "und", 0.0)} <= own and all(0 <= s <= 1 for *_, s in own)
    assert langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").isEmpty()


def test_mixtures_find_two_languages():
    counts = np.zeros((langid.BUCKETS, 2))
    texts = [b"the and of with that", b"der und mit nicht das"]
    for i, t in enumerate(texts):
        np.add.at(counts[:, i], langid._grams([t * 20])[0], 1)
    model = langid.MixtureModel(["en", "de"], counts)
    mixed, _ = model.mixtures([b" ".join(texts * 10), texts[0], b""])
    assert 0.3 < mixed[0, 0] < 0.7 and mixed[1].tolist() == [1, 0] and mixed[2].tolist() == [0, 0]


def _mixture(text, grams, langs):
    """Proportions of the selected languages, in plain loops over all words."""
    words_, size = text.lower().split(), len(langs)
    total = {x: sum(grams[x].values()) + 0.1 * langid.BUCKETS for x in langs}

    def log(word, lang):
        spaced = b" " + word + b" "
        codes = [spaced[i] | spaced[i + 1] << 8 | spaced[i + 2] << 16 for i in range(len(word))]
        return sum(math.log((grams[lang][(c * 0x9E3779B1 % 2**32) >> 17] + 0.1) / total[lang]) for c in codes)

    logs = [[log(w, x) for x in langs] for w in words_]
    like = [[math.exp(max(x - max(row), -30)) for x in row] for row in logs]

    def fitted(share):
        for _ in range(langid.STEPS):
            parts = [[a * b for a, b in zip(row, share)] for row in like]
            share = [sum(p[i] / sum(p) for p in parts) / len(parts) for i in range(size)]
        return share

    share = fitted([1 / size] * size)
    order = sorted(range(size), key=lambda i: -share[i])
    best, chosen = -math.inf, None
    for k in range(1, size + 1):
        start = [max(share[i], 1e-6) if i in order[:k] else 0.0 for i in range(size)]
        start = [x / sum(start) for x in start]
        own = fitted(start) if k > 1 else start
        score = sum(math.log(sum(a * b for a, b in zip(row, own)) + 1e-300) for row in like) + sum(map(max, logs)) - langid.PENALTY * (k - 1) * math.log(len(words_) + 1)
        if score <= best:
            break
        best, chosen = score, own
    return chosen


LANGUAGES = {"en": b"the and of with that", "de": b"der und mit nicht das", "fr": b"les des est dans pour", "fi": b"ja on oli mutta kuin", "pl": b"nie jest przez czy tylko"}


def _small_model():
    langs = list(LANGUAGES)
    grams = {x: Counter(langid._grams([t * 20])[0].tolist()) for x, t in LANGUAGES.items()}
    counts = np.zeros((langid.BUCKETS, len(langs)))
    for i, x in enumerate(langs):
        for at, n in grams[x].items():
            counts[at, i] = n
    return langid.MixtureModel(langs, counts), grams, langs


def test_mixtures_against_brute_force():
    model, grams, langs = _small_model()
    rng = random.Random(3)
    texts = []
    for n in (1, 2, 3, 5, 5):
        pool = b" ".join(rng.sample(list(LANGUAGES.values()), n)).split() + [b"unseen", b"Word."]
        texts.append(b" ".join(rng.choices(pool, k=rng.randrange(1, 200))))
    got, _ = model.mixtures(texts)
    for text, own in zip(texts, got):
        assert np.allclose(own, _mixture(text, grams, langs), atol=2e-3)


def test_mixtures_of_many_languages_and_long_texts():
    model, _, langs = _small_model()
    every = b" ".join(list(LANGUAGES.values()) * 20)
    mixed, _ = model.mixtures([every])
    assert (mixed[0] > 0.1).all()
    long = every + b"\n" + every.upper()
    short = model.mixtures([b" ".join([long] * 3)])[0]
    assert len(long) * 3 < langid.CHUNK < len(long) * 1200
    tallied, words_ = model.mixtures([b" ".join([long] * 1200)])
    assert np.allclose(tallied, short, atol=1e-3) and words_[0] > 0


def test_language_sample_counts_copies_once(spark):
    rows = [(i, "same words here again", "aa") for i in range(300)] + [(1000 + i, f"other text number {i}", "bb") for i in range(50)] + [(None, "same words here again", "aa"), (2000, None, "cc")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    assert model.langs == ["aa", "bb"]
    once = np.bincount(langid._grams([b"same words here again"])[0], minlength=langid.BUCKETS) + 0.1
    assert np.allclose(model.log[0], np.log(once / once.sum()), atol=1e-4)


def test_toxicity(spark, docs):
    rng = random.Random(6)
    names = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(names, k=rng.randrange(20, 80))
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zqxvile", "zqxvil3", "zqxviles"])
        rows.append((i, " ".join(w), None, None, 1))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (0, rows[0][1], None, None, 1)]
    got = toxicity.toxicity_report(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(900, 1, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)
    none = toxicity.toxicity_report(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("predicted = 1").isEmpty()


def test_toxicity_averages_a_texts_subwords(monkeypatch):
    """Gradients against differences, and scores against the average written out."""
    monkeypatch.setattr(toxicity, "SEEN", 1)
    texts, y = [b"you zqxvile thing", b"a nice thing here", b"zqxvil3 you you", b"nice nice day x"], np.array([1, 0, 1, 0])
    model, bags = toxicity.SubwordModel(), toxicity.Bags.of([t.split() for t in texts])
    model.known[bags.used] = True
    model.vectors, model.weights, model.bias = (a.astype(np.float64) for a in (model.vectors, model.weights, model.bias))
    cost = np.array([0.25, 0.5, 0.25, 0.5])

    def logits(text):
        grams, at = toxicity.subwords(text.split())
        counted = [model.vectors[g] for g in grams if model.known[g]]
        return toxicity.SCALE * np.mean(counted, axis=0) @ model.weights + model.bias

    def loss():
        rows = np.array([logits(t) for t in texts])
        likely = rows[np.arange(4), y] - np.log(np.exp(rows).sum(axis=1))
        return -(likely * cost).sum() + toxicity.DECAY / 2 * (model.vectors[bags.used] ** 2).sum()

    found = model.gradients(bags, y, cost)
    for table, gradient, places in ((model.vectors, found[0], [(0, 1), (5, 2), (9, 0)]), (model.weights, found[1], [(0, 0), (3, 1)]), (model.bias, found[2], [(0,), (1,)])):
        for place in places:
            at = (bags.used[place[0]], *place[1:]) if table is model.vectors else place
            old = table[at]
            table[at] = old + 1e-5
            up = loss()
            table[at] = old - 1e-5
            slope = (up - loss()) / 2e-5
            table[at] = old
            assert abs(slope - gradient[place]) < 1e-3 * max(1, abs(slope)), (place, slope, gradient[place])
    got = toxicity.Scorer(model).scores([*texts, b"", b"qqqqqqqqqqqqqq"])
    want = [1 / (1 + math.exp(a - b)) for a, b in map(logits, texts)] + [1 / (1 + math.exp(model.bias[0] - model.bias[1]))] * 2
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity_of_long_clean_texts():
    """Unseen words do not add up: a long clean text scores as a short one does."""
    rng = random.Random(4)
    name = lambda letters: "".join(rng.choices(letters, k=6))
    names = [name("abcdefghij") for _ in range(300)]
    texts = [" ".join(rng.choices(names, k=60) + (["zqxvile"] * 3 if i % 3 == 0 else [])).encode() for i in range(500)]
    model = toxicity.SubwordModel()
    model.train(texts, [int(i % 3 == 0) for i in range(500)])
    long = " ".join(name("klmnoprstuvw") for _ in range(20_000)).encode()
    scores = toxicity.Scorer(model).scores([long, " ".join(rng.choices(names, k=5_000)).encode(), texts[0], texts[3]])
    assert scores[0] < 0.5 and scores[1] < 0.5 and min(scores[2:]) >= 0.5


def test_language_model(spark, docs, corpus):
    train = [t for i, t, *_ in corpus if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in words(lower(t)))
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    base = math.log10(total + 0.5 * (distinct + 1))
    value = lambda n: math.log10(n + 0.5) - base
    want = Counter()
    for i, t, *_ in corpus:
        w = words(lower(t))
        want[(i, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(value(counts[x]) for x in w) + value(len(train)), 4))] += 1
    old = maxent_lm.DICTIONARY
    try:
        for bound in (old, 50):  # 50: most words meet their counts in the join
            maxent_lm.DICTIONARY = bound
            got = maxent_lm.lm_report(docs).collect()
            assert as_counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
            assert all(r.train_tokens == total and r.score < 0 for r in got)
    finally:
        maxent_lm.DICTIONARY = old
    real = maxent_lm.lm_report(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert real[1] > real[0]


def test_gradients_do_not_depend_on_when_keys_are_counted(monkeypatch):
    pa, rng = maxent_lm.pa, random.Random(8)
    vocabulary = ["".join(rng.choices("abcde", k=3)) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (40_000, 0, 3, 9_000)]
    words, shapes, _ = maxent_lm.tokens_of([x.encode() for x in texts])
    kinds, counts = np.unique(words, return_counts=True)
    v = maxent_lm.Vocabulary(len(words) + 4, len(kinds) + 1, 4, 3000, kinds, counts, np.zeros(8), np.zeros(8))
    model = maxent_lm.MaxEnt(100)
    model.weights[:] = np.random.default_rng(1).normal(0, 0.1, model.weights.shape)
    sent = lambda x: type("Sent", (), {"value": x})
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    def made(keys):
        monkeypatch.setattr(maxent_lm, "KEYS", keys)
        return [r.to_pydict() for r in maxent_lm._gradient(sent(v), sent(model))(iter([batch]))]

    assert len(words) > model.weights.size // 4 and made(1) == made(4_000_000) != []
    leaves, first, tokens, _ = maxent_lm._with_ends(v, [x.encode() for x in texts])
    found = sum(len(rows) * len(at) for at, _, rows, _ in model.levels(v, leaves, model.contexts(*tokens, first)))
    expected = sum(maxent_lm._unpacked(x, 2 * maxent_lm.BLOCK * maxent_lm.WAYS).reshape(2, -1)[1].sum() for d in made(1) for x in d["sums"])
    assert abs(64 * expected / found - 1) < 1e-2  # each key is counted once


def test_language_model_uses_rare_words(spark):
    """2,000 words, each always followed by one other: what follows is known for all of them, not for the most frequent 255."""
    rng = random.Random(3)
    follower = [f"v{i:04d}" for i in range(2000)]
    rng.shuffle(follower)
    pairs = [i for i in range(2000) for _ in range(24)]
    rng.shuffle(pairs)
    rows = [(n, " ".join(f"w{i:04d} {follower[i]}" for i in pairs[k : k + 40]), "en", "a", 0) for n, k in enumerate(range(0, len(pairs), 40))]
    right = " ".join(f"w{i:04d} {follower[i]}" for i in range(300, 600))
    wrong = " ".join(f"w{i:04d} {follower[i - 1]}" for i in range(300, 600))
    ids = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = {r.doc_id: r.score for r in maxent_lm.lm_report(spark.createDataFrame(rows + [(ids[0], right, "en", "a", 0), (ids[1], wrong, "en", "a", 0)], SCHEMA)).where("held_out").collect() if r.doc_id in ids}
    assert got[ids[0]] > got[ids[1]] + 100


def _components(corpus, k, num, den):
    sets = [shingle_set(t, k) for _, t, *_ in corpus]
    parent = list(range(len(corpus)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(corpus)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for i in range(len(corpus)):
        ids[root(i)].append(corpus[i][0])
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    return [(corpus[i][0], len(sets[i]), least(ids[root(i)])) for i in range(len(corpus))]


@pytest.mark.parametrize("short", [32, 1])
def test_jaccard_join(docs, corpus, short, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)  # 1: what pivots leave is compared in blocks
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    assert as_counter(jaccard_join.jaccard_report(docs).collect()) == Counter(_components(corpus, 4, 85, 100))


def test_no_text_is_shuffled_for_many_classes(spark, docs, corpus, monkeypatch):
    """Classes beyond what is broadcast are made from texts where these lie, told by a bitmap."""
    for module in (jaccard_join, sys.modules["weftwork.llm.common"]):
        monkeypatch.setattr(module, "SMALL", -1, raising=False)
    plans = []

    def seen(df, label, f=jaccard_join.saved):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return f(df, label)

    monkeypatch.setattr(jaccard_join, "saved", seen)
    got = jaccard_join.jaccard_report(docs)
    assert as_counter(got.collect()) == Counter(_components(corpus, 4, 85, 100))
    joins = [p.split("\n") for p in plans if "Join" in p and "text#" in p]
    assert all(min(i for i, x in enumerate(p) if "text#" in x) >= min(i for i, x in enumerate(p) if "MapInArrow" in x) > min(i for i, x in enumerate(p) if "Join" in x) for p in joins)


def test_posting_lists_stay_short(spark, monkeypatch):
    """Shingles of many documents are in no list, also those that the table of frequent ones has no room for."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    rng = random.Random(5)
    phrases = [" ".join(f"p{i}{c}" for c in "abcd") for i in range(40)]
    rows = []
    for n in range(60):
        parts = [f"w{n}x{i}" for i in range(400)] + phrases
        rng.shuffle(parts)
        rows.append((n, " ".join(parts)))
    join = jaccard_join.JaccardJoin(spark.createDataFrame(rows + [(99, rows[0][1] + " more")], "doc_id long, text string"))
    most = join.shared.groupBy("t").count().agg(F.max("count")).first()[0]
    assert most < 4
    assert {r.doc_id: r.component_id for r in join.result().collect()} == {n: 0 if n == 99 else n for n in [*range(60), 99]}


@pytest.mark.parametrize("share", [1, 3])
def test_common_shingles_by_pieces(monkeypatch, share):
    """Those with as many places as wanted come out, but for their last bits; no others do."""
    rng = np.random.default_rng(2)
    tokens = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    times = rng.integers(1, 3 + share, len(tokens))
    monkeypatch.setattr(jaccard_join, "COMMON", 3)
    pieces, rest = jaccard_join._pieces(np.repeat(tokens, times))
    found = [jaccard_join._common(jaccard_join.pa.table({"c": pieces[i : i + 1], "b": rest.slice(i, 1)}))["t"].to_numpy().view(np.uint64) for i in range(len(pieces))]
    assert np.array_equal(np.concatenate(found) >> np.uint64(22), tokens[times >= 3] >> np.uint64(22))


def test_one_of_each(docs, corpus):
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    rows = _components(corpus, 5, 80, 100)
    alone = len({(c[0], c[1]) for c, r in zip(corpus, rows) if not r[1]})
    sets = {}
    for c, r in zip(corpus, rows):
        if r[1]:
            sets.setdefault((r[2] if r[2] is not None else c[1]), r)
    assert got.count() >= alone + 1 and got.where("doc_id = 105").isEmpty()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


@pytest.mark.parametrize("edges_at_once", [250_000, 40, 3])
def test_components_of_long_paths(spark, monkeypatch, edges_at_once):
    """Paths, cycles, stars and copies of edges, in one block or many."""
    monkeypatch.setattr(jaccard_join, "EDGES", edges_at_once)
    rng = random.Random(3)
    names = rng.sample(range(-(10**12), 10**12), 400)
    path, star, cycle = names[:150], names[150:300], names[300:]
    edges = [*zip(path, path[1:]), *((star[0], x) for x in star[1:]), *zip(cycle, cycle[1:] + cycle[:1])]
    edges += edges[::3] + [(b, a) for a, b in edges[::4]] + [(path[0], path[0])]
    rng.shuffle(edges)
    want = {(x, min(part)) for part in (path, star, cycle) for x in part}
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_contraction_in_blocks(monkeypatch):
    """Blocks of batches and parts of batches keep every edge's ends joined."""
    monkeypatch.setattr(jaccard_join, "EDGES", 7)
    u, v = np.arange(1, 51), np.arange(50)
    batches = [jaccard_join.pa.RecordBatch.from_arrays([jaccard_join.pa.array(x[i : i + 10]) for x in (u, v)], ["u", "v"]) for i in range(0, 50, 10)]
    blocks = [list(zip(*(c.to_pylist() for c in b.columns))) for b in jaccard_join._contracted(iter(batches))]
    assert all(len({y for _, y in b}) == 1 and len(b) <= 7 for b in blocks)
    assert sorted(x for b in blocks for x, _ in b) == list(range(1, 51))


def test_components_write_few_tables(spark, monkeypatch):
    """Edges of one block are contracted without rounds, which fill the driver."""
    made = []
    monkeypatch.setattr(jaccard_join, "saved", lambda df, label, f=jaccard_join.saved: made.append(label) or f(df, label))
    assert jaccard_join.components(spark.range(300).selectExpr("id a", "id + 1 b")).agg(F.max("comp"), F.count("c")).first() == (0, 301)
    assert made == ["edges", "components"]


def test_empty_tables(spark):
    nothing, pages = empty(spark), spark.createDataFrame([], "page_id long, url string, html string")
    benchmark, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for result in (
        line_dedup.line_dedup_report(nothing), span_dedup.span_report(nothing), quality.quality_report(nothing), html_main.extract_main_text(pages),
        decontaminate.contamination_report(nothing, benchmark), bpe.public_bpe_report(nothing), langid.language_report(nothing),
        toxicity.toxicity_report(nothing, labels), maxent_lm.lm_report(nothing), jaccard_join.jaccard_report(nothing),
    ):
        assert result.count() == 0


def test_clashing_columns(spark, docs):
    extra = docs.withColumns({x: F.lit(1) for x in ("h", "c", "n_words", "kept", "score", "ids", "t", "item_id", "held_out", "component_id", "s")})
    for report in (line_dedup.line_dedup_report, span_dedup.span_report, quality.quality_report, bpe.public_bpe_report, langid.language_report, maxent_lm.lm_report, jaccard_join.jaccard_report):
        assert report(extra).count() == docs.count()
    assert stages.quality_rules(spark, extra, SF).columns == extra.columns
    assert stages.jaccard_join(spark, extra, SF).columns == extra.columns


def test_pipeline(spark):
    """run() against a pipeline of the brute-force versions."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = {(r.doc_id, r.kept) for r in quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    docs = [(r.doc_id, r.text) for r in rows if (r.doc_id, True) in kept]
    found = Counter(k for _, t in docs for k in {lower(x.strip(SPACES)) for x in t.split("\n")})
    docs = [(i, "\n".join(x for x in t.split("\n") if not (k := lower(x.strip(SPACES))) or found[k] < 10)) for i, t in docs]
    groups = _components(docs, 5, 80, 100)
    docs = [d for d, g in zip(docs, groups) if g[0] == g[2] or not g[1]]
    items = [shingle_set(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if not any(100 * len(s & shingle_set(t, 5)) >= 80 * len(s) for s in items if s)]
    got = {(r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in docs}
    assert [name for name, _ in corpus_pipeline.STAGES] and json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_measures_stay_linear_under_a_filter(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"], k=n)) for n in (5_000, 20_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(quality.measures(F.col("text")).alias("m"))
    began = time.time()
    got = rows.where(quality.RULES["base"][0]).select("m.*").collect()  # every window repeats, so both fail
    assert time.time() - began < 30 and sorted(r.n_words for r in got) == [5_000, 20_000]
    assert [r.n_repeat_words for r in got] == [_measures(t)[4] for t in texts]


def test_quality_stage_on_long_texts(spark):
    rng = random.Random(12)
    long = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(20_000))
    docs = spark.createDataFrame([(i, long if i == 0 else long[i * 500 : i * 500 + 500], "en", "a", 1) for i in range(40)] + [(99, "short", "en", "a", 1)], SCHEMA)
    got = stages.quality_rules(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == list(range(40))


def test_line_runs_are_compacted_and_leave_the_catalog(spark, docs):
    assert line_dedup.layout(1_000) == (4, 16) and line_dedup.layout(2_000_000_000) == (4, 250) and line_dedup.layout(10**12) == (10, 50_000)
    before = {t.name for t in spark.catalog.listTables()}
    line_dedup.drop_common_lines(docs, batches=6).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    runs, keys = line_dedup.LineRuns(spark, 2), spark.range(40).selectExpr("id % 5 AS __k1", "id % 5 AS __k2")
    for _ in range(8):
        runs.add(keys)
    assert sum(map(len, runs.settled)) <= 3 and {(r["__k1"], r.n_docs >= 2) for r in runs.frequent().collect()} == {(i, True) for i in range(5)}
    runs.close()


def test_line_dedup_keeps_clashing_columns(docs):
    names = ("__h", "__g", "__d", "__drops", "__k1", "n_docs")
    extra = docs.withColumns({x: F.lit(7) for x in names})
    got = line_dedup.drop_common_lines(extra)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", *names, "__kept", "__lines", "__dropped"]
    assert got.where(" and ".join(f"`{x}` = 7" for x in names)).count() == docs.count()


def test_decontamination_finds_split_items(spark):
    """Items of 60 to 130 words in 2 to 5 parts, far from each other, in long texts; and many equal items."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    items, texts = [], []
    for n in range(60):
        item = [word() for _ in range(rng.randrange(60, 131))]
        parts = rng.randrange(2, 6)
        cuts = sorted(rng.sample(range(10, len(item) - 10), parts - 1))
        text = []
        for a, b in zip([0, *cuts], [*cuts, len(item)]):
            text += [word() for _ in range(rng.randrange(2_000, 2_500))] + item[a:b]
        texts.append((n, " ".join(text)))
        items.append((n, " ".join(item)))
    sets = {n: shingle_set(t, 5) for n, t in items}
    want = {(i, n) for i, t in texts for n in ([i] if 100 * len(sets[i] & shingle_set(t, 5)) >= 80 * len(sets[i]) else [])}
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in texts], SCHEMA)
    many = [(1000 + i, items[7][1]) for i in range(3000)] if any(i == 7 for i, _ in want) else []
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(docs, spark.createDataFrame(items + many, "item_id long, text string")).collect()}
    assert {x for x in got if x[1] < 1000} == want and len(want) > 30 and {x for x in got if x[1] >= 1000} == {(7, i) for i, _ in many}


def test_decontamination_with_many_items(spark):
    """50,000 items in one scan; the bitmap alone comes to the driver."""
    rng = random.Random(22)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 40)))) for n in range(50_000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=200)) + " " + items[i * 97][1] + " " + " ".join(rng.choices(vocabulary, k=200)), None, None, 1) for i in range(200)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i * 97) for i in range(200)}


def test_html_takes_linear_time():
    for page in ("<a '" * 250_000, "<a '><b \">" * 60_000 + "x '", "<" * 500_000, "<!-- " * 100_000, "</x " * 200_000, "<script>" * 50_000, "<p>a " * 100_000):
        began = time.time()
        html_main.main_text(page)
        assert time.time() - began < 20, page[:20]
    assert html_main.main_text("<p>word word word</p> last 1 < 2") == "word word word\nlast 1 < 2"
    assert html_main.main_text("<p>word word word</p><script>var hidden > 1; more") == "word word word"


def test_html_against_the_articles_of_the_pages(spark):
    """Words of the pages' article elements, by a plain cut, against what is extracted."""
    both = got = want = 0
    for r in html_main.extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = Counter(html_lib.unescape(re.sub(r"(?s)<[^>]*>", " ", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])).split())
        found = Counter(r.text.split())
        both, got, want = both + sum((article & found).values()), got + sum(found.values()), want + sum(article.values())
    assert both / got > 0.99 and both / want > 0.99


@pytest.mark.parametrize("name", ["share-price", "search-results", "page-title", "story-head", "title", "legal", "text-ad-free", "login-guide", "x1"])
def test_html_of_one_article_whatever_its_name(name):
    long = "word " * 99 + "end."
    assert html_main.main_text(f"<body><ul><li><a>home</a></li><li><a>news</a></li></ul><div class='{name}'><p>{long}</p></div><footer>foot</footer></body>") == long
