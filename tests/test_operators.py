"""The operators on small fixtures: semantics the driver's tables do not reach."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from weftwork.functions import pages, urls
from weftwork.operators import admission, frontier, outcomes, robots, run_stats, schedule, statistics
from weftwork.sources import records

PAGE = """<!doctype html><html><head><title>  A   title </title><meta name="Description" content=" Some  words ">
<meta name="KEYWORDS" content="a, b"><style>p{}</style></head><body><nav><a href="/home">Home</a></nav>
<h1>One <b>bold</b></h1><h2>Two</h2><p>Hello <strong>async</strong> world.</p><!-- note -->
<a href="next#part">n</a><a href="next">again</a><a href="https://other.example/x">o</a><a href="mailto:x@y.z">m</a><a href="javascript:void(0)">j</a>
<img src="/i.png" alt=" pic  ture "><img src="j.png"><table><tr><th>H1</th><th>H2</th></tr><tr><td>1</td><td>2</td></tr></table>
<ul><li>x <ul><li>y</li></ul></li><li>z</li></ul><script>var a = "<p>no</p>";</script><noscript><p>kept</p></noscript></body></html>"""


def test_parse_page():
    p = pages.parse(PAGE, "https://a.example/dir/page")
    assert p["title"] == "A title"
    assert p["metadata"] == {"title": "A title", "description": "Some words", "keywords": "a, b"}
    assert p["links"] == ["https://a.example/home", "https://a.example/dir/next", "https://other.example/x"]
    assert p["images"] == [{"src": "https://a.example/i.png", "alt": "pic ture"}, {"src": "https://a.example/dir/j.png", "alt": ""}]
    assert p["headings"] == [{"level": "h1", "text": "One bold"}, {"level": "h2", "text": "Two"}]
    assert p["tables"] == [{"headers": ["H1", "H2"], "rows": [["1", "2"]]}]
    assert p["lists"][0] == {"type": "ul", "items": ["x y", "z"]} and p["lists"][1]["items"] == ["y"]
    assert "Hello async world ." in p["text"].replace("world.", "world .") and "var a" not in p["text"] and "kept" in p["text"] and "note" in p["text"]
    assert pages.parse(PAGE, "https://a.example/dir/page", same_host=True)["links"] == ["https://a.example/home", "https://a.example/dir/next"]


def test_parse_broken_and_empty_pages():
    p = pages.parse("<title>T<h1>Head<a href='/x'>go<div>more", "http://h.example/")
    assert p["links"] == [] or p["links"] == ["http://h.example/x"]
    assert pages.parse(None, None)["text"] == "" and pages.parse("", "u")["links"] == []
    bad = pages.parse('<body><a href="/ok">x</a><a href="http://[bad">y</a><h1>H</h1>', "http://h.example/")
    assert bad["links"] == [] and bad["headings"][0]["text"] == "H"  # one bad link empties the links alone


URLS = [
    ("https://Example.COM:443/a?b#c", True, "example.com", "https://example.com"),
    ("http://user:pw@h.example:8080", True, "h.example", "http://h.example:8080"),
    ("HTTP://[::1]:80/x", True, "::1", "http://[::1]"),
    (" http://h.example ", True, "h.example", "http://h.example"),
    ("http://h.example:99999/", False, None, None),
    ("ftp://h.example/", False, None, None),
    ("http://", False, None, None),
    ("http:///path", False, None, None),
    ("not a url", False, None, None),
    (None, False, None, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(URLS)], "i int, url string")
    u = F.col("url")
    got = df.select("i", urls.is_valid(u).alias("v"), urls.host(u).alias("h"), urls.origin(u).alias("o")).orderBy("i").collect()
    assert [(r.v, r.h, r.o) for r in got] == [x[1:] for x in URLS]


def test_join_url(spark):
    cases = [("../about#team", "https://h.example/about"), ("//cdn.example/x", "https://cdn.example/x"), ("?q=1", "https://h.example/a/b?q=1"), ("/r", "https://h.example/r"), ("http://[bad", None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, href string")
    got = df.select("i", urls.join_url(F.lit("https://h.example/a/b"), "href").alias("x"), urls.absolute(F.lit("https://h.example/a/b"), F.col("href")).alias("fast")).orderBy("i").collect()
    assert [r.x for r in got] == [c[1] for c in cases]
    assert all(r.fast is None or r.fast == r.x for r in got if r.x)


def test_url_filter(spark):
    rows = [("https://a.example/en/1",), ("https://a.example/en/private",), ("https://sub.a.example/en/1",), ("https://a.example:8443/en/2",), ("https://a.example/fr/1",)]
    df = spark.createDataFrame(rows, "url string")
    keep = admission.UrlFilter(["A.example"], include=[r"/(?P<lang>en)/"], exclude=["private"])
    assert sorted(r.url for r in df.where(keep.column(F.col("url"))).collect()) == ["https://a.example/en/1", "https://a.example:8443/en/2"]
    for bad in ("", "(", None):
        with pytest.raises(ValueError):
            admission.UrlFilter(["h"], include=[bad])
    with pytest.raises(ValueError):
        admission.UrlFilter([])


def test_classification_of_every_status(spark):
    df = spark.range(400, 600).select(F.lit("http_error").alias("o"), F.col("id").cast("int").alias("s"))
    for r in df.withColumn("t", outcomes.error_type(F.col("o"), F.col("s"))).collect():
        assert r.t == ("TransientError" if r.s == 429 or r.s >= 500 else "PermanentError")


def test_backoff_and_timeouts(spark):
    got = spark.range(1, 9).select(outcomes.backoff(F.col("id")).alias("b"), outcomes.timeout("total", F.col("id")).alias("t")).collect()
    assert [r.b for r in got] == [0.5, 1, 2, 4, 8, 16, 30, 30]
    assert [r.t for r in got][:3] == [30, 60, 120] and got[-1].t == 120


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private/\nAllow: /private/public/\nCrawl-delay: 2\n\nUser-agent: Special\nUser-agent: Other\nDisallow: /\n"
    docs = spark.createDataFrame([("a", 200, body), ("b", 403, ""), ("c", 404, "User-agent: *\nDisallow: /"), ("d", 200, "")], "origin string, status int, body string")
    rules = robots.rules_of(docs)
    pages_ = spark.createDataFrame([(1, "a", "/private/x"), (2, "a", "/private/public/page"), (3, "a", "/"), (4, "b", "/"), (5, "c", "/"), (6, "d", "/x")], "id int, o string, p string")
    decide = lambda agent: {r.id: r.allowed for r in robots.allowed(pages_, robots.agent_rules(rules, agent), F.col("o"), F.col("p"), "id").collect()}
    assert decide("Bot/1.0") == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
    assert decide("special/2")[3] is False
    assert {r.origin: r.crawl_delay for r in robots.crawl_delays(robots.agent_rules(rules, "Bot")).collect()}["a"] == 2.0


def test_robots_takes_the_most_specific_group_and_wildcards(spark):
    body = "User-agent: weft\nDisallow: /\n\nUser-agent: weftnews\nDisallow: /*.pdf$\nDisallow: /a*/b\nAllow: /a*/b/c\nDisallow: /x\\Ey*z\nDisallow: /end$\n\nUser-agent: *\nDisallow: /q"
    rules = robots.rules_of(spark.createDataFrame([("a", 200, body)], "origin string, status int, body string"))
    paths = {"/q": True, "/k.pdf": False, "/k.pdf?v=1": True, "/k-pdf": True, "/a1/b": False, "/a/2/b/c": True, "/x\\Ey.z": False, "/end": False, "/end/": True}
    urls_ = spark.createDataFrame([("a", p) for p in paths], "o string, p string").withColumn("id", F.col("p"))
    decide = lambda agent: {r.id: r.allowed for r in robots.allowed(urls_, robots.agent_rules(rules, agent), F.col("o"), F.col("p"), "id").collect()}
    assert decide("WeftNews/2.0") == paths
    assert not any(decide("weftbot").values())
    assert decide("other") == {p: p != "/q" for p in paths}


def test_rate_slots_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.random() * 50, rng.choice([0.5, 1.0, 2.0])) for i, k in enumerate(rng.choices("ab", k=120))]
    df = spark.createDataFrame(rows, "k string, i int, a double, d double")
    got = {r.i: r.wait for r in schedule.rate_slots(df, "k", F.col("a"), F.col("d"), ["a", "i"]).collect()}
    last = {}
    for k, i, a, d in sorted(rows, key=lambda r: (r[2], r[1])):
        slot = max(a, last[k] + d) if k in last else a
        last[k] = slot
        assert abs(got[i] - (slot - a)) < 1e-9


def test_trailing_count_is_left_open(spark):
    times = [0, 200_000, 500_000, 900_000, 1_000_000, 1_200_000]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    got = schedule.trailing_count(df, F.col("t"), 1).orderBy("t").collect()
    assert [r.recent for r in got] == [1, 2, 3, 4, 4, 4]


@pytest.mark.parametrize("cap,depth", [(7, 3), (100, 2), (1, 2), (100, 0)])
def test_expand_against_a_queue(spark, cap, depth):
    rng = random.Random(cap * 10 + depth)
    edges = [(s, p, rng.randrange(30)) for s in range(30) for p in range(3)]
    seeds = [3, 5, 3]
    seen, queue, out = {}, [], []
    for s in seeds:
        if s not in seen and len(seen) < cap:
            seen[s] = len(seen)
            heapq.heappush(queue, (0, seen[s], s))
    while queue:
        d, n, u = heapq.heappop(queue)
        out.append((u, d, n))
        if d < depth:
            for s, p, t in edges:
                if s == u and t not in seen and len(seen) < cap:
                    seen[t] = len(seen)
                    heapq.heappush(queue, (d + 1, seen[t], t))
    got = frontier.expand(spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "url long, pos int"), spark.createDataFrame(edges, "src long, pos int, dst long"), cap, depth).collect()
    assert sorted((r.url, r.depth, r.seq) for r in got) == sorted(out)


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = [
        ("r", "r", f"<sitemapindex {ns}><sitemap><loc>a</loc></sitemap><sitemap><loc>bad</loc></sitemap><sitemap><loc> b </loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"),
        ("r", "a", f"<urlset {ns}><url><loc>http://x/1</loc></url><url><loc>http://x/2</loc></url></urlset>"),
        ("r", "b", "<urlset><url><loc>http://x/2</loc></url><url><loc>http://x/3</loc></url></urlset>"),
        ("r", "bad", "<urlset"),
        ("q", "q", "<html/>"),
    ]
    roots = spark.createDataFrame([("r",), ("q",), ("missing",)], "root string")
    got = frontier.resolve_sitemaps(roots, spark.createDataFrame(docs, "root string, url string, body string")).collect()
    assert [r.url for r in sorted((x for x in got if x.root == "r"), key=lambda r: r.pos)] == ["http://x/1", "http://x/2", "http://x/3"]
    assert {r.root: r.error for r in got if r.root != "r"} == {"q": "schema_error", "missing": "fetch_error"}


def _records(spark, rows):
    return spark.createDataFrame([(u, t, "text, \"q\"\nline", ["http://x/1"], {"k": "Ж"}, "2024-01-01 00:00:00", 200, "Text/HTML") for u, t in rows], "url string, title string, text string, links array<string>, metadata map<string,string>, crawled_at string, status_code int, content_type string").withColumn("crawled_at", F.to_timestamp("crawled_at"))


def test_sinks_agree(spark, tmp_path):
    sink = records.build_sinks([{"type": "json", "path": str(tmp_path / "j")}, {"type": "csv", "path": str(tmp_path / "c")}, {"type": "sqlite", "path": str(tmp_path / "s.db")}])
    sink.save(_records(spark, [("http://x/a", "A"), ("http://x/b", "")]))
    first, *others = [x.read(spark) for x in sink.sinks]
    assert first.count() == 2 and all(records.disagreements(first, o).isEmpty() for o in others)
    sink.sinks[2].save(_records(spark, [("http://x/a", "new")]))
    got = sink.sinks[2].read(spark).collect()
    assert [(r.url, r.title) for r in got] == [("http://x/a", "new"), ("http://x/b", "")]
    assert not records.disagreements(first, sink.sinks[2].read(spark)).isEmpty()
    assert sink.sinks[0].export_pretty(spark, str(tmp_path / "p.json")) == 2


def test_invalid_batch_writes_nothing(spark, tmp_path):
    sink = records.JsonLines(str(tmp_path / "none"))
    with pytest.raises(records.RecordError):
        sink.save(_records(spark, [("http://x/a", "A"), (" ", "B")]))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        records.Composite([])


def test_counter_delta(spark):
    now = spark.createDataFrame([("a", 5), ("b", 2), ("c", 1)], "k string, n int")
    old = spark.createDataFrame([("a", 3), ("b", 4)], "k string, n int")
    assert sorted(map(tuple, statistics.counter_delta(now, old, ["k"], "n").collect())) == [("a", 2), ("c", 1)]


def test_links_and_description_of_any_markup(spark, tmp_path):
    from weftwork.plans.queries import QUERIES

    page = """<head><meta content='A "b" &amp; c' name=Description></head><a href='about.html'>1</a><a class="x" href=../up>2</a><a data-href="no" href="?p=2">3</a><a href="/root">4</a><a href="mailto:a@b.c">5</a><a href="">6</a><a href="about.html#s">7</a>"""
    spark.createDataFrame([(1, "https://h.org/a/b/c", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.pos, r.link) for r in QUERIES["page_links"](spark, str(tmp_path)).collect()}
    assert got == {(0, "https://h.org/a/b/about.html"), (1, "https://h.org/a/up"), (2, "https://h.org/a/b/c?p=2"), (3, "https://h.org/root")}
    assert QUERIES["page_title_meta"](spark, str(tmp_path)).first().description == 'A "b" & c'


def test_sitemaps_against_a_walk(spark):
    rng = random.Random(4)
    docs, want = [], {}
    for root in ("r1", "r2", "r3"):
        names = [f"m{i}" for i in range(12)]
        own = {}
        for name in [root, *names]:
            if name == root or rng.random() < 0.4:
                found = rng.choices([*names, root, "gone"], k=5)
                own[name] = ("index", found)
                body = "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in found) + "</sitemapindex>"
            else:
                found = [f"http://x/{rng.randrange(40)}" for _ in range(6)]
                own[name] = ("pages", found)
                body = "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in found) + "</urlset>"
            docs.append((root, name, body))
        seen, pages = set(), {}

        def visit(name):
            if name in seen or name not in own:
                return
            seen.add(name)
            kind, found = own[name]
            for x in found:
                visit(x) if kind == "index" else pages.setdefault(x)

        visit(root)
        want[root] = list(pages)
    frame = spark.createDataFrame(docs, "root string, url string, body string").repartition(5)
    got = frontier.resolve_sitemaps(frame.where("url = root").select("root"), frame).collect()
    for root, pages in want.items():
        assert [(r.pos, r.url) for r in sorted(got, key=lambda r: r.pos) if r.root == root] == list(enumerate(pages))


def test_sitemaps_skip_invalid_pages(spark):
    body = "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in ("http://x/1", "ftp://x/2", "http://x:0/3", "http://x y/4", "page", "https://x:8443/5")) + "</urlset>"
    docs = spark.createDataFrame([("r", "r", body), ("e", "e", "<urlset/>")], "root string, url string, body string")
    got = frontier.resolve_sitemaps(spark.createDataFrame([("r",), ("e",)], "root string"), docs).collect()
    assert [(r.root, r.pos, r.url) for r in sorted(got, key=lambda r: r.pos)] == [("r", 0, "http://x/1"), ("r", 1, "https://x:8443/5")]


def test_allowed_domains():
    assert [admission.domain_name(x) for x in (" Example.COM:443 ", "[::1]:80", "a.example")] == ["example.com", "::1", "a.example"]
    for bad in ("a.example/x", "a.example?q", "a b", "", "a.example:x"):
        with pytest.raises(ValueError):
            admission.domain_name(bad)


def test_expand_without_a_cap_numbers_by_ranges(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), i, rng.randrange(300)) for i in range(900)]
    seeds, table = spark.createDataFrame([(0, 0)], "url long, pos int"), spark.createDataFrame(edges, "src long, pos long, dst long")
    one = frontier.expand(seeds, table, max_pages=9_999, max_depth=6).orderBy("seq").collect()
    assert one == frontier.expand(seeds, table, max_pages=None, max_depth=6).orderBy("seq").collect() and [r.seq for r in one] == list(range(len(one)))


def test_concurrency_over_spans(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), s := rng.randrange(1000), s + rng.randrange(1, 400)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    want = {k: max(sum(s <= t < e for x, s, e in rows if x == k) for t in range(1400)) for k in "ab"}
    for width in (7, 100, 10**9):
        assert {r.k: r.peak for r in schedule.concurrency(df, "s", "e", "k", width).collect()} == want


def test_retry_budgets_against_a_loop(spark):
    rng = random.Random(10)
    kinds = [("success", 200, None), ("http_error", 503, "TransientError"), ("http_error", 404, "PermanentError"), ("network_error", None, "NetworkError")]
    rows = [(u, r, a, *rng.choices(kinds, [2, 4, 1, 3])[0][:2]) for u in range(20) for r in range(5) for a in range(1, 7)]
    limits, factors = {"TransientError": 2, "CrawlerError": 1}, {"NetworkError": 5.0}
    made = run_stats.with_budgets(spark.createDataFrame(rows, "user_id int, request int, attempt int, outcome string, status_code int"), limits, factors)
    want = []
    for u in range(20):
        for r in range(5):
            used = {}
            for _, _, a, outcome, status in sorted(x for x in rows if x[:2] == (u, r)):
                kind = next(k for o, s, k in kinds if (o, s) == (outcome, status))
                policy = "TransientError" if kind == "TransientError" else "CrawlerError"
                used[policy] = used.get(policy, 0) + (kind is not None)
                again = kind in ("TransientError", "NetworkError") and used[policy] <= limits[policy] and a < 6
                want.append((u, r, a, again, min(0.5 * (5.0 if kind == "NetworkError" else 2.0) ** (used[policy] - 1), 30.0) if again else None))
                if not again:
                    break
    assert sorted((x.user_id, x.request, x.attempt, x.retried, x.backoff) for x in made.collect()) == sorted(want)


def test_growth_without_a_baseline_and_states(spark):
    now = spark.createDataFrame([(10, 4, 2.0)], "a long, b long, mean double")
    then = spark.createDataFrame([(4, 4, 1.0)], "a long, b long, mean double")
    assert run_stats.growth(now, then, ["a", "b"], {"mean": ("a", "b")}).first() == (6, 0, (2.0 * 14 - 1.0 * 8) / 6)
    assert run_stats.growth(now, None, ["a", "b"], {"mean": ("a",)}).first() == (0, 0, 0.0)
    results = spark.createDataFrame([("u", "robots_blocked", None, "Blocked by robots.txt", None), ("v", "success", 200, None, "bad"), ("w", "success", 200, None, None)], "url string, outcome string, status_code int, error string, parse_error string")
    states = run_stats.page_states(spark.createDataFrame([(x,) for x in "uvwx"], "url string"), results)
    assert {r.url: (r.state, r.reason) for r in states.collect()} == {"u": ("blocked", "Blocked by robots.txt"), "v": ("failed", "bad"), "w": ("processed", None), "x": ("failed", "Cancelled while processing")}
    assert {r.url for r in run_stats.permanent_urls(run_stats.error_table(results)).collect()} == {"v"}
    assert run_stats.key_differences(["a", "c"], ["a", "b"]) == {"missing": ["b"], "unknown": ["c"]}
    line = spark.range(1).select(run_stats.report_line(F.lit(5), F.lit(8), F.lit(1), F.lit(2.5))).first()[0]
    assert line == "5/8 pages (62.5%), 1 failed, 2.50 pages/s"
    draws = [r[0] for r in spark.range(200).select(run_stats.jitter_draw(F.col("id"))).collect()]
    assert 0 <= min(draws) and max(draws) < 1 and 0.4 < sum(draws) / 200 < 0.6


def test_prepared_requests(spark):
    decisions = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True)], "id int, origin string, allowed boolean")
    delays = spark.createDataFrame([("a", 2.0)], "origin string, crawl_delay double")
    got = {r.id: (r.outcome, r.error, r.min_interval) for r in robots.prepared(decisions, delays, 1.0).collect()}
    assert got == {1: (None, None, 2.0), 2: ("robots_blocked", "Blocked by robots.txt", None), 3: (None, None, 1.0)}


def test_json_array(spark, tmp_path):
    sink = records.JsonLines(str(tmp_path / "j"))
    sink.save(_records(spark, [("http://x/a", "A"), ("http://x/b", "B")]))
    assert sink.export_pretty(spark, str(tmp_path / "all.json")) == 2
    assert records.disagreements(records.read_array(spark, str(tmp_path / "all.json")), sink.read(spark)).isEmpty()
    (tmp_path / "bad.json").write_text("[1, 2]")
    with pytest.raises(Exception):
        records.read_array(spark, str(tmp_path / "bad.json")).collect()
    assert records.pending(205, 100) == 5


def test_robots_groups_without_rules(spark):
    bodies = {
        "empty": "User-agent: weft\nDisallow:\n\nUser-agent: *\nDisallow: /",
        "delay": "User-agent: weft\nCrawl-delay: 3\nUser-agent: *\nDisallow: /",
        "named": "User-agent: weft\n\nUser-agent: *\nDisallow: /x",
        "unknown": "User-agent: weft\nSitemap: /m.xml\nHost: a\nUser-agent: other\nDisallow: /y\n\nUser-agent: *\nDisallow: /",
        "none": "Disallow: /\nfoo\n: bar",
        "star": "User-agent: *\nDisallow:",
    }
    rules = robots.rules_of(spark.createDataFrame([(o, 200, b) for o, b in bodies.items()], "origin string, status int, body string"))
    urls_ = spark.createDataFrame([(f"{o}{p}", o, p) for o in bodies for p in ("/a", "/x", "/y")], "id string, o string, p string")
    decide = lambda agent: {r.id: r.allowed for r in robots.allowed(urls_, robots.agent_rules(rules, agent), F.col("o"), F.col("p"), "id").collect()}
    weft, foo = decide("weft/1.0"), decide("foo")
    assert [weft[f"{o}/a"] for o in bodies] == [True] * 6 and [foo[f"{o}/a"] for o in bodies] == [False, False, True, False, True, True]
    assert not weft["unknown/y"] and not weft["named/x"] and weft["empty/x"]
    assert {r.origin: r.crawl_delay for r in robots.crawl_delays(robots.agent_rules(rules, "weft")).collect()}["delay"] == 3.0


def test_robots_loads(spark):
    rows = [("a", "success", 204, None), ("b", "http_error", 404, None), ("c", "timeout", None, "late"), ("d", "network_error", None, ""), ("e", "success", 301, None)]
    got = {r.origin: (r.robots_url, r.status, r.available, r.error) for r in robots.loaded(spark.createDataFrame(rows, "origin string, outcome string, status_code int, error string")).collect()}
    assert got == {"a": ("a/robots.txt", 204, True, None), "b": ("b/robots.txt", 404, False, "HTTP 404"), "c": ("c/robots.txt", None, False, "late"), "d": ("d/robots.txt", None, False, "network_error"), "e": ("e/robots.txt", 301, False, "HTTP 301")}


def test_trailing_count_slides_no_frame(spark):
    """A sliding frame is added up anew at every row; rows without a moment count among themselves."""
    rng = random.Random(12)
    times = [rng.choice([None, *range(0, 9_000_000, 250_000)]) for _ in range(400)]
    df = spark.createDataFrame([(i, t, rng.choice("ab")) for i, t in enumerate(times)], "id int, t long, k string")
    counted = schedule.trailing_count(df, F.col("t"), 2, key="k")
    assert "-1999999" not in counted._jdf.queryExecution().toString()
    rows = counted.collect()
    assert len(rows) == 400 and counted.columns == ["id", "t", "k", "recent"]
    for r in rows:
        assert r.recent == sum(x.k == r.k and (x.t is None if r.t is None else x.t is not None and r.t - 2_000_000 < x.t <= r.t) for x in rows)
