"""Limiters in chunks, page states, figures of requests, nested counters, integrity of several backends, and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftwork.functions import urls
from weftwork.operators import nested, outcomes, run_stats, schedule, statistics
from weftwork.sources import reports
from weftwork.streaming import flows


@pytest.mark.parametrize("hot", [1.0, 0.5])
def test_rate_slots_of_a_hot_key_are_those_of_the_loop(spark, hot):
    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(3000):
        at += rng.choice([0.0, 0.1, 0.5, 3.0]) * rng.random()
        rows.append((i, "hot" if rng.random() < hot else rng.choice(["a", "b", None]), round(at, 3), rng.choice([0.0, 0.2, 1.0])))
    slots = schedule.rate_slots(spark.createDataFrame(rows, "id long, k string, at double, d double"), "k", F.col("at"), F.col("d"), ["at", "id"])
    got = {r.id: (r.slot, r.wait) for r in slots.collect()}
    last = {}
    for i, k, a, d in rows:
        last[k] = a if k not in last else max(a, last[k] + d)
        assert abs(got[i][0] - last[k]) < 1e-6 and abs(got[i][1] - (last[k] - a)) < 1e-6
    assert set(slots.columns) == {"id", "k", "at", "d", "arrival", "slot", "wait"}
    chunks = schedule.in_chunks(spark.createDataFrame(rows, "id long, k string, at double, d double").where("k = 'hot'"), ["k"], ["at", "id"], "test").groupBy("_chunk").count().collect()
    assert len(chunks) >= 6 and max(r["count"] for r in chunks) < 3000 * hot / 3


def test_rate_slots_of_nothing(spark):
    none = spark.createDataFrame([], "id long, k string, at double, d double")
    assert schedule.rate_slots(none, "k", F.col("at"), F.col("d"), ["at", "id"]).collect() == []


def test_page_states_by_steps(spark):
    tasks = spark.createDataFrame([(x,) for x in ("queued", "active", "ok", "blocked", "plain", "late", "error", "raised", "again", "ok")], "url string")
    steps = [
        ("active", 0, 0, "begun", None, None), ("ok", 0, 0, "begun", None, None), ("ok", 0, 1, "done", None, None), ("blocked", 0, 0, "blocked", None, "no robots"), ("plain", 0, 0, "blocked", None, ""),
        ("late", 0, 1, "cancelled", None, "x"), ("late", 0, 2, "done", None, None), ("error", 0, 0, "fetch_error", None, "HTTP 404"), ("raised", 0, 0, "exception", "KeyError", "'k'"),
        ("again", 0, 0, "fetch_error", None, "HTTP 503"), ("again", 1, 0, "begun", None, None), ("again", 1, 1, "done", None, None), ("other", 0, 0, "done", None, None),
    ]
    rng = random.Random(1)
    rng.shuffle(steps)
    got = {r.url: (r.state, r.reason) for r in run_stats.visited_states(tasks, spark.createDataFrame(steps, "url string, visit int, seq int, kind string, error_type string, message string")).collect()}
    assert got == {
        "queued": ("queued", None), "active": ("active", None), "ok": ("processed", None), "blocked": ("blocked", "no robots"), "plain": ("blocked", "Blocked by robots.txt"), "late": ("failed", "Cancelled while processing"),
        "error": ("failed", "HTTP 404"), "raised": ("failed", "KeyError: 'k'"), "again": ("processed", None),
    }


def _attempts(spark):
    rows = [(1, 0, 1, "http_error", 503, 0.2, "TransientError", True, 0.5, False), (1, 0, 2, "success", 200, 0.4, None, False, None, True), (2, 0, 1, "http_error", 404, 0.3, "PermanentError", False, None, True)]
    return spark.createDataFrame(rows, "user_id long, request long, attempt int, outcome string, status_code int, elapsed_seconds double, error_type string, retried boolean, backoff double, final boolean")


def test_request_snapshot_has_zeros_for_what_is_off(spark):
    row = run_stats.request_snapshot(_attempts(spark)).first().asDict()
    assert set(row) == set(run_stats.REQUEST_KEYS) and len(row) == 22
    on = {"total_requests": 3, "successful_requests": 1, "failed_requests": 2, "http_errors": 2, "scheduled_retries": 1, "successful_retries": 1, "total_backoff_time": 0.5, "average_retry_wait": 0.5, "errors_by_type": {"PermanentError": 1, "TransientError": 1}}
    for name, value in row.items():
        if name == "average_request_time":
            assert abs(value - 0.3) < 1e-9
        else:
            assert value == on.get(name, [] if name == "permanent_error_urls" else 0), name
    empty = run_stats.request_snapshot(_attempts(spark).where("false")).first().asDict()
    assert empty["total_requests"] == 0 and empty["average_request_time"] == 0.0 and empty["errors_by_type"] == {}


def test_request_growth(spark):
    made = _attempts(spark)
    slots = lambda *w: spark.createDataFrame([(x,) for x in w], "wait double")
    errors = lambda *u: spark.createDataFrame([(x, "PermanentError") for x in u], "url string, error_type string")
    now = run_stats.request_snapshot(made, slots=slots(0.0, 2.0, 4.0), errors=errors("b", "a"))
    then = run_stats.request_snapshot(made.where("request = 0 and attempt = 1 and user_id = 1"), slots=slots(0.0), errors=errors("a"))
    row = run_stats.request_growth(now, then, errors("c")).first().asDict()
    assert (row["total_requests"], row["rate_limited_requests"], row["total_rate_limit_wait"], row["average_rate_limit_wait"]) == (2, 2, 6.0, 3.0)
    assert abs(row["average_request_time"] - 0.35) < 1e-9 and row["errors_by_type"] == {"PermanentError": 1} and row["permanent_error_urls"] == ["b", "c"]
    none = run_stats.request_growth(now, None).first().asDict()
    assert all(not v for v in none.values())
    assert run_stats.request_growth(then, now).first().asDict()["total_requests"] == 0


def test_nested_growth(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "k int, s string")
    now = table((1, '{"a": {"b": {"c": 5, "d": 2}, "e": 1}, "f": 9, "g": {}}'), (2, '{"x": {"y": 3}}'), (3, None), (4, "{}"))
    then = table((1, '{"a": {"b": {"c": 3, "d": 7}, "e": {"z": 1}}, "f": {"q": 2}, "old": 4}'))
    grown = nested.nested_growth(now, then, "k", "s")
    assert {(r.k, ".".join(r.path)): r.value for r in grown.collect()} == {(1, "a.b.c"): 2, (1, "a.b.d"): 0, (1, "a.e"): 1, (1, "f"): 9, (1, "g"): None, (2, "x.y"): 3, (4, ""): None}
    back = {r.k: json.loads(r.json) for r in nested.together(grown, "k").collect()}
    assert back == {1: {"a": {"b": {"c": 2, "d": 0}, "e": 1}, "f": 9, "g": {}}, 2: {"x": {"y": 3}}, 4: {}}
    assert {r.value for r in nested.nested_growth(now, None, "k", "s").collect()} == {0, None}
    for bad in ('{"a": 1.5}', '{"a": {"b": true}}', '{"a": "x"}', '{"a": [1]}', "7", "{", '{"a": null}'):
        with pytest.raises(Exception):
            nested.nested_growth(table((1, bad)), None, "k", "s").collect()


def test_integrity_of_backends(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "url string, a string, b int")
    one = table(("u", "x", 1), ("v", None, 2), (None, "n", 3), ("w", "w", 4), ("dup", "d", 5))
    two = table(("u", "x", 1), ("v", "y", None), (None, "n", 3), ("dup", "d", 5), ("dup", "e", 5), ("new", "z", 0))
    found = lambda *x: {(r.url, r.backend, r.difference) for r in run_stats.integrity(*x).collect()}
    assert found({"one": one, "two": two, "three": one}, "url", ["a", "b"]) == {("v", "two", "a,b"), ("w", "two", "absent"), ("dup", "two", "duplicated"), ("dup", "two", "a"), ("new", "one", "absent"), ("new", "three", "absent")}
    assert found({"one": one, "two": two}, "url", ["a", "b"], table(("u", "", 0), ("v", "", 0), ("w", "", 0), ("dup", "", 0), ("lost", "", 0)).select("url")) == {
        ("v", "two", "a,b"), ("w", "two", "absent"), ("dup", "two", "duplicated"), ("dup", "two", "a"), ("new", "two", "unexpected"), (None, "one", "unexpected"), (None, "two", "unexpected"), ("lost", "one", "absent"), ("lost", "two", "absent"),
    }
    assert {(r.url, r.difference) for r in run_stats.compared(one, two, "url", ["a", "b"]).collect()} == {("v", "a,b"), ("w", "absent from the other"), ("dup", "duplicated"), ("new", "absent from the first")}


def test_reports(spark, tmp_path):
    errors = spark.range(5000).select(F.concat(F.lit('http://x/"é'), F.format_string("%05d", "id")).alias("url"), F.lit("PermanentError").alias("error_type"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("line\nbreak "), "id")).alias("message"), F.array("id").alias("codes"))
    path = reports.save_error_report(f"file://{tmp_path}/errors.json", errors.repartition(7), {"total": 5000, "by": {"x": [1]}})
    assert path == f"file://{tmp_path}/errors.json"
    text = (tmp_path / "errors.json").read_text()
    report = json.loads(text)
    assert report["statistics"] == {"total": 5000, "by": {"x": [1]}} and list(report["errors"]) == [f'http://x/"é{i:05}' for i in range(5000)]
    assert report["errors"]['http://x/"é00002'] == {"error_type": "PermanentError", "message": "line\nbreak 2", "codes": [2]} and report["errors"]['http://x/"é00003']["message"] is None
    results, failed = (spark.createDataFrame(x, y) for x, y in (([("u", "T", ["l"])], "url string, title string, links array<string>"), ([], "url string, reason string")))
    reports.save_crawl_results(f"{tmp_path}/crawl.json", results, failed, {})
    assert json.loads((tmp_path / "crawl.json").read_text()) == {"results": {"u": {"title": "T", "links": ["l"]}}, "failed_urls": {}, "statistics": {}}
    reports.save_crawl_results(f"{tmp_path}/crawl.json", results.where("false"), spark.createDataFrame([("v", "HTTP 404"), ("w", None)], "url string, reason string"), {"n": 2})
    assert json.loads((tmp_path / "crawl.json").read_text()) == {"results": {}, "failed_urls": {"v": "HTTP 404", "w": None}, "statistics": {"n": 2}}
    assert sorted(p.name for p in tmp_path.glob("*") if not p.name.startswith(".")) == ["crawl.json", "errors.json"]


def test_fetch_results_have_the_defaults_of_their_outcome(spark):
    u, none = F.lit("http://x/"), F.lit(None).cast("string")
    make = outcomes.fetch_result
    built = [
        make("success", u, content=F.lit("")), make("success", u, content=F.lit("c"), status_code=F.lit(301), content_type=F.lit("text/html"), attempts=2, elapsed_seconds=0.5), make("http_error", u, status_code=F.lit(404)), make("http_error", u, status_code=F.lit(500), error=F.lit("gone"), content=F.lit("c")),
        make("network_error", u, error=F.lit("ClientError: x")), make("timeout", u), make("timeout", u, error=none), make("robots_blocked", u), make("success", u), make("success", u, content=F.lit("c"), status_code=F.lit(404)), make("network_error", u), make("http_error", u), make("success", F.lit(" "), content=F.lit("c")),
        make("timeout", u, elapsed_seconds=float("inf")), make("timeout", u, attempts=0),
    ]
    r = F.col("r")
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("r")) for i, x in enumerate(built)])).alias("x")).select("x.*").select("i", "r", outcomes.is_valid_fetch(r).alias("ok"), outcomes.legacy_value(r).alias("old")).orderBy("i").collect()
    assert [x.ok for x in rows] == [True] * 8 + [False] * 7
    assert [(x.r.status_code, x.r.error) for x in rows[:8]] == [(200, None), (301, None), (404, "HTTP 404"), (500, "gone"), (None, "ClientError: x"), (None, "Request timed out"), (None, "Request timed out"), (None, "Blocked by robots.txt")]
    assert [x.old for x in rows[:8]] == ["", "c", "Error: HTTP 404", "Error: HTTP 500", "Error: ClientError ClientError", "Error: Timeout for http://x/", "Error: Timeout for http://x/", "Error: Blocked by robots.txt for http://x/"]


def test_loads_at_a_moment(spark):
    rows = [("a", 0.0, 1.0, 5.0), ("a", 0.0, 3.0, 9.0), ("a", 3.5, 4.0, 6.0), ("b", 1.0, 7.0, 8.0), ("b", 2.0, None, None), ("c", 0.0, 0.0, 3.0), ("d", 1.0, 2.0, None), ("e", 5.0, 6.0, 7.0)]
    loads = schedule.loads_at(spark.createDataFrame(rows, "domain string, q double, s double, e double"), "domain", "q", "s", "e", F.lit(3.0))
    assert {(r.domain, r.active, r.waiting) for r in loads.collect()} == {("a", 2, 0), ("b", 0, 2), ("d", 1, 0)}
    assert tuple(schedule.load_totals(loads, 10, None).first()) == (10, None, 3, 2) and tuple(schedule.load_totals(loads.where("false"), 10, 2).first()) == (10, 2, 0, 0)


def test_last_failures(spark):
    rows = [("a", "timeout", None, 1), ("a", "success", 200, 2), ("b", "http_error", 404, 1), ("b", "robots_blocked", None, 2), ("c", "success", 200, 1), ("c", "network_error", None, 2), ("d", "robots_blocked", None, 1)]
    results = spark.createDataFrame(rows, "url string, outcome string, status_code int, n int").select("*", F.lit("e").alias("error"), F.lit(1).alias("attempts"), F.lit(0.5).alias("elapsed_seconds"))
    assert {(r.url, r.outcome, r.status_code) for r in statistics.final_errors(results, "n").collect()} == {("b", "http_error", 404), ("c", "network_error", None)}


def test_progress_keys_and_windowed_hosts(spark, tmp_path):
    row = spark.range(1).select(*[x for d, s in ((3, 4), (0, 0)) for x in statistics.progress(F.lit(d), F.lit(s), F.lit(6), F.lit(float(d)))], statistics.pages_per_second(F.lit(5), F.lit(0.0)), statistics.pages_per_second(F.lit(5), F.lit(2.0))).first()
    assert tuple(row) == (75.0, 2.0, 0.0, None, 0.0, 2.5)
    keys = spark.createDataFrame([(" Example.COM.. ",), ("a.b",), (None,)], "d string").select(urls.limiter_key(F.col("d")).alias("k"))
    assert [r.k for r in keys.collect()] == ["example.com", "a.b", None]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps({"host": h, "at": f"2024-01-01T00:00:{s:02}Z"}) + "\n" for h, s in (("a", 1), ("a", 59), ("b", 5))) + json.dumps({"host": "z", "at": "2024-01-01T01:00:00Z"}) + "\n")
    counts = flows.host_counts(spark.readStream.schema("host string, at timestamp").json(str(tmp_path / "in")), "host", "at")
    query = counts.writeStream.format("memory").queryName("hosts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.host, r.n) for r in spark.table("hosts").collect()} == {("a", 2), ("b", 1)}
