"""SQLite as a data source, deliveries that are tried again, line numbers of bad records, live figures and trailing rates."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from weftwork.operators import schedule
from weftwork.sources import records
from weftwork.sources.delivery import Delivery, Tries, delivery_of
from weftwork.streaming import flows, progress


def _records(spark, urls, title="t"):
    rows = [(u, f"{title}{i}", "text", ["http://x/l"], {"title": "T"}, 200, "Text/HTML") for i, u in enumerate(urls)]
    made = spark.createDataFrame(rows, "url string, title string, text string, links array<string>, metadata map<string,string>, status_code int, content_type string")
    return made.withColumn("crawled_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).select(*records.COLUMNS)


def test_sqlite_keeps_order_and_ids(spark, tmp_path):
    sink = records.Sqlite(str(tmp_path / "r.db"), batch=7)
    urls = [f"http://x/{(i * 37) % 40}" for i in range(100)]
    sink.save(_records(spark, urls).repartitionByRange(6, F.substring("title", 2, 9).cast("int")))
    first = sink.read(spark, ids=True).orderBy("id").collect()
    assert [r.url for r in first] == list(dict.fromkeys(urls)) and [r.id for r in first] == sorted(r.id for r in first)
    assert {r.url: r.title for r in first} == {u: f"t{i}" for i, u in enumerate(urls)}
    sink.save(_records(spark, ["http://x/99", urls[3], "http://x/98", urls[3]], "n"))
    then = {r.url: (r.id, r.title) for r in sink.read(spark, ids=True).collect()}
    assert then[urls[3]] == ({r.url: r.id for r in first}[urls[3]], "n3") and len(then) == 42 and then["http://x/98"][0] > then["http://x/99"][0]
    assert not list(tmp_path.glob("*.staging*"))


def test_sqlite_reads_in_many_tasks(spark, tmp_path):
    sink = records.Sqlite(str(tmp_path / "r.db"))
    sink.save(_records(spark, [f"http://x/{i}" for i in range(2500)]))
    rows = sink.read(spark)
    assert rows.rdd.getNumPartitions() == 8 and rows.count() == 2500
    assert rows.where("links[0] = 'http://x/l' and metadata['title'] = 'T' and content_type = 'text/html'").count() == 2500
    sink.save(_records(spark, []))
    assert sink.read(spark).count() == 2500


def test_sqlite_writes_all_or_nothing(spark, tmp_path):
    path = tmp_path / "r.db"
    sink = records.Sqlite(str(path))
    sink.save(_records(spark, ["http://x/0"]))
    db = sqlite3.connect(path)
    db.execute("CREATE TRIGGER no BEFORE INSERT ON records WHEN new.url = 'http://x/7' BEGIN SELECT RAISE(ABORT, 'no'); END")
    db.commit()
    db.close()
    with pytest.raises(Exception):
        sink.save(_records(spark, [f"http://x/{i}" for i in range(10)]).repartition(4))
    assert [r.url for r in sink.read(spark).collect()] == ["http://x/0"] and not list(tmp_path.glob("*.staging*"))


def test_sqlite_refuses_what_is_not_shared(tmp_path):
    from types import SimpleNamespace

    from weftwork.sources.sqlite import shared_path

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: f"file://{tmp_path}/shared"), sparkContext=SimpleNamespace(master="spark://x", getCheckpointDir=lambda: None))
    assert shared_path(session, f"{tmp_path}/shared/a.db", False) == f"{tmp_path}/shared/a.db" and shared_path(session, "/data/a.db", True) == "/data/a.db"
    for path in ("/data/a.db", f"{tmp_path}/shared/../a.db"):
        with pytest.raises(ValueError):
            shared_path(session, path, False)


class Failing:
    """A sink that fails so often before it works."""

    def __init__(self, times, error=OSError):
        self.times, self.error, self.rows, self.calls = times, error, [], 0

    def save(self, batch):
        self.calls += 1
        if self.calls <= self.times:
            raise self.error("not now")
        self.rows += [r.url for r in batch.collect()]

    def close(self):
        if self.times:
            raise OSError("stuck")


def test_delivery_retries_and_counts_by_sink(spark, tmp_path):
    waits = []
    sinks = {"flaky": Failing(2), "steady": Failing(0), "dead": Failing(99), "wrong": Failing(99, ValueError), "json": records.JsonLines(str(tmp_path / "j"))}
    d = Delivery(sinks, str(tmp_path / "ledger"), Tries(retries=3, sleep=waits.append))
    assert d.save(_records(spark, ["http://x/a", "http://x/b"]), 0) is False
    assert waits == [0.1, 0.2, 0.1, 0.2, 0.4]
    assert d.stats() == {
        "flaky": {"saved_records": 2, "failed_saves": 0, "retried_saves": 2}, "steady": {"saved_records": 2, "failed_saves": 0, "retried_saves": 0}, "dead": {"saved_records": 0, "failed_saves": 2, "retried_saves": 3},
        "wrong": {"saved_records": 0, "failed_saves": 2, "retried_saves": 0}, "json": {"saved_records": 2, "failed_saves": 0, "retried_saves": 0},
    }
    assert d.totals() == {"saved_records": 6, "failed_saves": 4, "retried_saves": 5}
    again = Delivery({**sinks, "dead": Failing(0), "wrong": Failing(0)}, str(tmp_path / "ledger"))  # the batch comes again after a restart
    assert again.save(_records(spark, ["http://x/a", "http://x/b"]), 0) is True
    assert sinks["flaky"].rows == sinks["steady"].rows == ["http://x/a", "http://x/b"] and sinks["steady"].calls == 1
    assert sorted(r.url for r in sinks["json"].read(spark).collect()) == ["http://x/a", "http://x/b"] == again.sinks["dead"].rows
    assert {(r.batch, r.sink, r.records) for r in d.committed(spark).collect()} == {("0", x, 2) for x in sinks}
    assert d.close() is False and Delivery({"a": Failing(0)}, "x").close() is True


def test_a_save_that_comes_again_replaces_what_it_left(spark, tmp_path):
    for sink in (records.JsonLines(str(tmp_path / "j")), records.Csv(str(tmp_path / "c"))):
        sink.save(_records(spark, ["http://x/0"]))
        sink.save_once(_records(spark, ["http://x/1", "http://x/2"]), "7")  # the ledger was not reached
        d = delivery_of([sink], str(tmp_path / f"{type(sink).__name__}-ledger"))
        assert d.save(_records(spark, ["http://x/1", "http://x/2"]), 7) and d.save(_records(spark, ["http://x/1", "http://x/2"]), 7)
        assert sorted(r.url for r in sink.read(spark).collect()) == ["http://x/0", "http://x/1", "http://x/2"]


def test_delivered_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"title": "A", "text": "t", "links": [], "metadata": {}, "crawled_at": "2024-01-01T00:00:00+00:00", "status_code": 200, "content_type": "text/html"}
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps({**row, "url": f"http://x/{u}"}) + "\n" for u in range(5)))
    flaky, json_ = Failing(1), records.JsonLines(str(tmp_path / "j"))
    run = lambda tries: flows.deliver(flows.json_lines(spark, str(tmp_path / "in")), Delivery({"json": json_, "flaky": flaky}, str(tmp_path / "ledger"), tries), str(tmp_path / "cp"), strict=True)
    with pytest.raises(Exception):
        run(Tries(retries=0)).awaitTermination(120)
    run(Tries(retries=0)).awaitTermination(120)
    assert len(flaky.rows) == 5 and json_.read(spark).count() == 5


def test_lines_of_bad_records_in_split_files(spark, tmp_path):
    good = json.dumps({"url": "http://x", "n": "y" * 200})
    bad = {3: "{not json", 1700: "[1]", 2500: "7", 4000: "", 4998: '{"a": 1'}
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(bad.get(i, good) if name == "a" else good for i in range(1, 5001)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        sink = records.JsonLines(str(tmp_path / "in"))
        found = sink.bad_lines(spark)
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        assert sorted((r.file.rsplit("/")[-1], r.line, r.reason) for r in found.collect()) == [("a.json", i, "not an object" if x in ("[1]", "7") else "not JSON") for i, x in bad.items()]
        with pytest.raises(records.RecordError, match="a.json, line 3: not JSON"):
            sink.checked(spark)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_progress_is_reported_and_a_failing_output_harms_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, states in enumerate((["processed", "failed", "queued"], ["processed", "blocked", "active"])):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"state": s}) + "\n" for s in states))
    lines, bad = [], progress.Reporter(output=lambda line: 1 / 0, interval=0)
    good = progress.Reporter(output=lines.append, interval=0)
    stream = progress.observed(spark.readStream.schema("state string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    for listener in (bad, good):
        spark.streams.addListener(listener)
    try:
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        for _ in range(100):
            if lines and lines[-1].startswith("Total"):
                break
            __import__("time").sleep(0.1)
    finally:
        for listener in (bad, good):
            spark.streams.removeListener(listener)
    assert query.exception() is None and bad.failures >= 2 and bad.totals == good.totals
    assert {k: good.totals[k] for k in ("pages_scheduled", "pages_completed", "pages_successful", "pages_failed", "pages_blocked")} == {"pages_scheduled": 6, "pages_completed": 4, "pages_successful": 2, "pages_failed": 1, "pages_blocked": 1}
    assert lines[-1].startswith("Total: 4/6 pages | 100.0% | successful 2") and lines[0].startswith("Progress: ")


def test_progress_line():
    stats = {"pages_completed": 3, "pages_scheduled": 12, "pages_successful": 2, "pages_queued": 8, "pages_active": 1, "active_requests": 2, "pages_failed": 1, "pages_per_second": 1.5}
    assert progress.progress_line(stats) == "Progress: 3/12 pages | 25.0% | successful 2 | queued 8 | active pages 1 | active requests 2 | failed 1 | blocked 0 | 1.50 pages/s | ETA 6.0 s"
    line = progress.progress_line(stats, {"total_requests": 9, "errors_by_type": {"b": 1, "a": 2}, "permanent_error_urls": ["u"]}, final=True)
    assert line.startswith("Total: 3/12 pages | 100.0%") and "ETA --" in line and line.endswith("requests 9 (0.00/s) | mean wait 0.000 s | retries 0 (successful 0, mean wait 0.000 s) | errors a=2, b=1 | permanent URLs 1 | blocked by robots 0")
    assert "0.0%" in progress.progress_line({}) and progress.snapshot({"pages_completed": 4}, 0)["pages_per_second"] == 0.0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_trailing_rates(spark, tmp_path, rocks, files):
    import random

    rng = random.Random(files)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 20_000_000)) for i in range(120)] + [(900, "a", 5_000_000), (901, "a", 5_000_000), (902, "a", 6_000_000)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 4_000_000))  # out of order, within the delay
    (tmp_path / "in").mkdir()
    schema = "id long, domain string, micros long"
    step = -(-len(rows) // files)

    def put(name, part):
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps(dict(zip(("id", "domain", "micros"), r))) + "\n" for r in part))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("at", F.timestamp_micros("micros"))
        out = progress.trailing_rates(stream, "domain", "at", "id", seconds=2, delay="5 seconds")
        query = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        return query

    for i in range(files):
        put(i, rows[i * step : (i + 1) * step])
        if i % 2 == 0:
            run()  # each run starts from the checkpoint of the one before
    put("end", [(999, "z", 100_000_000)])  # lets the watermark pass all others
    last = run()
    table = spark.createDataFrame(rows, schema)
    want = {str(r.id): r.recent for r in schedule.trailing_count(table, F.col("micros"), 2, key="domain").collect()}
    assert {r.id: r.recent for r in spark.read.schema("key string, id string, micros long, recent long").json(str(tmp_path / "out")).collect()} == want
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8  # only the last row is held
