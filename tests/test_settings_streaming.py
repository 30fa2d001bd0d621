"""Settings, and the streaming flows on files."""

import json

import pytest
from pyspark.sql import functions as F

from weftwork.sources import config, records
from weftwork.streaming import flows


def test_settings(tmp_path):
    assert config.from_dict({}).crawl.max_pages == 100 and config.from_dict({}).crawl.effective_rate is None
    assert config.from_dict({"crawl": {"respect_robots": True}}).crawl.effective_rate == 1.0
    for bad in ({"x": 1}, {"crawl": {"y": 1}}, {"crawl": {"max_pages": True}}, {"crawl": {"max_pages": 0}}, {"crawl": {"read_timeout": 500}}, {"crawl": {"retry_base_delay": 60}}, {"crawl": {"include_patterns": ["("]}}, {"crawl": {"user_agent": " "}}, {"crawl": {"timeout_multiplier": 0.5}}, {"storage": [{"type": "x", "path": "p"}]}, []):
        with pytest.raises(config.ConfigError):
            config.from_dict(bad)
    path = tmp_path / "c.json"
    path.write_text('{"crawl": {"jitter": NaN}}')
    with pytest.raises(config.ConfigError):
        config.from_json(str(path))
    path.write_text(json.dumps({"storage": [{"type": "json", "path": "out"}]}))
    settings = config.from_json(str(path))
    assert settings.storage[0]["path"] == str(tmp_path / "out") and settings.to_dict()["crawl"]["max_depth"] == 2


def test_sections_of_settings(tmp_path):
    plain = config.from_dict({})
    assert plain.reporting == config.Reporting(False, 1.0, None, None) and plain.logging == config.Logging("INFO", None, 10_485_760, 3)
    with pytest.raises(config.ConfigError):
        plain.check_sources()
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"start_urls": ["http://a/x", " http://a/x ", "https://b"], "sitemap_urls": ["http://a/s.xml"], "reporting": {"show_progress": True, "json_report": "r.json", "html_report": "~/r.html"}, "logging": {"level": "ERROR", "file": "/var/x.log"}}))
    settings = config.from_json(str(path))
    settings.check_sources()
    assert settings.start_urls == settings.seeds == ("http://a/x", "https://b") and settings.reporting.json_report == str(tmp_path / "r.json") and settings.reporting.html_report == str(tmp_path / "~/r.html") and settings.logging.file == "/var/x.log"
    assert settings.to_dict()["reporting"]["show_progress"] is True and config.from_dict(settings.to_dict()) == settings
    for bad in (
        {"start_urls": "http://a"}, {"start_urls": ["ftp://a"]}, {"start_urls": ["/x"]}, {"sitemap_urls": [7]}, {"start_urls": ["http://a:x/"]}, {"reporting": []}, {"reporting": {"x": 1}}, {"reporting": {"progress_interval": 0}}, {"reporting": {"show_progress": 1}}, {"reporting": {"json_report": " "}},
        {"reporting": {"json_report": "a", "html_report": "a"}}, {"logging": {"level": "LOUD"}}, {"logging": {"max_bytes": 0}}, {"logging": {"backup_count": 1.5}}, {"logging": None},
    ):
        with pytest.raises(config.ConfigError):
            config.from_dict(bad)
    for content in (b"{", b"\xff", b'{"crawl": {"jitter": Infinity}}'):
        path.write_bytes(content)
        with pytest.raises(config.ConfigError):
            config.from_json(str(path))
    with pytest.raises(config.ConfigError):
        config.from_json(str(tmp_path / "none.json"))


def test_stream_to_all_sinks(spark, tmp_path):
    row = {"url": "http://x/a", "title": "A", "text": "t", "links": [], "metadata": {}, "crawled_at": "2024-01-01T00:00:00+00:00", "status_code": 200, "content_type": "text/html"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps({**row, "url": u}) + "\n" for u in ("http://x/a", "http://x/b", "http://x/a ")))
    sinks = records.Composite([records.JsonLines(str(tmp_path / "j")), records.Csv(str(tmp_path / "c"))])
    stream = flows.unique_urls(flows.json_lines(spark, str(tmp_path / "in")))
    flows.write_all(stream, sinks, str(tmp_path / "cp")).awaitTermination(120)
    a, b = (x.read(spark) for x in sinks.sinks)
    assert sorted(r.url for r in a.collect()) == ["http://x/a", "http://x/b"] and records.disagreements(a, b).isEmpty()


def test_streamed_rate_slots(spark, tmp_path):
    rows = [("a", 0.0, 1.0), ("a", 0.2, 1.0), ("b", 0.3, 1.0), ("a", 5.0, 1.0)]
    spark.createDataFrame(rows, "domain string, arrival double, min_interval double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = flows.rate_slots(spark.readStream.schema("domain string, arrival double, min_interval double").json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("slots").orderBy("domain", "arrival").collect()
    assert [(r.domain, round(r.wait, 3)) for r in got] == [("a", 0.0), ("a", 0.8), ("a", 0.0), ("b", 0.0)]
    assert spark.table("slots").where(F.col("slot") < F.col("arrival")).isEmpty()
