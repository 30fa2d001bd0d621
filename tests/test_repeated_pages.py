"""Queries over pages with what larger tables have, references cut short and urls met again, against their SQL."""

import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from weftwork.functions import selectors
from weftwork.functions.pages import parse
from weftwork.plans.oracle import SQL
from weftwork.plans.queries import QUERIES
from weftwork.sources import records

SF = "/root/testdata/sf0.001"
NAMES = [
    "crawl_content_totals", "page_headings", "page_select", "page_summary", "page_text", "page_title_meta",
    "crawl_records_build",
    "integrity_backends",
    "page_visits",
    "run_figures",
    "sitemap_resolve",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables; every third page's title is cut inside a reference, every fifth page comes three times."""
    folder = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF):
        if name != "pages.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    pages = spark.read.parquet(f"{SF}/pages.parquet").cache()
    cut = F.regexp_replace(F.regexp_replace("html", "</title>", "&&amp</title>"), "</h1>", "&&amp</h1>")
    pages = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, cut).otherwise(F.col("html")))
    again = pages.where("page_id % 5 = 0").withColumn("page_id", F.explode(F.array(F.col("page_id") + 1000, F.col("page_id") + 2000)))
    made = pages.unionByName(again)
    assert made.count() > made.select("url").distinct().count()
    made.repartition(2).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tables}/pages.parquet/*.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    theirs = con.execute(SQL[name])
    names = sorted(x[0] for x in theirs.description)
    rows = [dict(zip([x[0] for x in theirs.description], row)) for row in theirs.fetchall()]
    plain = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)
    want = sorted([plain(r[x]) for x in names] for r in rows)
    got = sorted([plain(r[x]) for x in names] for r in QUERIES[name](spark, tables).collect())
    assert got == want


def test_names_are_references_only_with_their_semicolon():
    page = "<title>a &amp b &amp; c &copy 5 &#65 &bogus; &ampx;</title><body><!-- x &amp y &amp; --><a href='/q?a=1&copy=2&amp;b'>t&lt</a><script>a &amp b</script>"
    want = parse(page, "http://h/")
    assert want["title"] == "a &amp b & c &copy 5 A &bogus; &ampx;"
    assert want["text"] == "x &amp y &amp; t&lt"
    assert want["links"] == ["http://h/q?a=1&copy=2&b"]
    assert selectors.Picked(page, selectors.compiled(["title", "a[href*='&copy=2']"])).texts == [want["title"], "t&lt"]


def test_records_of_pages_are_built_where_pages_lie(spark, tables):
    """No page goes to the driver for a broadcast, nor is it parsed twice."""
    plan = QUERIES["crawl_records_build"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_from_pages_broadcasts_no_page(spark):
    fetched = spark.createDataFrame([("u", "success", 200, "Text/HTML; x", None), ("v", "timeout", 0, "", None)], "url string, outcome string, status_code int, content_type string, crawled_at timestamp")
    parsed = spark.createDataFrame([("u", "t", "x", ["l"], ("t", "d", "k"), None), ("v", "t", "y", [], ("", "", ""), None)], "url string, title string, text string, links array<string>, metadata struct<title:string,description:string,keywords:string>, error string")
    out = records.from_pages(fetched, parsed)
    assert [(r.url, r.text, r.metadata["keywords"], r.content_type) for r in out.collect()] == [("u", "x", "k", "text/html")]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
