"""Bounded breadth-first expansion of a link graph, and sitemap resolution."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.storage import saved


#: Up to so many pages one task numbers a level; beyond, its ranges are numbered apart.
ONE_TASK = 10_000


def numbered(rows: DataFrame, order: str, first: int = 0) -> DataFrame:
    """``rows`` with ``seq``, their place by ``order``: ranges are numbered by themselves and moved by the rows before them.

    Rows go to tasks by ranges of ``order``; only the ranges' sizes, one number
    for each, are summed in one task.
    """
    ranged = saved(rows.orderBy(order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return ranged.withColumn("__place", place).join(F.broadcast(offsets), "__part").select(*rows.columns, (F.col("__place") + F.col("__before") + first).cast("long").alias("seq"))


def expand(seeds: DataFrame, edges: DataFrame, max_pages: int | None = 100, max_depth: int = 2, admit: Column | None = None) -> DataFrame:
    """(url, depth, seq): the pages that a crawl from ``seeds`` (url, pos) schedules; without ``max_pages`` all of them.

    ``edges`` are (src, pos, dst); ``admit`` filters dst, not the seeds.  The order
    is that of one worker: level by level, a page's place is that of its first
    link.  Each level is an equi-join, an aggregate and an anti-join, written to
    the shared folder; only the number of pages so far comes to the driver.
    """
    level = seeds.groupBy("url").agg(F.min(F.struct(F.lit(0).cast("long"), F.col("pos").cast("long").alias("p"))).alias("place"))
    links = edges if admit is None else edges.where(admit)
    done, base = None, 0
    for depth in range(max_depth + 1):
        if done is not None:
            level = level.join(done, "url", "left_anti")
        if max_pages is not None and max_pages <= ONE_TASK:
            ranked = level.orderBy("place").limit(max_pages - base).withColumn("seq", (F.row_number().over(Window.orderBy("place")) - 1 + base).cast("long"))
        else:
            ranked = numbered(level, "place", base)
            ranked = ranked if max_pages is None else ranked.where(F.col("seq") < max_pages)
        ranked = saved(ranked.select("url", F.lit(depth).alias("depth"), "seq"), "frontier")
        found = ranked.count()
        done = ranked if done is None else done.unionByName(ranked)
        base += found
        if not found or max_pages is not None and base >= max_pages:
            break
        met = links.join(ranked.select(F.col("url").alias("src"), "seq"), "src")
        level = met.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct(F.col("seq"), F.col("pos").cast("long").alias("p"))).alias("place"))
    return done


def _is_location(url: str) -> bool:
    """Absolute http or https, a host, no white space in the authority, a port of 1 to 65535."""
    try:
        parts = urlsplit(url)
        return parts.scheme in ("http", "https") and bool(parts.hostname) and not re.search(r"\s", parts.netloc) and (parts.port is None or parts.port > 0)
    except ValueError:
        return False


def _read_sitemap(body: str | None) -> tuple[str, list[str]]:
    """('urlset' or 'sitemapindex' or an error, locations in order); namespaces are ignored."""
    local = lambda tag: tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return "parse_error", []
    kind = local(root.tag)
    if kind not in ("urlset", "sitemapindex"):
        return "schema_error", []
    entry = "url" if kind == "urlset" else "sitemap"
    found = []
    for child in root:
        if local(child.tag) == entry:
            loc = next((x for x in child if local(x.tag) == "loc"), None)
            place = (loc.text or "").strip() if loc is not None else ""
            if place and (kind == "sitemapindex" or _is_location(place)):  # of sitemaps, those without a document are skipped
                found.append(place)
    return kind, found


def _read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document (pos -1, loc null) and one for each location that it names."""
    for rows in batches:
        out = []
        for root, url, body in zip(rows["root"], rows["url"], rows["body"]):
            kind, found = _read_sitemap(body) if body is not None else ("fetch_error", [])
            out.append((root, url, kind, -1, None))
            out.extend((root, url, kind, i, loc) for i, loc in enumerate(found))
        yield pd.DataFrame(out, columns=["root", "url", "kind", "pos", "loc"])


def resolve_sitemaps(roots: DataFrame, docs: DataFrame) -> DataFrame:
    """(root, pos, url, error): the pages of each root sitemap, depth first, first visit wins.

    Documents (root, url, body) are parsed each by itself into rows; where a url
    repeats under its root, one of its bodies counts.  Only a root's sitemaps and
    the links among them are walked in one group: a sitemap names at most 50,000
    others by the protocol, and their pages never meet there.  Pages get the place
    of their sitemap by a join, the first of equal pages stays, and places are
    numbered by ranges.  A root that fails gives one row with its error; nested
    failures are skipped and not tried again, and so are pages whose location is
    not valid.
    """
    wanted = roots.select("root").distinct()
    own = docs.select("root", "url", "body").join(wanted, "root", "left_semi").groupBy("root", "url").agg(F.max("body").alias("body"))
    parsed = saved(own.mapInPandas(_read_all, "root string, url string, kind string, pos int, loc string"), "sitemaps")

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        root = key[0]
        kinds = dict(zip(rows["url"][rows["pos"] < 0], rows["kind"][rows["pos"] < 0]))
        links = rows[rows["pos"] >= 0].sort_values("pos").groupby("url")["loc"].agg(list).to_dict()
        seen: dict[str, None] = {}
        stack = [root]
        while stack:
            url = stack.pop()
            if url not in seen:
                seen[url] = None
                stack.extend(reversed(links.get(url, [])))
        kind = kinds.get(root, "fetch_error")
        error = None if kind in ("urlset", "sitemapindex") else kind
        if error:
            return pd.DataFrame({"root": [root], "url": [root], "rank": [0], "error": [error]})
        visited = [(root, url, i, None) for i, url in enumerate(seen) if kinds.get(url) == "urlset"]
        return pd.DataFrame(visited, columns=["root", "url", "rank", "error"])

    sitemaps = wanted.join(parsed.where("pos < 0 or kind = 'sitemapindex'"), "root", "left")
    sitemaps = sitemaps.withColumn("pos", F.coalesce("pos", F.lit(0)))
    order = saved(sitemaps.groupBy("root").applyInPandas(walk, "root string, url string, rank int, error string"), "sitemap-order")
    pages = parsed.where("kind = 'urlset' and pos >= 0").join(order.where("error is null"), ["root", "url"])
    first = pages.groupBy("root", F.col("loc").alias("url")).agg(F.min(F.struct("rank", "pos")).alias("p"))
    placed = saved(numbered(first.select("root", "url", F.struct("root", "p").alias("place")), "place"), "sitemap-pages")
    begins = placed.groupBy("root").agg(F.min("seq").alias("begin"))
    found = placed.join(begins, "root").select("root", (F.col("seq") - F.col("begin")).cast("int").alias("pos"), "url", F.lit(None).cast("string").alias("error"))
    failed = order.where("error is not null").select("root", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("url"), "error")
    return found.unionByName(failed)
