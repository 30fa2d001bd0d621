"""Robots policy: rules as a table, decisions as a best-match join.

The longest matching path wins and a tie allows; the most specific agent group
holds, also one without rules, and ``*`` where none is named.  401 and 403 forbid
all; other failures allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules_of(docs: DataFrame) -> DataFrame:
    """(origin, agent, allow, path, crawl_delay) from rows (origin, status, body).

    Lines are folded in order; user-agent lines name a group, which ends where
    user-agent lines follow rules or delays; other lines change nothing.  Each name
    gives a row without path and delay, so that a group is known that allows all.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "\r", ""), "#.*$", ""))), lambda x: x.contains(":"))
    parts = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("naming"), F.array().cast("array<struct<agents:array<string>,allow:boolean,path:string,delay:double>>").alias("out"))

    def step(acc, x):
        agent = F.lower(x["v"])
        naming, ruling = x["k"] == "user-agent", x["k"].isin("allow", "disallow", "crawl-delay")
        named = F.when(acc["naming"], F.concat(acc["agents"], F.array(agent))).otherwise(F.array(agent))
        rule = F.struct(acc["agents"].alias("agents"), (x["k"] == "allow").alias("allow"), x["v"].alias("path"), F.lit(None).cast("double").alias("delay"))
        delay = F.struct(acc["agents"].alias("agents"), F.lit(True).alias("allow"), F.lit(None).cast("string").alias("path"), x["v"].try_cast("double").alias("delay"))
        name = F.struct(F.array(agent).alias("agents"), F.lit(True).alias("allow"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("double").alias("delay"))
        made = F.when(x["k"].isin("allow", "disallow") & (x["v"] != ""), rule).when(x["k"] == "crawl-delay", delay).when(naming, name)
        return F.struct(
            F.when(naming, named).otherwise(acc["agents"]).alias("agents"),
            (naming | (acc["naming"] & ~ruling)).alias("naming"),
            F.when(made.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(made))).alias("out"),
        )

    ok = docs.where("status between 200 and 299").select("origin", F.explode(F.aggregate(parts, start, step)["out"]).alias("r"))
    rules = ok.select("origin", F.explode("r.agents").alias("agent"), F.col("r.allow").alias("allow"), F.col("r.path").alias("path"), F.col("r.delay").alias("crawl_delay"))
    barred = docs.where("status in (401, 403)").select("origin", F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.lit("/").alias("path"), F.lit(None).cast("double").alias("crawl_delay"))
    return rules.unionByName(barred)


def loaded(fetches: DataFrame) -> DataFrame:
    """(origin, robots_url, status, available, error) of the fetches of robots files (origin, outcome, status_code, error).

    Only 2xx makes a file available; a status that is not has the error ``HTTP n``,
    and a fetch without an answer its own message, else its outcome, and no status.
    """
    answered = ~F.col("outcome").isin("network_error", "timeout", "robots_blocked")
    fine = answered & F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    error = F.when(~answered, F.coalesce(F.nullif("error", F.lit("")), "outcome")).when(~fine, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
    return fetches.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("robots_url"), F.when(answered, F.col("status_code")).alias("status"), fine.alias("available"), error.alias("error"))


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of the group that holds for ``agent``, by origin: of the names that are part of it, the longest."""
    token = agent.split("/")[0].strip().lower()
    own = rules.where((F.col("agent") != "*") & (F.col("agent") != "") & F.lit(token).contains(F.col("agent")))
    best = own.groupBy("origin").agg(F.max_by("agent", F.struct(F.length("agent"), "agent")).alias("agent"))
    own = own.join(best, ["origin", "agent"], "left_semi").select(*rules.columns)
    rest = rules.where("agent = '*'").join(own.select("origin").distinct(), "origin", "left_anti")
    return own.unionByName(rest)


def _begins(url_path: Column, rule: Column) -> Column:
    """Whether a rule's path begins the URL's; ``*`` stands for any characters, a last ``$`` for the end."""
    plain = F.replace(F.regexp_replace(rule, r"\$$", ""), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("^\\Q"), F.replace(plain, F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"), F.when(rule.endswith("$"), "$").otherwise(""))
    return F.when(rule.contains("*") | rule.endswith("$"), F.rlike(url_path, pattern)).otherwise(url_path.startswith(rule))


def allowed(urls: DataFrame, rules: DataFrame, origin: Column, path: Column, key: str) -> DataFrame:
    """``key`` and whether the longest rule whose path begins the URL's path allows it."""
    rows = urls.select(F.col(key), origin.alias("origin"), path.alias("url_path"))
    met = rows.join(rules.where("path is not null").select("origin", "allow", "path"), "origin", "left")
    fits = _begins(F.col("url_path"), F.col("path"))
    best = F.max_by(F.when(fits, F.col("allow")), F.when(fits, F.struct(F.length("path"), "allow")))
    return met.groupBy(key).agg(F.coalesce(best, F.lit(True)).alias("allowed"))


def crawl_delays(rules: DataFrame) -> DataFrame:
    """Seconds by origin, 0 if none is set."""
    return rules.groupBy("origin").agg(F.coalesce(F.max("crawl_delay"), F.lit(0.0)).alias("crawl_delay"))


def prepared(decisions: DataFrame, delays: DataFrame, min_interval: float) -> DataFrame:
    """Requests (with origin and allowed) as they go on: blocked, or with the seconds to keep from the one before.

    A blocked request has the outcome and error of a fetch that robots rules
    forbid and no interval; the others keep the origin's crawl delay, or
    ``min_interval`` if that is longer.
    """
    met = decisions.join(delays, "origin", "left")
    barred = ~F.col("allowed")
    return met.select(
        *decisions.columns,
        F.when(barred, F.lit("robots_blocked")).alias("outcome"),
        F.when(barred, F.lit("Blocked by robots.txt")).alias("error"),
        F.when(~barred, F.greatest(F.lit(min_interval), F.coalesce("crawl_delay", F.lit(0.0)))).alias("min_interval"),
    )
