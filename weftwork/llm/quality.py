"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured by rules; a host (the column ``source``) collects how
many of its documents fail each rule.  The rates of a rule over all hosts give
a beta prior by the method of moments, which shrinks each host's rate; a host
whose shrunk rate passes the rule's limit is rejected with all its documents.

Null text counts as empty; null is a host of its own; an empty table gives an
empty result.  Rows are independent, so repeated ids or rows do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import HOT_SHARE, columns_of, let, saved

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rules by name: failing documents, and the shrunk rate above which a host is rejected.
RULES: dict[str, tuple[str, float]] = {
    "base": ("m.n_words < 50 OR 100 * m.n_repeat_words > 50 * m.n_words", 0.5),
    "symbols": ("m.n_symbols > m.n_words", 0.5),
    "dup_lines": ("2 * m.n_dup_lines > m.n_lines", 0.5),
}


def _repeated(w: Column) -> Column:
    """How many of the words ``w`` lie in three-word windows that are found twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        # a window that repeats stands beside its like once the windows are sorted
        like = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: like(x, k - 1) | like(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(w) >= 3, let(F.sort_array(windows), covered)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of MEASURES and ``n_lines`` (lines with a word) of the whole text.

    Each step is bound once inside the expression, so its cost stays linear in
    the words (but for the sort) even where a filter on it is pushed down.
    """

    def of(whole: Column) -> Column:
        words = F.filter(F.split(whole, SPACE), lambda w: w != "")
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            F.struct(words.alias("w"), lines.alias("l")),
            lambda a: F.struct(
                F.size(a["w"]).cast("long").alias("n_words"),
                F.length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
                (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                (F.size(a["l"]) - F.size(F.array_distinct(a["l"]))).cast("long").alias("n_dup_lines"),
                _repeated(a["w"]).cast("long").alias("n_repeat_words"),
                F.size(a["l"]).cast("long").alias("n_lines"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def host_rates(rows: DataFrame) -> DataFrame:
    """Per host (``host``, with the measures ``m``): its documents and, for each rule, how many of them fail."""
    fails = [F.coalesce(F.sum(F.expr(test).cast("long")), F.lit(0)).alias(f"fail_{name}") for name, (test, _) in RULES.items()]
    return rows.groupBy(F.col("host").alias("__host")).agg(F.count(F.lit(1)).alias("__n"), *fails)


def beta_prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """The prior's two counts by the method of moments over hosts of two documents or more.

    Where hosts differ no more than chance would make them, or there are fewer
    than two, the prior is the pooled rate with a weight of 10 documents.
    """
    rate = F.col(f"fail_{rule}") / F.col("__n")
    row = hosts.agg(
        F.sum(f"fail_{rule}").alias("k"), F.sum("__n").alias("n"),
        F.avg(F.when(F.col("__n") > 1, rate)).alias("m"), F.var_samp(F.when(F.col("__n") > 1, rate)).alias("v"), F.avg(F.when(F.col("__n") > 1, 1 / F.col("__n"))).alias("u"),
    ).first()  # one row of five numbers
    if not row.n:
        return 0.0, 10.0
    m = row.m if row.m is not None else row.k / row.n
    noise = m * (1 - m) * (row.u or 0.0)
    spread = (row.v or 0.0) - noise
    weight = m * (1 - m) / spread - 1 if spread > 1e-9 else 10.0
    pooled = row.k / row.n
    weight = min(max(weight, 1.0), 1000.0)
    return weight * pooled, weight * (1 - pooled)


def rejects(hosts: DataFrame) -> Column:
    """Whether a host's shrunk failure rate passes the limit of any rule."""
    bad = F.lit(False)
    for rule, (_, limit) in RULES.items():
        a, b = beta_prior(hosts, rule)
        bad = bad | ((F.col(f"fail_{rule}") + F.lit(a)) / (F.col("__n") + F.lit(a + b)) > limit)
    return bad


def judged(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` (host, m and others) with base_failed and kept: neither the document nor its host fails.

    Verdicts of hosts with more than 1/HOT_SHARE of the documents are broadcast,
    at most HOT_SHARE rows; the documents of other hosts meet theirs in a shuffle.
    """
    everything = hosts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    limit = max(1, everything // HOT_SHARE)
    verdicts = hosts.withColumn("__bad", rejects(hosts))
    hot = F.broadcast(verdicts.where(F.col("__n") > limit).select("__host", "__bad"))
    cold = verdicts.where((F.col("__n") <= limit) & F.col("__bad")).select("__host", "__bad")
    met = rows.join(hot, rows["host"].eqNullSafe(hot["__host"]), "left")
    ready = met.where(F.col("__bad").isNotNull()).drop("__host")
    rest = met.where(F.col("__bad").isNull()).drop("__host", "__bad")
    rest = rest.join(cold, rest["host"].eqNullSafe(cold["__host"]), "left").drop("__host")
    out = ready.unionByName(rest).withColumn("base_failed", F.expr(RULES["base"][0]))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("__bad"), F.lit(False))).drop("__bad")


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document: the measures, base_failed and kept."""
    rows = saved(docs.select("doc_id", F.col("source").alias("host"), measures(F.col("text")).alias("m")), "quality")
    out = judged(rows, saved(host_rates(rows), "hosts"))
    return out.select("doc_id", *[f"m.{x}" for x in MEASURES], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``, whatever their names.

    The texts are measured once and written with their measures, from which the
    hosts are judged and then the documents.
    """
    whole = F.struct(*columns_of(docs, docs.columns)).alias("doc")
    rows = saved(docs.select(whole, F.col("source").alias("host"), measures(F.col("text")).alias("m")), "quality")
    return judged(rows, saved(host_rates(rows), "hosts")).where("kept").select("doc.*")
