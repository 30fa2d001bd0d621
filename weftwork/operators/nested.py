"""Growth of nested counters: JSON objects of any depth whose leaves are integers.

Objects are flattened level by level, as long as a level has objects left, to one
row for each leaf with its path; leaves are subtracted by a join, and objects are
put together again from the deepest level up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.storage import saved

_KIND = F.schema_of_variant


def flattened(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) for each leaf, and with a null value for each empty object.

    ``column`` holds JSON text; what is neither an object nor an integer is an
    error, as is text that is no JSON; a null gives no rows.
    """
    level = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.array().cast("array<string>").alias("path"), F.parse_json(column).alias("v"))
    spark, leaves, depth = rows.sparkSession, None, 0
    while True:
        level = saved(level.select("key", "path", F.to_json("v").alias("json"), _KIND("v").alias("kind")), "level")
        whole = F.col("kind").startswith("OBJECT")
        wrong = ~whole & ((F.col("kind") != "BIGINT") | F.lit(depth == 0))
        value = F.when(wrong, F.raise_error(F.concat(F.lit("storage statistics must contain integers: "), F.array_join("path", ".")))).when(~whole, F.col("json").cast("long"))
        own = level.where(~whole | (F.col("json") == "{}")).select("key", "path", value.alias("value"))
        leaves = own if leaves is None else leaves.unionByName(own)
        deeper = level.where(whole & (F.col("json") != "{}")).select("key", "path", F.parse_json("json").alias("v"))
        if deeper.isEmpty():
            return leaves.withColumnRenamed("key", key)
        level = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("name"), F.col("value").alias("below")))
        level = level.select("key", F.concat("path", F.array("name")).alias("path"), F.col("below").alias("v"))
        depth += 1


def nested_growth(current: DataFrame, baseline: DataFrame | None, key: str, column: str) -> DataFrame:
    """(key, path, value): the leaves of ``current``, each less what the baseline has there, not below 0.

    A leaf that the baseline lacks, or has an object for, grew by all of itself;
    without a baseline nothing has grown.
    """
    now = flattened(current, key, column)
    then = (now if baseline is None else flattened(baseline, key, column)).select(F.col(key).alias("_key"), F.col("path").alias("_path"), F.col("value").alias("before"))
    met = now.join(then, F.col(key).eqNullSafe(F.col("_key")) & (F.col("path") == F.col("_path")), "left")
    grown = F.when(F.col("value").isNotNull(), F.greatest(F.lit(0), F.col("value") - F.coalesce("before", F.lit(0))))
    return met.select(key, "path", grown.alias("value"))


def together(leaves: DataFrame, key: str) -> DataFrame:
    """(key, json): the objects that ``flattened`` took apart, names in order."""
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    level = saved(leaves.select(F.col(key).alias("key"), "path", F.coalesce(F.col("value").cast("string"), F.lit("{}")).alias("json")), "leaves")
    depth = level.agg(F.max(F.size("path"))).first()[0] or 0
    for n in range(depth, 0, -1):
        deep = level.where(F.size("path") == n).select("key", F.slice("path", 1, n - 1).alias("path"), F.concat(text(F.element_at("path", n)), F.lit(":"), "json").alias("part"), F.element_at("path", n).alias("name"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("name", "part"))), lambda x: x["part"])
        level = level.where(F.size("path") < n).unionByName(deep.groupBy("key", "path").agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json")))
    return level.select(F.col("key").alias(key), "json")
