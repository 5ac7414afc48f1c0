"""Caches as tables: what is known already, which entries stay, and how well it works."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_work(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose hash is not cached in their version."""
    return files.join(cache.select("hash", "version"), ["hash", "version"], "left_anti")


def replace_entries(cache: DataFrame, new: DataFrame) -> DataFrame:
    """One entry per hash, whatever its version: the latest."""
    rows = cache.unionByName(new)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("created_at"), F.desc("version")))).where("_k = 1").drop("_k")


def live_entries(cache: DataFrame, now, ttl: float, most: int) -> DataFrame:
    """Entries within their time to live, the ``most`` used last."""
    return cache.where(F.col("created_at") >= F.lit(now) - ttl).orderBy(F.desc("used_at"), "hash").limit(most)


def two_tiers(keys: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Looks keys up in two tiers; value and which tier had it."""
    rows = keys.join(first.select("hash", F.col("value").alias("_1")), "hash", "left").join(second.select("hash", F.col("value").alias("_2")), "hash", "left")
    return rows.select(*keys.columns, F.coalesce("_1", "_2").alias("value"), F.when(F.col("_1").isNotNull(), "l1").when(F.col("_2").isNotNull(), "l2").otherwise("miss").alias("tier"))


def stats(found: DataFrame) -> DataFrame:
    hit = F.col("tier") != "miss"
    return found.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)).alias("hit_rate"))


def write_through(df: DataFrame, put) -> None:
    """Hands each partition's (key, value) pairs to an outside store; ``put(pairs)`` runs on the executors."""
    df.select("hash", "value").foreachPartition(lambda rows: put((r[0], r[1]) for r in rows))
