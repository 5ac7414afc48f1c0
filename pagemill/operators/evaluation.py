"""Aggregates over runs, scores and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, key: Column, failed: Column | None = None) -> DataFrame:
    """Count and share by type, failures in a bucket of their own."""
    kind = key if failed is None else F.when(failed, "ERROR").otherwise(key)
    counts = rows.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    # a row per type
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("type", "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def scored_mean(score: Column) -> Column:
    return F.avg(F.when(score.isNotNull(), score))


def run_scores(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean and population deviation over the runs with a score above zero."""
    return rows.where(F.col(score) > 0).groupBy(*keys).agg(F.round(F.avg(score), 2).alias("mean"), F.round(F.stddev_pop(score), 2).alias("std"), F.count(F.lit(1)).alias("n_runs"))


def throughput(rows: DataFrame, keys: list[str], seconds: Column, ok: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.avg(seconds).alias("mean"), F.try_divide(F.count(F.lit(1)), F.sum(seconds) / 60).alias("per_minute"), F.avg(ok.cast("int")).alias("success_rate")
    )


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def source_hit_rate(items: DataFrame, valid: DataFrame) -> DataFrame:
    """The share of an item list's sources that are valid pages; 1 where there are none. items: doc_id, sources array<string>."""
    page = lambda s: F.regexp_extract(s, r"(?i)p?(\d+)", 1)
    flat = items.select("doc_id", F.explode("sources").alias("s")).select("doc_id", page(F.col("s")).alias("p")).where("p <> ''").select("doc_id", F.col("p").cast("int").alias("page_no"))
    hit = flat.join(valid.select("doc_id", "page_no").distinct().withColumn("_ok", F.lit(1)), ["doc_id", "page_no"], "left")
    rate = hit.groupBy("doc_id").agg(F.count("_ok").alias("hits"), F.count(F.lit(1)).alias("total"))
    return items.select("doc_id").distinct().join(rate, "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("total", F.lit(0)).alias("total"), F.when(F.coalesce("total", F.lit(0)) == 0, 1.0).otherwise(F.col("hits") / F.col("total")).alias("rate"))


def agreement(rows: DataFrame, a: str, b: str, truth: str) -> DataFrame:
    right_a, right_b = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    return rows.agg(
        F.count_if(right_a).alias("a_right"), F.count_if(right_b).alias("b_right"), F.count_if(right_a & right_b).alias("both"),
        F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"), F.count_if(F.col(a) != F.col(b)).alias("disagree"), F.count(F.lit(1)).alias("n"),
    )


def deltas(rows: DataFrame, keys: list[str], version: str, old: str, new: str, metrics: list[str]) -> DataFrame:
    """new - old per metric, where both are there."""
    pick = lambda m, v: F.avg(F.when(F.col(version) == v, F.col(m)))
    return rows.groupBy(*keys).agg(*((pick(m, new) - pick(m, old)).alias(m) for m in metrics))


def all_statuses(rows: DataFrame, status: str, values: list[str]) -> DataFrame:
    """Counts of every status, also those that do not occur."""
    return rows.agg(*(F.count_if(F.col(status) == v).alias(v) for v in values)).select(F.inline(F.array(*(F.struct(F.lit(v).alias("status"), F.col(v).alias("n")) for v in values))))


def best_of(rows: DataFrame, keys: list[str], value: str, order: str, result: str) -> DataFrame:
    """The first row in order with the greatest value above zero."""
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(F.max_by(result, F.struct(F.col(value), -F.col(order))).alias(result), F.max(value).alias(value))


def integer_mean(x: Column) -> Column:
    return F.when(F.count(x) > 0, F.floor(F.sum(x) / F.count(x)).cast("long"))


def window_metrics(calls: DataFrame, key: str, order: list[str], ok: Column, latency: str, size: int = 100) -> DataFrame:
    """Error rate, mean and nearest-rank p99 of the latency over the last ``size`` calls of each key."""
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    values = F.array_sort(F.collect_list(latency).over(last))
    place = F.least(F.floor(F.size("_v") * 0.99).cast("int"), F.size("_v") - 1) + 1
    rows = calls.withColumns({"error_rate": F.avg((~ok).cast("int")).over(last), "mean_latency": F.avg(latency).over(last), "_v": values})
    return rows.withColumn("p99", F.element_at("_v", place)).drop("_v")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).where("_k = 1").drop("_k")


def requests_within(calls: DataFrame, key: str, seconds: int, ts: str = "ts") -> Column:
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0))


def evict_finished(tasks: DataFrame, finished: Column, order: list[str], most: int = 1000) -> DataFrame:
    """Tasks, of which the oldest finished go while there are more than ``most``; unfinished ones stay however many they are."""
    room = max(0, most - tasks.where(~finished).count())
    newest = tasks.where(finished).orderBy(*(F.desc(c) for c in order)).limit(room)  # at most ``most`` rows
    return tasks.where(~finished).unionByName(newest)
