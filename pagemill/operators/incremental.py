"""Extraction that goes on where it stopped: a stream that ends when it has read what is there, a cache of results, and batches that replace themselves.

A batch leaves out what the cache has under the same doc_id, hash of the text and version, so a second run over the same rows asks no model and
writes nothing. Its results are one partition of the cache, named by the batch and written over: a batch that was cut short, and comes again with the same
number and rows, ends in the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import evidence, flows
from pagemill.operators.generate import Generator
from pagemill.operators.pages import page_table
from pagemill.storage import Steps

CACHE = "doc_id long, hash string, version string, total long, verified long, fixed long, removed long, failed long, error string"
ITEMS = "items array<struct<text string, sources array<string>>>"


def extracted(docs: DataFrame, types: Callable[[DataFrame], DataFrame], generator: Generator, templates: Mapping[str, str], size: int = 200) -> DataFrame:
    """The whole way of a document: pages, prompts in windows of them, replies repaired and merged, each item looked for on the pages, and the counts of
    what was verified, fixed and removed. A document without pages or items has counts of zero. docs: doc_id, text, hash.

    Replies and items are written once, as several joins read them; a model is asked once. Only pages of documents with items are searched."""
    steps = Steps(docs.sparkSession, "extraction")
    pages = page_table(docs, size)
    merged = steps.save(flows.windowed_extraction(pages, types(docs), generator, templates))
    rows = merged.select("doc_id", F.posexplode(F.from_json("value", ITEMS)["items"]).alias("ord", "item"))
    items = steps.save(rows.select("doc_id", "ord", "item.text", F.lit("").alias("quote"), F.regexp_extract(F.get("item.sources", 0), "([0-9]+)", 1).try_cast("int").alias("cited_page")))
    pages = page_table(docs.join(items.select("doc_id").distinct(), "doc_id", "left_semi"), size)
    stats = evidence.verification_stats(evidence.verify(items, evidence.locate(items, pages, F.col("text"))), "doc_id")
    out = docs.select("doc_id", "hash").join(stats, "doc_id", "left").join(merged.select("doc_id", "failed", "error"), "doc_id", "left")
    return out.select("doc_id", "hash", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "verified", "fixed", "removed", "failed")), "error")


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """All results of the cache with the batch they came with; of a document read again after a change there are several."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/results")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{CACHE}, batch long")
    return spark.read.schema(f"{CACHE}, batch long").parquet(f"{folder}/results")


def latest(results: DataFrame) -> DataFrame:
    """A row per document: its last result."""
    columns = [c for c in results.columns if c != "doc_id"]
    best = results.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "batch").alias("_b"))
    return best.select("doc_id", *(f"_b.{c}" for c in columns))


def run(source: DataFrame, folder: str, step: Callable[[DataFrame], DataFrame], version: str) -> int:
    """Works off a stream of (doc_id, text) into the cache of ``folder`` and gives the number of documents that were new or changed."""
    done = 0

    def each(batch: DataFrame, number: int) -> None:
        nonlocal done
        rows = batch.select("doc_id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash")).dropDuplicates(["doc_id", "hash"])
        known = cached(batch.sparkSession, folder).where((F.col("version") == version) & (F.col("batch") != number)).select("doc_id", "hash")
        work = rows.join(known, ["doc_id", "hash"], "left_anti").persist()
        try:
            found = work.count()
            if found:
                names = [c.split()[0] for c in CACHE.split(", ")]
                step(work).withColumn("version", F.lit(version)).select(names).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
            done += found
        finally:
            work.unpersist()

    query = source.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return done
