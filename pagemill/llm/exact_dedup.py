"""Exact deduplication with a split between heavy and light digests.

Misra-Gries counters, one set a partition, name every digest that can hold more than 1/(k+1) of the rows; adding up
the sets and keeping the k largest sums keeps that guarantee. The named digests are then counted exactly, and the table
of these winners, k rows at most, is broadcast: rows of heavy digests get their group without a shuffle. What is left
has groups of at most 1/(k+1) of the rows, and goes through an ordinary shuffle on the digest.

Defined results: a null text counts as empty; the row with the largest id stays, null ids being the smallest; of rows
that also share the id exactly one stays; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm._spark import LOWER, UPPER, Scratch

#: Counters of a Misra-Gries summary, and so the most rows that are ever broadcast.
COUNTERS = 1024


def misra_gries(items: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """A summary with at most ``counters`` entries; it holds every item that makes up over 1/(counters+1) of all."""
    held: dict[bytes, int] = {}
    for x in items:
        if x in held:
            held[x] += 1
        elif len(held) < counters:
            held[x] = 1
        else:
            held = {k: v - 1 for k, v in held.items() if v > 1}
    return held


def _summarise(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    held = misra_gries((x for batch in batches for x in batch.column(0).to_pylist()), counters)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["_digest", "_hits"])


def normalised(text):
    """A text as it is compared: null as empty, A-Z lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept and text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = scratch.save(
        docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("_digest"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    candidates = (
        rows.select("_digest").mapInArrow(partial(_summarise, counters=counters), "_digest binary, _hits long")
        .groupBy("_digest").agg(F.sum("_hits").alias("_hits"))
        .orderBy(F.desc("_hits"), "_digest").limit(counters).select("_digest")
    )
    group = [F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_size")]
    # at most `counters` rows on either side of these broadcasts
    winners = scratch.save(rows.join(F.broadcast(candidates), "_digest").groupBy("_digest").agg(*group))
    heavy = rows.join(F.broadcast(winners), "_digest")
    same = Window.partitionBy("_digest")
    light = rows.join(F.broadcast(winners), "_digest", "left_anti").select("*", *(c.over(same).alias(n) for c, n in zip((F.max(F.struct("_id", "_row")), F.count(F.lit(1))), ("_keep", "_size"))))
    return heavy.select(light.columns).union(light).select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
