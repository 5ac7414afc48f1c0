"""Keyword retrieval over chunks: frequencies, a score like BM25 without length norm, boosts, and the best chunks per field.

Chunks have doc_id, chunk, text, density and has_header. The dictionary of keywords is part of the expression, so nothing is
joined until the counts, which hold a row per (chunk, keyword found).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx


def term_frequencies(chunks: DataFrame, fields: dict[str, Sequence[str]], *more: str) -> DataFrame:
    """A row per chunk, field and keyword that occurs in it."""
    low = F.lower("text")
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(w.lower()).alias("keyword"), tx.hits(low, w.lower()).alias("tf")) for f, ws in fields.items() for w in ws))
    return chunks.select("doc_id", "chunk", *more, F.inline(entries)).where("tf > 0")


def document_frequencies(tf: DataFrame) -> DataFrame:
    """Hits per document and keyword; a keyword of several fields counts once for each."""
    return tf.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("df"))


def scores(chunks: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """(doc_id, chunk, field, score) for chunks and fields with a hit, boosts included."""
    # hits are counted before any shuffle, so texts stay where they are; what follows is partitioned by doc_id
    rows = term_frequencies(chunks, fields, "density", "has_header").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "keyword")))
    rows = rows.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id")
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    raw = rows.groupBy("doc_id", "chunk", "field", "n", "density", "has_header").agg(F.sum(F.col("tf") * idf).alias("raw"))
    i = F.col("chunk")
    place = F.when(i == 0, 1.4).when(i == F.col("n") - 1, 1.3).when(i <= 2, 1.15).when(i >= F.col("n") - 3, 1.1).otherwise(1.0)
    return raw.select("doc_id", "chunk", "field", "n", "raw", (F.col("raw") * place * (1.0 + F.col("density") * 0.3) * F.when(F.col("has_header"), 1.2).otherwise(1.0)).alias("score"))


def retrieve(chunks: DataFrame, scored: DataFrame, limits: dict[str, int], least: float = 0.3) -> DataFrame:
    """Per document and field: the best chunks above ``least``, any with a score if those are under half, and the first and last."""
    k = F.coalesce(*(F.when(F.col("field") == f, n) for f, n in limits.items()))
    rows = scored.where(k.isNotNull()).withColumn("k", k)
    group = Window.partitionBy("doc_id", "field")
    rows = rows.withColumns({"_good": F.count_if(F.col("score") > least).over(group), "rank": F.row_number().over(group.orderBy(F.desc("score"), "chunk"))})
    enough = F.least("_good", "k") >= F.floor(F.col("k") / 2)
    chosen = rows.where((F.col("rank") <= F.col("k")) & F.when(enough, F.col("score") > least).otherwise(F.col("score") > 0)).select("doc_id", "field", "chunk")
    ends = chunks.groupBy("doc_id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    ends = ends.select("doc_id", F.explode(F.array(*map(F.lit, limits))).alias("field"), "a", "b").select("doc_id", "field", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    return chosen.union(ends).distinct()


def covered_pages(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pages of all chunks that a document's fields retrieved; chunks have pages array<int>."""
    return retrieved.select("doc_id", "chunk").distinct().join(chunks.select("doc_id", "chunk", "pages"), ["doc_id", "chunk"]).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))


def pages_of_spans(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks (start_pos, end_pos) and page spans (start_p, end_p) of the same document that overlap; density and header from the pages."""
    hit = chunks.join(spans, "doc_id").where((F.col("start_p") < F.col("end_pos")) & (F.col("end_p") > F.col("start_pos")))
    return hit.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_set("page_no")).alias("pages"), F.max("density").alias("density"), F.bool_or("has_header").alias("has_header"))
