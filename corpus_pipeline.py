"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written and
read again before the next stage. All but the last return the columns of ``documents``.

The SimHash stage works on rows, not on ids: of a group it keeps one row, whatever ids are null or shared in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import language_id, toxicity
from pagemill.llm._spark import Scratch, free_name, short_batches
from pagemill.llm.line_dedup import line_dedup
from pagemill.llm.packing import pack
from pagemill.llm.simhash import simhash_dedup

#: A text stays if its best language holds at least this share of the posterior.
LANGUAGE_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not predict to be toxic."""
    short_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(docs["text"], model) < 0.5)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that one language claims; texts that are null or have no letter go."""
    import public_tokenizers as P

    short_batches(spark)
    path = P.path("piece_bpe_32k.model")
    name = free_name("_language", docs.columns)
    found = docs.withColumn(name, language_id.language_of(docs["text"], language_id.fit(docs, path), path))
    return found.where((found[name]["lang"] != language_id.UNKNOWN) & (found[name]["score"] >= LANGUAGE_SHARE)).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; n_chars follows the text."""
    out = line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that of the smallest id, null ids last, and of rows that share it any one."""
    scratch = Scratch(spark, "near-copies")
    row, kept = (free_name(c, docs.columns) for c in ("_row", "_kept"))
    # written, so that a row has the same number whenever it is read
    numbered = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()))
    ids = numbered.select(F.col(row).alias("_row"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("_order"))
    groups = simhash_dedup(numbered.select(row, "text"), id_col=row).select(F.col(row).alias("_row"), F.col("component_id").alias("_group"))
    # a row that is a group of its own is its least already
    first = groups.join(ids, "_row").groupBy("_group").agg(F.min("_order").alias("_least")).select(F.col("_least.row").alias(kept))
    return numbered.join(first.hint("shuffle_hash"), F.col(row) == F.col(kept), "left_semi").drop(row)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences."""
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_languages),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: No SQL expresses the classifiers; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
