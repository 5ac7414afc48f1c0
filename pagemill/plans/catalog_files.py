"""Queries over files: documents written as PDF, DOCX and JSON files, which are then scanned, validated and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.batches import parts
from pagemill.operators import pages
from pagemill.plans.catalog import PAGE, PAGES_SQL, add, documents, strip_sql
from pagemill.sources import files, formats, sinks
from pagemill.sources.docx import read_docx
from pagemill.sources.pdf import write_pages
from pagemill.storage import shared_folder

NAME = lambda: F.format_string("%012d", F.col("doc_id"))
NUMBER = lambda path: F.regexp_extract(path, r"(\d{12})\.\w+$", 1).cast("long")


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([f"{n}.pdf" for n in names], pa.string()), pa.array([write_pages(t, {"Title": n}) for n, t in zip(names, texts)], pa.binary())], ["name", "content"])


def written(spark: SparkSession, rows: DataFrame) -> str:
    """The folder of these files, which are as many as the rows: spread, so that no one process lists, names or moves them all."""
    formats.register(spark)
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.write.format("row_files").option("spread", True).mode("append").save(folder)
    return folder


def pdf_folder(spark: SparkSession, sf: str) -> str:
    """A PDF of each document's pages; documents without text have none."""
    rows = documents(spark, sf).where(F.length("text") > 0).select(NAME().alias("name"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)).alias("pages"))
    return written(spark, rows.mapInArrow(_paged, "name string, content binary"))


def sc1(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.format("pdf_pages").option("max_pages", 100_000).load(pdf_folder(spark, sf))
    return rows.select(NUMBER("path").alias("doc_id"), "page_no", "total_pages", "text", "error")


def sc2(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.pdf_pages(files.pdf_files(spark, pdf_folder(spark, sf)))
    return rows.groupBy(NUMBER("path").alias("doc_id")).agg(F.count("page_no").alias("pages"), F.sum(F.length("text")).alias("chars"), F.max(F.col("meta")["Title"]).alias("title"))


def sc10(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.format("pdf_pages").option("limit", 25).load(pdf_folder(spark, sf))
    return rows.select(NUMBER("path").alias("doc_id")).distinct()


def fl11(spark: SparkSession, sf: str) -> DataFrame:
    found = files.pdf_files(spark, pdf_folder(spark, sf)).select(NUMBER("path").alias("doc_id"), files.validation(F.col("content"), F.col("length"), 50 << 20).alias("v"))
    return found.select("doc_id", "v.valid", "v.error", "v.version", F.col("v.pages").alias("pages"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """A document as the record of its summary, which is its whole text."""
    return documents(spark, sf).select(
        NAME().alias("name"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source_filename"), F.when(F.col("lang") == "es", "zh").otherwise(F.col("lang")).alias("language"), F.col("source").alias("style"),
        F.col("n_chars").alias("original_length"), (F.col("n_chars") * 7).alias("word_count"), F.lit(1.5).alias("processing_time"), (F.col("doc_id") % 3 == 0).alias("is_medical"),
        F.lit(3).alias("chunks_processed"), F.lit("direct").alias("strategy"), F.lit("2026-01-02T03:04:05").alias("created_at"), F.col("text").alias("summary"),
    )


FACTS_SQL = """[['源文件', 'doc ' || doc_id], ['语言', CASE WHEN lang = 'es' THEN '中文' ELSE 'English' END], ['摘要风格', source], ['原文长度', format('{:,}', n_chars) || ' 字符'], ['摘要字数', format('{:,}', n_chars * 7)], ['处理耗时', '1.5s']"""
TITLE_SQL = "CASE WHEN doc_id % 3 = 0 THEN '医学文献摘要报告' ELSE '文档摘要报告' END"


def sk3(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    folder = written(spark, sinks.export_files(rows.drop("name"), F.format_string("%012d", F.substring("source_filename", 5, 20).cast("long")), "pdf"))
    read = spark.read.format("pdf_pages").option("max_pages", 100_000).load(folder).select(NUMBER("path").alias("doc_id"), "page_no", "text")
    return pages.joined(read, "page_no", F.col("text"), "").select("doc_id", "text")


def _docx_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        found = [read_docx(c) for c in batch.column(1).to_pylist()]
        columns = [pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array(["\n".join("\t".join(r) for r in t) for _, t in found], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["path", "paragraphs", "facts"])


def sk4(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    folder = written(spark, sinks.export_files(rows.drop("name"), F.format_string("%012d", F.substring("source_filename", 5, 20).cast("long")), "docx"))
    read = spark.read.format("spread_files").option("ending", ".docx").load(folder).select("path", "content").mapInArrow(_docx_parts, "path string, paragraphs array<string>, facts string")
    return read.select(NUMBER("path").alias("doc_id"), "facts", F.array_join("paragraphs", "|").alias("text"))


def sk7(spark: SparkSession, sf: str) -> DataFrame:
    content = F.to_json(F.struct("doc_id", "lang", "text"))
    folder = written(spark, documents(spark, sf).select(F.concat(NAME(), F.lit(".json")).alias("name"), content.cast("binary").alias("content")))
    return files.read_results(spark, folder, "doc_id long, lang string, text string").select("doc_id", "lang", "text")


def plain_sql(t: str) -> str:
    """Without characters that XML cannot hold."""
    return rf"regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0D\x0E-\x1F]', ' ', 'g')"


add("sc1_pdf_pages", sc1, f"WITH {PAGES_SQL} SELECT doc_id, page_no, total_pages, text, CAST(NULL AS VARCHAR) AS error FROM pages_d")
add("sc2_pdf_bytes", sc2, f"WITH {PAGES_SQL} SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS title FROM pages_d GROUP BY doc_id")
add("sc10_listing", sc10, "SELECT doc_id FROM documents WHERE length(text) > 0 ORDER BY doc_id LIMIT 25")
add("fl11_validation", fl11, f"WITH {PAGES_SQL} SELECT doc_id, true AS valid, CAST(NULL AS VARCHAR) AS error, '1.5' AS version, count(*) AS pages FROM pages_d GROUP BY doc_id")
add(
    "sk3_pdf_export", sk3,
    f"SELECT doc_id, {TITLE_SQL} || chr(10) || '基本信息' || chr(10) || array_to_string(list_transform({FACTS_SQL}, ['生成时间', '2026-01-02 03:04:05']], lambda f: f[1] || chr(9) || f[2] || chr(10)), '') || '摘要内容' || chr(10) || CASE WHEN {strip_sql('text')} <> '' THEN text || chr(10) || chr(10) ELSE '' END || '本摘要由系统自动生成' || chr(10) AS text FROM documents",
)
add(
    "sk4_docx_export", sk4,
    f"SELECT doc_id, array_to_string(list_transform({FACTS_SQL}, ['分块数', '3'], ['处理策略', 'direct'], ['生成时间', '2026-01-02 03:04:05']], lambda f: f[1] || chr(9) || f[2]), chr(10)) AS facts, array_to_string([{TITLE_SQL}, '基本信息', '', '摘要内容'] || CASE WHEN {strip_sql('text')} <> '' THEN [{plain_sql(strip_sql('text'))}] ELSE [] END || ['', '本摘要由系统自动生成'], '|') AS text FROM documents",
)
add("sk7_json_files", sk7, "SELECT doc_id, lang, text FROM documents")
