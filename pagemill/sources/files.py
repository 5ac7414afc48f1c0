"""Files as tables: PDFs and their pages, OCR, results, samples and templates.

``pdf_files`` and ``pdf_pages`` go through Spark's own file reader and reach any store that Spark reads; ``formats`` has the same pages as a format of
their own. Rendering pages as images needs an outside library and says so where it is missing.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pagemill.batches import parts
from pagemill.sources import formats
from pagemill.sources.pdf import read_pdf

# Literals in a PDF that call for a warning.
SUSPICIOUS = ["/JavaScript", "/JS", "/Launch", "/EmbeddedFile", "/OpenAction", "/AA", "/RichMedia"]
# First bytes of image kinds.
MAGIC = {b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF8": "image/gif", b"RIFF": "image/webp"}

Parser = Callable[[bytes], tuple[list[str], dict]]
PAGES = "path string, page_no int, total_pages int, text string, meta map<string,string>, error string"


#: Tables up to this size may be dealt out anew; bytes of files that a task is given.
SMALL, TASK = 1 << 30, 16 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one in fewer files than the cluster has cores is dealt out to all of them: a file of one row group is one task, and
    what follows the scan costs far more than a shuffle of so little. Larger tables stay where they are."""
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if int(str(size)) <= SMALL and len(rows.inputFiles()) < cores else rows


def pdf_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, length and content of the PDFs of a folder, by name. Files are dealt out to tasks by their bytes: Spark counts each as 4 MB at least, so
    that small ones are a task for every 32. Files that were written spread are listed by the tasks that read them."""
    spread = spread_files(spark, path, ".pdf")
    if spread is not None:
        return spread if limit is None else spread.orderBy(F.substring_index("path", "/", -1), "path").limit(limit)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "length", "content")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, size // TASK + 1))
    return rows if limit is None else rows.orderBy("path").limit(limit)


def spread_files(spark: SparkSession, path: str, ending: str = "") -> DataFrame | None:
    """path, length and content of files that ``row_files`` wrote spread, or None where there are none."""
    # a folder that pyarrow cannot open holds none
    try:
        found = formats.spread_folders(path)
    except (OSError, ValueError):
        return None
    if not found:
        return None
    formats.register(spark)
    return spark.read.format("spread_files").option("ending", ending).load(path)


def check_path(path: str) -> str:
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return path


def _pages(batches: Iterator[pa.RecordBatch], parser: Parser) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                texts, meta = parser(content)
                rows += [(path, i, len(texts), t, [*meta.items()], None) for i, t in enumerate(texts, 1)]
            except Exception as e:  # noqa: BLE001  a bad file is a row
                rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["path", "page_no", "total_pages", "text", "meta", "error"])


def pdf_pages(files: DataFrame, parser: Parser = read_pdf) -> DataFrame:
    """The pages of PDFs; a file that cannot be read gives a row with its error."""
    return files.select("path", "content").mapInArrow(partial(_pages, parser=parser), PAGES)


def _images(batches: Iterator[pa.RecordBatch], dpi: int, kind: str, only: int | None, most: int) -> Iterator[pa.RecordBatch]:
    import fitz

    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            with fitz.open(stream=content, filetype="pdf") as doc:
                for i in range(min(len(doc), most)):
                    if only in (None, i + 1):
                        rows.append((path, i + 1, doc[i].get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72)).tobytes(kind)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.int32(), pa.binary()))], ["path", "page_no", "image"])


def page_images(files: DataFrame, dpi: int = 150, kind: str = "png", only: int | None = None, most: int = 100) -> DataFrame:
    """Pages rendered as images, or the one page ``only`` (no row if it is not there)."""
    return files.select("path", "content").mapInArrow(partial(_images, dpi=dpi, kind=kind, only=only, most=most), "path string, page_no int, image binary")


def data_url(image: Column) -> Column:
    """An image as text for a request, its kind by its first bytes."""
    kind = F.lit("application/octet-stream")
    for head, name in MAGIC.items():
        kind = F.when(F.substring(image, 1, len(head)) == F.lit(head), name).otherwise(kind)
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(image))


def _ocr(batches: Iterator[pa.RecordBatch], read: Callable[[bytes], tuple[str, float]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for image in batch.column("image").to_pylist():
            try:
                rows.append((*read(image), None))
            except Exception as e:  # noqa: BLE001  a page that fails is empty and goes on
                rows.append(("", 0.0, f"{type(e).__name__}: {e}"))
        text, confidence, error = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("page_no"), pa.array(text, pa.string()), pa.array(confidence, pa.float64()), pa.array(error, pa.string())], ["path", "page_no", "text", "confidence", "error"])


def ocr_pages(images: DataFrame, read: Callable[[bytes], tuple[str, float]]) -> DataFrame:
    return images.select("path", "page_no", "image").mapInArrow(partial(_ocr, read=read), "path string, page_no int, text string, confidence double, error string")


def validation(content: Column, length: Column, most: int, markers: list[str] = SUSPICIOUS) -> Column:
    """Whether bytes are a PDF that may pass, its version, warnings and an estimate of its pages."""
    text = F.decode(content, "ISO-8859-1")  # of the whole file once, for the pages; all else looks at its bytes
    magic = F.substring(content, 1, 5) == F.lit(b"%PDF-")
    error = F.when(length > most, "too large").when(length < 100, "too small").when(~magic, "not a PDF")
    # a marker with other than Latin letters is in no file
    has = [F.when(F.contains(content, F.lit(m.encode("latin-1"))), m) for m in [*markers, "/Encrypt"] if all(c <= "\xff" for c in m)]
    found = F.array_compact(F.array(*has))
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(magic, F.decode(F.substring(content, 6, 3), "ISO-8859-1")).alias("version"), found.alias("warnings"), F.regexp_count(text, F.lit(r"/Type\s*/Page[^s]")).alias("pages"))


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Stored results, one JSON value a file; without a schema all files are read twice."""
    spread = spread_files(spark, path)
    if spread is not None and schema is not None:
        # as an array, which one object is read as too
        found = F.from_json(F.decode("content", "UTF-8"), ArrayType(StructType.fromDDL(schema)))
        return spread.where(F.length("content") > 0).select(F.inline_outer(found))
    if spread is not None:
        return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return spark.read.option("multiLine", True).json(path, schema)


def lookup(folder: str, pattern: str = "{key}_sample.json") -> Callable[[str], dict | None]:
    """A memoised reader of small JSON files by key; absent ones are remembered too."""
    known: dict[str, dict | None] = {}

    def get(key: str) -> dict | None:
        if key not in known:
            path = Path(folder, pattern.format(key=key))
            known[key] = json.loads(path.read_text()) if path.exists() else None
        return known[key]

    return get


def template_rows(spark: SparkSession, folder: str, suffix: str = "_extractor.md") -> DataFrame:
    """Prompt templates by kind of document; join them left and fall back to that of OTHER."""
    rows = spark.read.text(f"{folder}/*{suffix}", wholetext=True).select(F.col("value").alias("template"), "_metadata.file_name")
    return rows.select(F.regexp_extract("file_name", rf"(.*){suffix}$", 1).alias("doc_type"), "template")


def image_text(image: bytes) -> str:
    return base64.b64encode(image).decode()
