"""Exporters and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.batches import parts
from pagemill.sources.docx import write_docx
from pagemill.sources.pdf import write_report

MIME = {"json": "application/json", "markdown": "text/markdown", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def json_envelope(data: Column, at: Column) -> Column:
    return F.to_json(F.struct(F.lit("1.0").alias("version"), at.alias("export_time"), data.alias("data")))


def markdown(title: Column, words: Column, source: Column, summary: Column) -> Column:
    """A document's summary as Markdown; the source line only where there is one."""
    line = lambda name, v: F.concat(F.lit(f"- **{name}**: "), v)
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), line("words", F.format_number(words, 0)), F.when(source.isNotNull(), line("source", source)), F.lit(""), summary)


def write_by_type(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("doc_type").json(path)


def batch_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("success"))


def report(summary: list[dict], errors: list[str]) -> str:
    """A small aggregate as a Markdown report."""
    head = [*summary[0]] if summary else []
    table = ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(str(r[k]) for k in head) + " |" for r in summary)] if head else []
    return "\n".join(["# Evaluation", "", *table, "", "## Errors", "", *(f"- {e}" for e in errors or ["none"])])


def _json(record: dict) -> bytes:
    return json.dumps({"version": "1.0", "export_time": datetime.now(UTC).isoformat(), "data": record}, ensure_ascii=False, indent=2).encode()


def _markdown(record: dict) -> bytes:
    info = [f"- **{k}**: {v:,}" if isinstance(v, int) else f"- **{k}**: {v}" for k, v in record.items() if k not in ("title", "summary")]
    return "\n".join([f"# {record.get('title') or 'Summary'}", "", *info, "", str(record.get("summary", ""))]).encode()


# The words of a report but its last line, and its facts in order (of a PDF those without the parts and the way).
TITLES = ("文档摘要报告", "医学文献摘要报告")
TABLE, BODY, FOOTER = "基本信息", "摘要内容", "本摘要由系统自动生成"
UNKNOWN, LANGUAGES = "未知", {"zh": "中文"}


def facts(record: dict, whole: bool) -> list[tuple[str, str]]:
    """The table of a record: what is known of the source, the summary and how it was made."""
    n = lambda k: f"{int(record.get(k) or 0):,}"
    out = [
        ("源文件", str(record.get("source_filename") or UNKNOWN)), ("语言", LANGUAGES.get(record.get("language"), "English")), ("摘要风格", str(record.get("style") or "")),
        ("原文长度", f"{n('original_length')} 字符"), ("摘要字数", n("word_count")), ("处理耗时", f"{record.get('processing_time') or 0}s"),
    ]
    if whole:
        out += [("分块数", str(record.get("chunks_processed") or 0)), ("处理策略", str(record.get("strategy") or ""))]
    return [*out, ("生成时间", str(record.get("created_at") or "").replace("T", " ")[:19])]


def paragraphs(record: dict) -> list[str]:
    return [p for p in str(record.get("summary") or "").split("\n\n") if p.strip()]


def _pdf(record: dict) -> bytes:
    info = {"Title": str(record.get("title") or record.get("source_filename") or UNKNOWN)}
    return write_report(TITLES[bool(record.get("is_medical"))], facts(record, False), BODY, paragraphs(record), info, TABLE, FOOTER)


def _docx(record: dict) -> bytes:
    return write_docx(TITLES[bool(record.get("is_medical"))], facts(record, True), BODY, [p.strip() for p in paragraphs(record)], TABLE, FOOTER)


def _exported(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        rows = [(f"{name}.{extension}", content) for name, (content, _, extension) in ((r.pop("_name"), export(r, kind)) for r in batch.to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 2, (pa.string(), pa.binary()))], ["name", "content"])


def export_files(records: DataFrame, name: Column, kind: str) -> DataFrame:
    """A row per record with the name and content of its file, for the format ``row_files``."""
    if kind.lower() not in exporters():
        raise ValueError(f"unknown format {kind}")
    return records.select(name.alias("_name"), "*").mapInArrow(partial(_exported, kind=kind), "name string, content binary")


def exporters() -> dict[str, tuple[Callable[[dict], bytes], str, str]]:
    """Writers by name."""
    docx = (_docx, MIME["docx"], "docx")
    markdown_ = (_markdown, MIME["markdown"], "md")
    return {"json": (_json, MIME["json"], "json"), "markdown": markdown_, "md": markdown_, "pdf": (_pdf, MIME["pdf"], "pdf"), "docx": docx, "word": docx}


def export(record, kind: str = "json") -> tuple[bytes, str, str]:
    """(bytes, media type, extension) of a record (a dict, a Row or a dataclass); unknown kinds raise."""
    known = exporters()
    if kind.lower() not in known:
        raise ValueError(f"unknown format {kind}; there are {', '.join(sorted(known))}")
    record = record.asDict(True) if hasattr(record, "asDict") else dict(record) if isinstance(record, dict) else vars(record)
    record = {"created_at": datetime.now(UTC).isoformat(), "metadata": {}} | {k: v for k, v in record.items() if v is not None}
    writer, mime, extension = known[kind.lower()]
    return writer(record), mime, extension
