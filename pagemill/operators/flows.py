"""Whole extractions and summaries: pages or texts in, prompts and replies between, one JSON value a document out.

What can be said of tables stays a table: selection, windows, prompts and the merge are DataFrame operations, and the only Python
is the call of the generator, the reading of its replies and the fold of a document's JSON parts. No reply is asked for twice:
each flow reads a stage's replies in one plan. A document whose parts all fail comes out with a null value and its error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.batches import parts
from pagemill.functions import json as js
from pagemill.functions import text as tx
from pagemill.operators import chunking, condense
from pagemill.operators import pages as pg
from pagemill.operators.generate import Generator, generate, prompt

# How long a summary is asked to be.
LENGTHS = {"short": "200-300字", "medium": "400-600字", "long": "600-800字"}
# Dates that a summary must not add to its source.
DATES = r"截至\d{4}年\d{1,2}月\d{1,2}日[，,]?|于\d{4}年\d{1,2}月\d{1,2}日[，,]?|\d{1,2}月\d{1,2}日[，,]?"
# What a failed summary says, and what is said of a text too short for one.
FAILED, TOO_SHORT = "摘要生成失败", "PDF内容过短"
# Where a chunk of a long text breaks, best first.
CHUNK_SEPARATORS = ["\n\n", "。\n", ".\n", "\n"]
# Tokens that the parts of a document get on a local model.
PART_TOKENS = {"design": 1536, "evidence": 4096, "conclusion": 1024}


class Lister:
    """A stand-in for tests: a JSON object with a list of the prompt's lines that hold ``mark``, each with the page marker above it."""

    def __init__(self, mark: str, key: str = "items", **more):
        self.mark, self.key, self.more = mark, key, more

    def reply(self, prompt: str, max_tokens: int) -> str:
        found, page = [], None
        for line in prompt.split("\n"):
            if line.startswith("=== p") and line.endswith(" ==="):
                page = line[4:-4]
            elif self.mark in line:
                found.append({"text": line, "sources": [page] if page else []})
        return json.dumps({**self.more, self.key: found}, ensure_ascii=False)


def by_type(doc_type: Column, templates: Mapping[str, str], **columns: Column) -> Column:
    """The prompt of a document's type; other types take the last template."""
    *some, last = (prompt(t, **columns) for t in templates.values())
    found = last
    for name, made in reversed(list(zip(templates, some))):
        found = F.when(doc_type == name, made).otherwise(found)
    return found


def _merge_parts(key: tuple, table: pa.Table) -> pa.Table:
    """The JSON parts of a document in order, merged; parts that failed count, and are an error if none is left."""
    merged, used, tokens, errors = None, 0, 0, []
    for row in table.sort_by("ord").to_pylist():
        tokens += row["tokens"] or 0
        if row["value"] is None:
            errors.append(row["error"] or "no JSON")
            continue
        value, used = json.loads(row["value"]), used + 1
        merged = value if merged is None else condense.deep_merge(merged, value)
    value = None if merged is None else json.dumps(merged, ensure_ascii=False)
    error = errors[0] if merged is None and errors else None
    columns = {"doc_id": pa.int64(), "value": pa.string(), "parts": pa.int64(), "failed": pa.int64(), "tokens": pa.int64(), "error": pa.string()}
    row = (key[0].as_py(), value, used, len(errors), tokens, error)
    return pa.table({name: pa.array([v], t) for (name, t), v in zip(columns.items(), row)})


def merged_replies(replies: DataFrame, order: str) -> DataFrame:
    """One row a document: value, parts read, parts failed, tokens, error. replies: doc_id, reply, error, tokens and the order."""

    def run(key, table):
        return _merge_parts(key, table)

    rows = replies.select("doc_id", F.col(order).cast("long").alias("ord"), js.extracted(F.col("reply")).alias("value"), "error", "tokens")
    return rows.groupBy("doc_id").applyInArrow(run, "doc_id long, value string, parts long, failed long, tokens long, error string")


def marked(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pages as one text, each behind a line with its number."""
    return pg.joined(pages, "page_no", F.concat(F.lit("=== p"), F.col("page_no").cast("string"), F.lit(" ===\n"), F.col("text")), "\n", keys=keys)


def direct_summary(docs: DataFrame, generator: Generator, template: str, length: str = "medium", least: int = 100, max_tokens: int = 1800) -> DataFrame:
    """A summary and key points in one call; dates that the text does not hold are taken out. Texts under ``least`` characters are not asked about."""
    long_enough = F.length(tx.strip(F.coalesce("text", F.lit("")))) >= least
    asked = F.when(long_enough, prompt(template, length=F.lit(LENGTHS.get(length, LENGTHS["medium"])), text=F.col("text")))
    rows = generate(docs.select("doc_id", "text"), asked, generator, max_tokens)
    told = F.from_json(js.or_summary(F.col("reply")), "summary string, key_points array<string>")
    rows = rows.withColumn("_said", told)
    summary = tx.strip(F.regexp_replace(tx.without_unsupported(F.coalesce(F.col("_said.summary"), F.lit("")), F.col("text"), DATES), r"\s+", " "))
    asked_for, answered = F.col("prompt").isNotNull(), F.col("error").isNull()
    return rows.select(
        "doc_id",
        F.when(asked_for, F.when(answered, summary).otherwise(FAILED)).alias("summary"),
        F.when(asked_for, F.when(answered, F.coalesce(F.col("_said.key_points"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).alias("key_points"),
        F.when(~asked_for, F.lit(TOO_SHORT)).otherwise(F.col("error")).alias("error"),
    )


def windowed_extraction(pages: DataFrame, types: DataFrame, generator: Generator, templates: Mapping[str, str], size: int = 25, overlap: int = 3, cap: int = 12_000, max_tokens: int = 4000) -> DataFrame:
    """Selected pages in overlapping windows, a call each, and their JSON merged in the order of the windows. types: doc_id, doc_type."""
    numbered = F.concat(F.lit("=== p"), F.col("page_no").cast("string"), F.lit(" ===\n"), F.col("text"))
    chunks = pg.page_range_label(pg.page_windows(pages.withColumn("text", numbered), size, overlap), cap)
    tasks = chunks.join(types.select("doc_id", "doc_type"), "doc_id", "left")
    asked = by_type(F.col("doc_type"), templates, page_range=F.col("page_range"), text=F.col("text"))
    return merged_replies(generate(tasks, asked, generator, max_tokens, keep=["doc_id", "chunk"]), "chunk")


def scan_blurbs(pages: DataFrame, width: int = 500, cap: int = 8000, least: int = 100, skip=tx.SKIP_PATTERNS) -> DataFrame:
    """A line for each page that is not short or skipped: its number and its beginning; the lines of a document up to ``cap`` characters."""
    kept = pages.where((F.length(tx.strip(F.col("text"))) >= least) & ~tx.is_skip_page_by_first_line(F.col("text"), skip))
    line = F.concat(F.lit("p"), F.col("page_no").cast("string"), F.lit(": "), F.replace(F.substring("text", 1, width), F.lit("\n"), F.lit(" ")))
    return pg.joined(kept, "page_no", line, "\n").withColumn("text", F.substring("text", 1, cap))


def key_pages(reply: Column, total: Column, first: int = 10, last: int = 3, most: int = 30) -> Column:
    """The pages a scan names with the first three and, of more than three pages, the last two; without an answer the first ten and last three."""
    named = F.from_json(js.extracted(reply), "key_pages array<int>")
    ends = F.when(total > 3, F.array(total - 1, total)).otherwise(F.array().cast("array<int>"))
    answered = F.concat(F.coalesce(named["key_pages"], F.array().cast("array<int>")), F.array(*map(F.lit, (1, 2, 3))), ends)
    fallback = F.concat(F.sequence(F.lit(1), F.lit(first)), F.sequence(F.greatest(F.lit(1), total - (last - 1)), total))
    chosen = F.array_sort(F.array_distinct(F.when(named.isNotNull(), answered).otherwise(fallback)))
    return F.slice(F.filter(chosen, lambda p: (p >= 1) & (p <= total)), 1, most)


def scan_then_extract(pages: DataFrame, types: DataFrame, scanner: Generator, extractor: Generator, scan: Mapping[str, str], extract: Mapping[str, str], most: int = 14_000, max_tokens: int = 5000) -> DataFrame:
    """A call that names the key pages, and one over those; texts beyond ``most`` keep their head and tail."""
    totals = pages.groupBy("doc_id").agg(F.max("total_pages").alias("total"))
    tasks = totals.join(scan_blurbs(pages), "doc_id", "left").join(types.select("doc_id", "doc_type"), "doc_id", "left")
    scanned = generate(tasks.select("doc_id", "total", "doc_type", "text"), by_type(F.col("doc_type"), scan, text=F.col("text")), scanner, 200, keep=["doc_id", "total", "doc_type"])
    wanted = scanned.select("doc_id", "doc_type", F.explode(key_pages(F.col("reply"), F.col("total"))).alias("page_no"))
    chosen = marked(pages.select("doc_id", "page_no", "text").join(wanted, ["doc_id", "page_no"]), ("doc_id", "doc_type"))
    head = int(most * 0.65)
    asked = by_type(F.col("doc_type"), extract, text=tx.head_and_tail(F.col("text"), most, head, most - head - 50, "\n...(省略)...\n"))
    return merged_replies(generate(chosen.select("doc_id", "doc_type", "text", F.lit(0).alias("chunk")), asked, extractor, max_tokens, keep=["doc_id", "chunk"]), "chunk")


def three_stages(pages: DataFrame, classifier: Generator, reader: Generator, merger: Generator, templates: Mapping[str, str], per_page: Mapping[str, str], first: int = 5) -> DataFrame:
    """Type and metadata of the first pages, a call for each of these pages by type, and a call that merges: calls are 2 and the pages.

    templates: ``classify`` with {text}, ``merge`` with {metadata} and {pages}; a document whose first stage gives no JSON ends there.
    """
    head = pages.where(F.col("page_no") <= first)
    both = F.array_sort(F.collect_list(F.struct("page_no", F.col("text").alias("page"))))
    text = F.array_join(F.transform("_pages", lambda p: F.concat(F.lit("=== p"), p["page_no"].cast("string"), F.lit(" ===\n"), p["page"])), "\n")
    stage1 = generate(head.groupBy("doc_id").agg(both.alias("_pages")), prompt(templates["classify"], text=text), classifier, 1000)
    said = js.extracted(F.col("reply"))
    stage1 = stage1.select("doc_id", "_pages", said.alias("_said"), F.col("tokens").alias("_t1")).select(
        "doc_id", "_pages", "_t1", F.col("_said").isNotNull().alias("_ok"), F.coalesce(F.get_json_object("_said", "$.type"), F.lit("OTHER")).alias("doc_type"), F.coalesce(F.get_json_object("_said", "$.metadata"), F.lit("{}")).alias("metadata"),
    )
    rows = stage1.select("doc_id", "_ok", "doc_type", "metadata", "_t1", F.inline("_pages"))
    asked = F.when(F.col("_ok"), by_type(F.col("doc_type"), per_page, page_no=F.col("page_no"), text=F.col("page")))
    stage2 = generate(rows, asked, reader, 2000).withColumn("value", js.extracted(F.col("reply")))
    results = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("value", F.lit("{}")).alias("v"))))
    stage2 = stage2.groupBy("doc_id", "_ok", "doc_type", "metadata", "_t1").agg(F.array_join(F.transform(results, lambda r: r["v"]), "\n").alias("pages"), F.sum("tokens").alias("_t2"), F.count(F.lit(1)).alias("_n"))
    asked = F.when(F.col("_ok"), prompt(templates["merge"], metadata=F.col("metadata"), pages=F.col("pages")))
    stage3 = generate(stage2, asked, merger, 4000)
    return stage3.select(
        "doc_id", F.when(F.col("_ok"), F.col("doc_type")).alias("doc_type"), js.extracted(F.col("reply")).alias("value"),
        F.when(F.col("_ok"), F.col("_n") + 2).otherwise(1).cast("long").alias("calls"), (F.col("_t1") + F.when(F.col("_ok"), F.col("_t2") + F.col("tokens")).otherwise(0)).alias("tokens"),
        F.when(~F.col("_ok"), F.lit("stage 1 failed")).otherwise(F.col("error")).alias("error"),
    )


def routed_extraction(docs: DataFrame, classified: DataFrame, generator: Generator, templates: Mapping[str, str], size: int = 28_000, overlap: int = 3000) -> DataFrame:
    """Each text by the template of its type, long ones in chunks whose JSON is merged in order. classified: doc_id, doc_type, upstream (JSON or null)."""
    cut = chunking.chunks(docs.where(F.length("text") > 0), chunking.chunker("sliding", size=size, overlap=overlap, separators=CHUNK_SEPARATORS))
    n = F.count(F.lit(1)).over(pg.by_doc())
    tasks = cut.select("doc_id", "chunk", "text", n.alias("_n")).join(classified.select("doc_id", "doc_type", "upstream"), "doc_id", "left")
    place = F.when(F.col("_n") > 1, F.concat(F.lit("["), (F.col("chunk") + 1).cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit("] "), F.coalesce("doc_type", F.lit("OTHER")), F.lit("\n\n"))).otherwise("")
    asked = F.concat(place, F.coalesce(F.concat(F.col("upstream"), F.lit("\n\n")), F.lit("")), by_type(F.col("doc_type"), templates, text=F.col("text")))
    return merged_replies(generate(tasks, asked, generator, 8192), "chunk")


def overlay(unified: dict, parts: Mapping[str, object], guideline: bool) -> dict:
    """Metadata and conclusions of the parts win key by key; a part's list of items replaces the other's if it is longer."""
    out = dict(unified)
    for name, part in (("doc_metadata", "metadata"), ("conclusions", "conclusions")):
        if isinstance(parts.get(part), dict) and parts[part]:
            out[name] = {**(out[name] if isinstance(out.get(name), dict) else {}), **parts[part]}
    name, part = ("recommendations", "recommendations") if guideline else ("key_findings", "findings")
    items, old = parts.get(part), out.get(name)
    if isinstance(items, list) and len(items) > len(old if isinstance(old, list) else []):
        out[name] = items
    return out


def _overlays(unified: pd.Series, parts: pd.Series, guideline: pd.Series) -> pd.Series:
    def one(u, p, g):
        if u is None:
            return None
        return json.dumps(overlay(json.loads(u), {k: json.loads(v) for k, v in dict(p or {}).items() if v}, bool(g)), ensure_ascii=False)

    return pd.Series([one(*row) for row in zip(unified, parts, guideline)], dtype=object)


def hybrid_union(unified: DataFrame, fields: DataFrame, types: DataFrame) -> DataFrame:
    """A document's unified value with what its fields gave on their own laid over it. unified: doc_id, value; fields: doc_id, field, value."""
    parts = fields.where("value IS NOT NULL").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_parts"))
    rows = unified.select("doc_id", "value").join(parts, "doc_id", "left").join(types.select("doc_id", "doc_type"), "doc_id", "left")
    over = F.pandas_udf(_overlays, "string")
    return rows.select("doc_id", over("value", "_parts", F.coalesce(F.col("doc_type") == "GUIDELINE", F.lit(False))).alias("value"))


def quoted(items: DataFrame) -> DataFrame:
    """Items whose quotation is there; one that is blank or missing does not count."""
    return items.where(F.length(tx.strip(F.coalesce("quote", F.lit("")))) > 0)


def sample_documents(docs: DataFrame, generator: Generator, template: str, kind: str = "doc_type") -> DataFrame:
    """An annotated sample of each type: its first document, by id, whole, in one call."""
    first = docs.groupBy(kind).agg(F.min("doc_id").alias("doc_id"))
    rows = docs.select(kind, "doc_id", "text").join(first, [kind, "doc_id"], "left_semi")
    return generate(rows, prompt(template, doc_type=F.col(kind), text=F.col("text")), generator, 4000).select(kind, "doc_id", js.extracted(F.col("reply")).alias("sample"), "error")


def parts_of_lines(lines: DataFrame, results: str, discussion: str) -> DataFrame:
    """Design, evidence and conclusion of each document as texts of their lines, in order; parts without lines are left out."""
    cuts = pg.three_way(lines, results, discussion)
    part = F.when(F.col("line_no") < F.col("results_at"), "design").when(F.col("line_no") < F.col("discussion_at"), "evidence").otherwise("conclusion")
    rows = lines.join(cuts.select("doc_id", "results_at", "discussion_at"), "doc_id").withColumn("part", part)
    return pg.joined(rows, "line_no", F.col("line"), "\n", keys=("doc_id", "part"))


def extraction_by_parts(lines: DataFrame, generators: Mapping[str, Generator], templates: Mapping[str, str], results: str, discussion: str) -> DataFrame:
    """A call for each part of a document with that part's budget of tokens, and the JSON of the parts merged in code."""
    parts, out = parts_of_lines(lines, results, discussion), None
    for k, (name, most) in enumerate(PART_TOKENS.items()):
        asked = generate(parts.where(F.col("part") == name), prompt(templates[name], text=F.col("text")), generators[name], most).withColumn("ord", F.lit(k))
        out = asked if out is None else out.union(asked)
    return merged_replies(out, "ord")


def _count_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for batch in parts(batches):
        ids, texts = batch.columns
        counts = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64())], ["doc_id", "tokens"])


def exact_tokens(docs: DataFrame, path: str) -> DataFrame:
    """The tokens of each text by the model's own tokenizer, read from ``path``; a null text has none."""
    return docs.select("doc_id", "text").mapInArrow(partial(_count_tokens, path=path), "doc_id long, tokens long")
