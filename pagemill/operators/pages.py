"""Tables of pages: building, assembling, routing to sections, classifying and selecting.

A page table has doc_id, page_no (from 1), total_pages and text. Windows are within a document, so one shuffle on doc_id
serves a whole selection, and Spark reuses it from stage to stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx

# Section rules by kind of document, in order of precedence.
SECTION_RULES = {
    "GUIDELINE": [
        ("recommendations", [r"\brecommend", r"\bguideline", r"\bstatement", r"\bclass\s*i", r"\blevel\s*[abc]", "建议", "推荐", "声明", "指南"]),
        ("evidence", [r"\bevidence", r"\bresults?", r"\btrial", r"\bmeta-?analysis", "证据", "结果", "研究", "试验"]),
        ("conclusion", [r"\bconclusion", r"\bsummary", r"\bdiscussion", "结论", "总结", "讨论"]),
    ],
    "REVIEW": [
        ("results", [r"\bresults?", r"\bfindings?", r"\bmeta-?analysis", r"\bstatistical", "结果", "发现", "显著", "统计"]),
        ("discussion", [r"\bdiscussion", r"\bimplication", "讨论", "意义", "局限"]),
        ("conclusion", [r"\bconclusion", r"\bsummary", "结论", "总结"]),
    ],
    "OTHER": [("key", [r"\bresults?", r"\bconclusion", r"\bsummary", "结果", "结论", "总结"])],
}
# Words that make a document a guideline or a review, in order of precedence.
DOC_TYPES = [("GUIDELINE", ["guideline", "recommendation", "指南", "推荐", "statement"]), ("REVIEW", ["systematic review", "meta-analysis", "系统综述", "meta analysis"])]


def by_doc():
    """The window of a document. A function, as workers import this module without a session."""
    return Window.partitionBy("doc_id")


def page_table(docs: DataFrame, size: int = 200) -> DataFrame:
    """Pages of ``size`` characters; empty and null texts have none."""
    # one pass over the text; an exploded row holds its page, not the whole text. Outer, as an inner one is preceded by a filter that cuts each text twice more
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut_docs = docs.where(F.length("text") > 0).select("doc_id", cut.alias("_pages"))
    numbered = cut_docs.select("doc_id", F.size("_pages").alias("total_pages"), F.posexplode_outer("_pages").alias("_at", "text"))
    return numbered.select("doc_id", (F.col("_at") + 1).alias("page_no"), "total_pages", "text")


def joined(rows: DataFrame, order: str, value: Column, separator: str, name: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The values of each group as one text, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["v"]), separator).alias(name))


def tagged_text(pages: DataFrame, first: int = 200) -> DataFrame:
    """Documents as their pages that are not blank, each behind its marker, and the length of that."""
    kept = pages.where((F.col("page_no") <= first) & (F.length(tx.strip(F.col("text"))) > 0))
    return joined(kept, "page_no", F.concat(F.lit("[p"), F.col("page_no").cast("string"), F.lit("]\n"), F.col("text")), "\n\n").withColumn("char_count", F.length("text"))


def first_pages(pages: DataFrame, first: int, cap: int) -> DataFrame:
    return pages.where(F.col("page_no") <= first).withColumn("text", F.substring("text", 1, cap))


def cited_text(cited: DataFrame, pages: DataFrame, per_page: int = 2500, total: int = 15000) -> DataFrame:
    """The pages (doc_id, page_no) that are cited, as one text with caps per page and in all."""
    rows = pages.join(cited.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")
    return joined(rows, "page_no", F.concat(F.lit("[p"), F.col("page_no").cast("string"), F.lit("]\n"), F.substring("text", 1, per_page)), "\n").withColumn("text", F.substring("text", 1, total))


def text_layer(pages: DataFrame, first: int = 3, least: float = 0.3) -> DataFrame:
    """Coverage of the first pages with text, and whether OCR is called for."""
    coverage = pages.where(F.col("page_no") <= first).groupBy("doc_id").agg(F.avg(tx.has_text_layer(F.col("text")).cast("int")).alias("coverage"))
    return coverage.withColumn("has_text", F.col("coverage") >= least).withColumn("route", F.when(F.col("coverage") < least, "ocr").otherwise("text"))


def doc_type(head: Column, rules: Sequence[tuple[str, Sequence[str]]] = DOC_TYPES) -> Column:
    low, found = F.lower(head), F.lit("OTHER")
    for name, words in reversed(rules):
        found = F.when(tx.holds_any(low, words), name).otherwise(found)
    return found


def classify(pages: DataFrame, rules=DOC_TYPES, first: int = 3, cap: int = 1000, skip: Sequence[str] = tx.SKIP_PATTERNS) -> DataFrame:
    """The type of each document by the first pages that are not skipped."""
    rows = pages.where(~tx.is_skip_page(F.col("text"), skip)).withColumn("_k", F.row_number().over(by_doc().orderBy("page_no"))).where(F.col("_k") <= first)
    return joined(rows, "page_no", F.substring("text", 1, cap), "\n", "head").select("doc_id", doc_type(F.col("head"), rules).alias("doc_type"))


def size_bucket(total: Column, short: int = 15, medium: int = 50) -> Column:
    return F.when(total <= short, "short").when(total <= medium, "medium").otherwise("long")


def strategy(total: Column, medium: int = 50, long: int = 80) -> Column:
    return F.when(total <= medium, F.struct(F.lit("single_short").alias("route"), F.lit(50).alias("pages"))).when(total <= long, F.struct(F.lit("single_long").alias("route"), F.lit(60).alias("pages"))).otherwise(F.struct(F.lit("mapreduce").alias("route"), F.lit(80).alias("pages")))


def summary_strategy(chunks: Column, asked: Column) -> Column:
    return F.when(chunks <= 1, F.when(asked == "auto", "stuff").otherwise(asked)).otherwise(F.when(asked.isin("auto", "stuff"), "map_reduce").otherwise(asked))


# ---- selection

def edges(first: int = 5, last: int = 3) -> Column:
    """The first and last pages of the rows at hand."""
    by = by_doc().orderBy("page_no")
    return (F.row_number().over(by) <= first) | (F.row_number().over(by_doc().orderBy(F.desc("page_no"))) <= last)


def select_by_score(pages: DataFrame, score: Column, most: int, dropped: Column, first: int = 5, last: int = 3) -> DataFrame:
    """Pages that are not dropped, all if they are few; else the raw document's edges and the best others.

    Edge pages count against ``most`` even if they were dropped.
    """
    kept = pages.where(~dropped).withColumns({"score": score, "_n": F.count(F.lit(1)).over(by_doc()), "_edge": (F.col("page_no") <= first) | (F.col("page_no") > F.col("total_pages") - last)})
    rank = F.row_number().over(Window.partitionBy("doc_id", "_edge").orderBy(F.desc("score"), "page_no"))
    quota = most - F.least(F.col("total_pages"), F.lit(first + last))
    return kept.withColumn("_rank", rank).where((F.col("_n") <= most) | F.col("_edge") | (F.col("_rank") <= quota)).drop("_n", "_edge", "_rank")


def select_in_stages(pages: DataFrame, most: int, stages: Sequence[tuple[Column, Sequence[Column], int | None, bool]]) -> DataFrame:
    """All pages if there are few. Else stage by stage the first of those eligible and not yet taken.

    A stage is (eligible, order, limit, whether ``most`` bounds it). The result has the number of the stage.
    """
    rows = pages.withColumns({"_n": F.count(F.lit(1)).over(by_doc()), "stage": F.lit(None).cast("int"), "_taken": F.lit(0).cast("long")})
    for k, (eligible, order, limit, bounded) in enumerate(stages):
        rows = rows.withColumn("_free", F.col("stage").isNull() & eligible)
        rank = F.row_number().over(Window.partitionBy("doc_id", "_free").orderBy(*order, "page_no"))
        room = (F.lit(most) - F.col("_taken")) if bounded else F.lit(1 << 30)
        quota = room if limit is None else F.least(room, F.lit(limit))
        rows = rows.withColumn("_rank", rank).withColumn("stage", F.when(F.col("_free") & (F.col("_rank") <= quota), k).otherwise(F.col("stage")))
        rows = rows.withColumn("_taken", F.count("stage").over(by_doc()))
    return rows.where((F.col("_n") <= most) | F.col("stage").isNotNull()).drop("_n", "_taken", "_free", "_rank")


def priority_stages(name: str) -> tuple[int, list]:
    """(most, stages) of the named selection; pages need the columns priority and edge."""
    by_priority, longest = [F.desc("priority")], [F.desc(F.length("text"))]
    edge, anything = (F.col("edge"), [F.col("page_no")], None, False), F.lit(True)
    return {
        "priority": (60, [edge, (anything, by_priority, None, True), (anything, longest, None, True)]),
        "priority20": (50, [edge, (anything, by_priority, 20, True), (anything, longest, None, True)]),
        "priority5": (50, [edge, (F.col("priority") >= 5, by_priority, 15, False), (anything, longest, None, True)]),
        "hybrid": (50, [(anything, by_priority, 15, True), (anything, longest, None, True)]),
        "forty": (40, [edge, (anything, by_priority, None, True)]),
    }[name]


def top_pages_by_field(pages: DataFrame, fields: dict[str, Sequence[str]], k: int = 8, fallback: int = 15) -> DataFrame:
    """For each field its best pages, in page order; without any hit the first pages."""
    scored = pages.select("doc_id", "page_no", F.explode(tx.field_scores(F.col("text"), fields)).alias("field", "score"))
    group = Window.partitionBy("doc_id", "field")
    ranked = scored.withColumns({"_best": F.max("score").over(group), "_rank": F.row_number().over(group.orderBy(F.desc("score"), "page_no"))})
    return ranked.where(F.when(F.col("_best") > 0, (F.col("score") > 0) & (F.col("_rank") <= k)).otherwise(F.col("page_no") <= fallback)).select("doc_id", "field", "page_no", "score")


def within_budget(pages: DataFrame, per_page: int, total: int, order: Column | None = None) -> DataFrame:
    """Pages in order up to the first that would exceed the budget; later ones are not admitted again."""
    order = F.col("page_no") if order is None else order
    so_far = by_doc().orderBy(order, "page_no")
    rows = pages.withColumn("text", F.substring("text", 1, per_page))
    return rows.withColumn("_sum", F.sum(F.length("text")).over(so_far)).where(F.col("_sum") <= total).drop("_sum")


def classification_pages(pages: DataFrame, score: Column, cues: dict[str, tuple[Column, int]], most: int = 6, near: int = 40, far: int = 80) -> DataFrame:
    """The pages to classify a document by: the first, the best for each cue among the first so many, then by score.

    The pool is the pages up to ``near``, or up to ``far`` where those are fewer than ``most``.
    """
    rows = pages.withColumns({"score": score, "_near": F.count_if(F.col("page_no") <= near).over(by_doc())})
    rows = rows.where(F.col("page_no") <= F.when(F.col("_near") < most, far).otherwise(near))
    must = F.row_number().over(by_doc().orderBy("page_no")) == 1
    for hit, last in cues.values():
        value = F.when(F.col("page_no") <= last, hit).otherwise(0)
        must = must | ((value > 0) & (F.row_number().over(by_doc().orderBy(F.desc(value), "page_no")) == 1))
    rows = rows.withColumn("_must", must)
    place = F.row_number().over(by_doc().orderBy(F.desc("_must"), F.desc("score"), F.desc("page_no")))
    return rows.withColumn("_place", place).where(F.col("_must") | (F.col("_place") <= most)).drop("_near", "_place").withColumnRenamed("_must", "must")


# ---- sections


def section(t: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first section one of whose patterns fits the first five lines, else body."""
    head, found = tx.head_lines(tx.strip(F.lower(t)), 5), F.lit("body")
    for name, patterns in reversed(rules):
        found = F.when(tx.matches_any(head, patterns, "(?U)"), name).otherwise(found)
    return found


def section_buckets(pages: DataFrame, rules) -> DataFrame:
    """Sections of each document in order of their first page."""
    rows = pages.withColumn("section", section(F.col("text"), rules))
    return rows.groupBy("doc_id", "section").agg(F.min("page_no").alias("first_page"), F.count(F.lit(1)).alias("pages"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def detect_sections(lines: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """Sections from each heading line to the next; what stands before the first heading is left out."""
    name = F.lit(None).cast("string")
    for label, pattern in reversed(patterns):
        name = F.when(F.col("line").rlike(pattern), label).otherwise(name)
    last = F.max("line_no").over(by_doc())
    rows = lines.withColumns({"name": name, "_last": last}).where(F.col("name").isNotNull())
    return rows.select("doc_id", "name", F.col("line_no").alias("start_line"), (F.coalesce(F.lead("line_no").over(by_doc().orderBy("line_no")), F.col("_last") + 1) - 1).alias("end_line"))


def three_way(lines: DataFrame, results: str, discussion: str, longest: int = 120) -> DataFrame:
    """Design, evidence and conclusion lines of a document, split at the first short lines that look like headings."""
    short = (F.length(tx.strip(F.col("line"))) <= longest) & ~tx.is_page_marker_line(F.col("line"))
    found = lambda p: F.min(F.when(short & F.lower("line").rlike(p), F.col("line_no")))
    rows = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), found(results).alias("_r"), found(discussion).alias("_d"))
    rows = rows.withColumn("results_at", F.coalesce("_r", F.floor(F.col("n") * 0.4))).withColumn("_d", F.coalesce("_d", F.floor(F.col("n") * 0.75)))
    late = F.least(F.col("n"), F.col("results_at") + F.floor(F.col("n") * 0.2))
    return rows.select("doc_id", "n", "results_at", F.when(F.col("_d") < F.col("results_at"), late).otherwise(F.col("_d")).alias("discussion_at"))


# ---- windows of pages and packing


def page_windows(pages: DataFrame, size: int = 20, overlap: int = 3) -> DataFrame:
    """Overlapping windows over the pages at hand by place: starts every size - overlap places, the redundant tail included."""
    placed = pages.withColumns({"_at": F.row_number().over(by_doc().orderBy("page_no")) - 1, "_n": F.count(F.lit(1)).over(by_doc())})
    step = size - overlap
    latest = F.floor((F.col("_n") - 1) / step)
    lo = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step))
    hi = F.least(latest, F.floor(F.col("_at") / step))
    return placed.where(hi >= lo).withColumn("chunk", F.explode(F.sequence(lo, hi))).drop("_at", "_n")


def page_range_label(chunks: DataFrame, cap: int = 12000) -> DataFrame:
    label = F.concat(F.lit("p"), F.min("page_no").cast("string"), F.lit("-p"), F.max("page_no").cast("string"))
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return chunks.groupBy("doc_id", "chunk").agg(label.alias("page_range"), F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, cap).alias("text"))


def split_by_marker(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"(?=\[p\d+\])"), tx.strip), lambda x: x != "")


def greedy_segments(pages: DataFrame, most: int) -> DataFrame:
    """Consecutive pages packed up to ``most`` estimated tokens; a page that is larger is its own segment."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", tx.token_estimate(F.col("text")).alias("n"))))
    start = F.struct(F.array().cast("array<struct<page_no:int,segment:int>>").alias("out"), F.lit(0).alias("segment"), F.lit(0).alias("sum"))

    def step(acc, p):
        fits = (acc["sum"] == 0) | (acc["sum"] + p["n"] <= most)
        segment = F.when(fits, acc["segment"]).otherwise(acc["segment"] + 1)
        return F.struct(F.concat(acc["out"], F.array(F.struct(p["page_no"], segment.alias("segment")))).alias("out"), segment.alias("segment"), F.when(fits, acc["sum"] + p["n"]).otherwise(p["n"]).alias("sum"))

    return pages.groupBy("doc_id").agg(parts.alias("_p")).select("doc_id", F.inline(F.aggregate("_p", start, step)["out"]))
