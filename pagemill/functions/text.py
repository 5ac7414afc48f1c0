"""Scalar text functions and predicates as column builders.

They are expressions of built-in functions only, so they stay inside generated code and can be pushed around by Catalyst.
Character classes are spelled out (``WORD``, ``SPACE``) rather than left to a regular-expression dialect. Every
word list and pattern list is a parameter with the usual default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x{85}\p{Z}]"
CJK = r"[\x{4E00}-\x{9FFF}]"
CJK_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"

# Patterns that mark pages to skip, title words, section headings and keywords of page scores.
SKIP_PATTERNS = [r"^(table of contents|contents|目录)", r"^(references?|bibliography|参考文献)", r"^(appendix|附录)"]
RETRIEVAL_SKIP_PATTERNS = [
    r"^table\s+of\s+contents?$", r"^contents?$", r"^目录$", r"^references?$", r"^bibliography$", r"^参考文献$", r"^appendix\s*[a-z0-9]*$", r"^附录",
    r"^index$", r"^acknowledgement", r"^致谢", r"^abbreviations?$", r"^缩略语", r"^glossary$", r"^术语表", r"^list\s+of\s+(tables?|figures?)",
]
TITLE_PATTERNS = [r"\babstract\b", r"\bintroduction\b", r"\bmethods?\b", r"\bresults?\b", r"\bdiscussion\b", r"\bconclusions?\b", r"\bsummary\b", r"\brecommend", "摘要", "引言", "方法", "结果", "讨论", "结论", "建议", "推荐"]
HEADER_PATTERNS = [r"^\d+\.?\s+[A-Z]", r"^\d+\.\d+\.?\s+[A-Z]", r"^Chapter\s+\d+", r"^Section\s+\d+", r"^第[一二三四五六七八九十\d]+[章节]", r"^[一二三四五六七八九十]+[、.]\s*\S"]
GUIDELINE_WORDS = ["recommend", "should", "must", "class i", "class ii", "level a", "level b", "建议", "必须"]
OTHER_WORDS = ["result", "finding", "significant", "p<", " ci ", " or ", " rr ", "显著"]
CONTENTS_WORDS = ["contents", "table of contents", "目录"]
UNSET = ["unknown", "未报告", "not_found"]


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def hits(t: Column, word: str) -> Column:
    """How often a word stands in a text, without overlaps and as it is spelled."""
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / len(word)).cast("int")


def capped_hits(t: Column, words: Sequence[str], cap: int) -> Column:
    return sum((F.least(hits(t, w), F.lit(cap)) for w in words), F.lit(0))


def holds_any(t: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(t, F.lit(w))
    return found


def matches_any(t: Column, patterns: Sequence[str], flags: str = "") -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | t.rlike(flags + p)
    return found


def head_lines(t: Column, n: int) -> Column:
    """The first n lines as one text."""
    return F.substring_index(t, "\n", n)


# ---- tests of a page


def is_empty_page(t: Column, least: int = 100) -> Column:
    return F.length(F.regexp_replace(t, f"{SPACE}+", "")) < least


def is_skip_page(t: Column, patterns: Sequence[str] = SKIP_PATTERNS, lines: int = 5) -> Column:
    """A pattern fits the head of the page (``^`` is the page's beginning), or over ten lines end like a table of contents."""
    return matches_any(head_lines(strip(F.lower(t)), lines), patterns) | (F.regexp_count(t, F.lit(r"(?m)\.\s*\d{1,3}\s*$")) > 10)


def is_skip_page_by_first_line(t: Column, patterns: Sequence[str] = SKIP_PATTERNS) -> Column:
    return matches_any(head_lines(strip(F.lower(t)), 1), patterns)


def is_contents_page(t: Column, page_no: Column, words: Sequence[str] = CONTENTS_WORDS, leaders: int = 10, numbered: int = 15) -> Column:
    lines = F.split(strip(t), "\n")
    ends = F.size(F.filter(lines, lambda x: x.rlike(f"[0-9]{{1,3}}{SPACE}*$")))
    return (page_no <= 15) & ((F.regexp_count(t, F.lit(r"\.{3,}|(\.\s){3,}")) > leaders) | (ends > numbered) | holds_any(F.lower(head_lines(strip(t), 5)), words))


def is_retrieval_skip_page(t: Column, page_no: Column, total: Column, patterns: Sequence[str] = RETRIEVAL_SKIP_PATTERNS, words: Sequence[str] = CONTENTS_WORDS) -> Column:
    cited = F.regexp_count(t, F.lit(r"\(\d{4}\)|\d{4}[;,]|\[\d+\]")) > 15
    return (F.length(strip(t)) < 80) | is_contents_page(t, page_no, words) | matches_any(head_lines(strip(t), 3), patterns, "(?i)") | (cited & (page_no > total * 0.7))


def is_key_page(t: Column, page_no: Column, total: Column, words: Sequence[str]) -> Column:
    return (page_no <= 2) | (page_no >= total - 1) | holds_any(F.substring(F.lower(t), 1, 1500), words)


def has_text_layer(t: Column) -> Column:
    return F.length(strip(t)) > 50


def is_usable(first_page: Column, total: Column, dead_links: Sequence[str]) -> Column:
    return F.when(total < 2, (F.length(strip(first_page)) > 100) & ~holds_any(F.lower(first_page), dead_links)).otherwise(F.lit(True))


def markers_found(t: Column, markers: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(t, m))


def has_extension(name: Column, extension: str = ".pdf") -> Column:
    return F.coalesce(F.lower(name).endswith(extension), F.lit(False)) & (F.length(name) > 0)


def is_page_marker_line(line: Column) -> Column:
    return strip(line).rlike(r"^\[(p|Page\s+)\d+\]$")


def filled_fields(values: Sequence[Column], unset: Sequence[str] = UNSET) -> Column:
    return sum((F.when(v.isNotNull() & (v != "") & ~v.isin(*unset), 1).otherwise(0) for v in values), F.lit(0))


# ---- numbers about a text


def token_estimate(t: Column) -> Column:
    latin = F.regexp_replace(t, CJK_WIDE, "")
    words = F.regexp_count(latin, F.lit(rf"[^\s\x0B\x{{85}}\p{{Z}}]+"))
    signs = F.regexp_count(t, F.lit(r"[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]"))
    total = F.regexp_count(t, F.lit(CJK_WIDE)) * 1.8 + words * 1.3 + signs * 0.5
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0).otherwise(F.greatest(F.floor(total).cast("int"), F.lit(1)))


def tokens_to_chars(n: Column, chinese: bool = True) -> Column:
    return F.floor(n / F.lit(1.8 if chinese else 0.3)).cast("long")


def prompt_budget(t: Column, wanted: int, context: int = 16384, per_token: float = 1.2) -> Column:
    free = F.lit(context - 100) - F.floor(F.length(t) / F.lit(per_token)).cast("int")
    return F.when(free < wanted, F.greatest(F.lit(1000), free)).otherwise(F.lit(wanted))


def content_density(t: Column) -> Column:
    words = F.regexp_extract_all(t, F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-zA-Z]{{3,}}(?![\p{{L}}\p{{N}}_])|{CJK}+"), 0)
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    shown = F.length(F.regexp_replace(t, f"{SPACE}+", ""))
    dotted = F.when(F.regexp_count(t, F.lit(r"\.{3,}")) > 5, 0.3).otherwise(1.0)
    return F.when(shown == 0, 0.0).otherwise(F.least(F.lit(1.0), letters / shown * dotted))


def has_section_header(t: Column, patterns: Sequence[str] = HEADER_PATTERNS) -> Column:
    return matches_any(t, patterns, "(?m)")


def page_score(t: Column, page_no: Column, total: Column, words: Sequence[str], titles: Sequence[str] = TITLE_PATTERNS) -> Column:
    low = F.lower(t)
    title = F.when(matches_any(head_lines(low, 5), titles, "(?U)"), 4.0).otherwise(0.0)
    edge = F.when((page_no <= 5) | (page_no > total - 3), 2.0).otherwise(0.0)
    return title + capped_hits(low, words, 3) * 0.5 + F.least(F.length(t) / F.lit(2000), F.lit(3.0)) + edge


def page_priority(t: Column, page_no: Column, total: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """The best of the weights of the patterns that fit the first five lines, and 3 for the first and last three pages."""
    head = head_lines(F.lower(t), 5)
    best = F.greatest(F.lit(0), F.lit(0), *(F.when(head.rlike(p), n).otherwise(0) for p, n in patterns))
    return best + F.when((page_no <= 3) | (page_no > total - 3), 3).otherwise(0)


def field_scores(t: Column, fields: dict[str, Sequence[str]], cap: int = 5) -> Column:
    low = F.lower(t)
    return F.create_map(*(x for name, words in fields.items() for x in (F.lit(name), capped_hits(low, words, cap))))


def classification_score(t: Column, weighted: Sequence[tuple[str, float]], boilerplate: Sequence[str]) -> Column:
    low = F.lower(t)
    score = F.regexp_count(t, F.lit(r"[0-9]")) * 0.08 + hits(t, "%") * 4.0 + F.regexp_count(low, F.lit(r"per\s+100,?000")) * 8.0 + F.least(F.length(t), F.lit(4000)) / F.lit(2500.0)
    for word, weight in weighted:
        score = score + hits(low, word) * float(weight)
    return F.when(F.length(strip(t)) == 0, -1.0).otherwise(score - capped_hits(low, boilerplate, 1 << 20) * 2.0)


def paragraph_importance(t: Column, statistics: Sequence[str], conclusions: Sequence[str]) -> Column:
    score = sum((F.when(t.rlike("(?i)" + p), w).otherwise(0.0) for w, ps in ((2.0, statistics), (1.5, conclusions)) for p in ps), F.lit(0.0))
    score = score + F.when(F.regexp_count(t, F.lit(r"[0-9]+(\.[0-9]+)?")) > 3, 1.0).otherwise(0.0)
    return F.when(F.length(t) < 100, score * 0.5).otherwise(score)


def word_count(t: Column, lang: Column) -> Column:
    return F.when(lang == "zh", F.length(t)).otherwise(F.regexp_count(t, F.lit(rf"[^\s\x0B\x{{85}}\p{{Z}}]+")))


def chunk_count(t: Column, size: int, overlap: int) -> Column:
    return F.when(F.length(t) <= size, 1).otherwise(F.floor((F.length(t) - overlap) / (size - overlap)).cast("int") + 1)


def compression_ratio(out: Column, source: Column) -> Column:
    """Rounded half to even on two places."""
    return F.when(F.length(source) > 0, F.bround(F.length(out) / F.length(source), 2)).otherwise(0.0)


def megabytes(n: Column) -> Column:
    return F.bround(n / F.lit(1048576.0), 2)


def coverage(pages: Column, total: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(pages)) / F.nullif(total, F.lit(0)), F.lit(0.0))


# ---- texts from texts


def whitespace_normal(t: Column) -> Column:
    return F.lower(strip(F.regexp_replace(t, f"{SPACE}+", " ")))


def item_key(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), f"[^{WORD[1:-1]}]+", "")


def short_page_markers(t: Column) -> Column:
    return F.regexp_replace(t, r"\[Page\s+(\d+)\]", "[p$1]")


def page_markers(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"\[p(\d+)\]"), 1)


def source_page(t: Column) -> Column:
    return F.when(t.rlike(r"(?i)p?\d+"), F.concat(F.lit("p"), F.regexp_extract(t, r"(?i)p?(\d+)", 1)))


def coerced_sources(one: Column, several: Column, numbers: Column) -> Column:
    """A list of sources from a text, a list of texts or a list of page numbers, whichever is given."""
    return F.coalesce(several, F.transform(numbers, lambda n: F.concat(F.lit("p"), n.cast("string"))), F.when(F.length(one) > 0, F.array(one)), F.array().cast("array<string>"))


def page_range(t: Column, total: Column, first: int = 3, last: int = 2, longer_than: int = 5) -> Column:
    """The pages that ``pA``, ``pA-pB`` and ``pA-B`` name, the first few, the last few of longer documents; in order, inside the document."""
    span = lambda m: F.sequence(
        F.regexp_extract(m, r"p(\d+)", 1).cast("int"),
        F.greatest(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(m, r"-\s*p?(\d+)", 1), F.lit("")), F.lit("999999")).cast("int"), F.regexp_extract(m, r"p(\d+)", 1).cast("int")), F.regexp_extract(m, r"p(\d+)", 1).cast("int")),
    )
    named = F.flatten(F.transform(F.regexp_extract_all(F.lower(t), F.lit(r"p\d{1,6}(\s*-\s*p?\d{1,6})?"), 0), span))
    head = F.sequence(F.lit(1), F.lit(first))
    tail = F.when(total > longer_than, F.sequence(total - last + 1, total)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(named, F.array().cast("array<int>")), head, tail), lambda p: (p >= 1) & (p <= total))))


def first_number(t: Column) -> Column:
    return F.nullif(F.regexp_extract(t, r"(?<![\p{L}\p{N}_])([0-9]{2,6})(?![\p{L}\p{N}_])", 1), F.lit("")).cast("int")


def heading(t: Column) -> Column:
    t = F.regexp_replace(strip(t), r"^#+", "")
    t = F.regexp_replace(strip(t), r"^\d+(\.\d+)*[.、)]?\s*", "")
    return F.regexp_replace(strip(t), r"[:：]+$", "")


def without_control(t: Column) -> Column:
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def head_and_tail(t: Column, longest: int, head: int, tail: int, mark: str) -> Column:
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, head), F.lit(mark), F.right(t, F.lit(tail)))).otherwise(t)


def from_body(t: Column, patterns: Sequence[str], longest: int = 30000, head: int = 5000, rest: int = 25000, mark: str = "\n...\n") -> Column:
    """Long texts as head and body, the body from the first pattern that occurs; without one, or close to the top, the beginning."""
    starts = [F.nullif(F.regexp_instr(t, F.lit(p)), F.lit(0)) for p in patterns]
    start = F.coalesce(*starts, F.lit(0)) - 1
    body = F.when(start > head, F.concat(F.substring(t, 1, head), F.lit(mark), F.substr(t, start + 1, F.lit(rest)))).otherwise(F.substring(t, 1, longest))
    return F.when(F.length(t) > longest, body).otherwise(t)


def without_unsupported(t: Column, source: Column, pattern: str) -> Column:
    """``t`` without what fits the pattern and is not in ``source``; white space is collapsed then."""
    found = F.regexp_extract_all(t, F.lit(pattern), 0)
    kept = F.aggregate(found, t, lambda acc, m: F.when(F.contains(source, F.rtrim(m, F.lit(","))), acc).otherwise(F.replace(acc, m, F.lit(""))))
    return strip(F.regexp_replace(kept, r"[ \t]{2,}", " "))


def cache_key(t: Column, lang: Column, length: int, style: str | None = None, medical: bool | None = None, strategy: str | None = None) -> Column:
    parts = [t, lang, F.lit(str(length))]
    parts += [F.lit(f"{k}={v}") for k, v in (("style", style), ("is_medical", None if medical is None else int(medical)), ("strategy", strategy)) if v is not None]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def too_short_message(message: str, least: Column, found: Column) -> Column:
    return F.concat(F.lit(message), F.coalesce(F.concat(F.lit("，至少需要 "), least.cast("string"), F.lit(" 个字符，当前 "), found.cast("string"), F.lit(" 个字符")), F.lit("")))


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.2f%%", F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0)))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def judge_score(t: Column) -> Column:
    return F.try_cast(strip(F.split_part(t, F.lit("|"), F.lit(1))), "double") if hasattr(F, "try_cast") else strip(F.split_part(t, F.lit("|"), F.lit(1))).try_cast("double")


# ---- lists from texts


def ngrams(t: Column, n: int = 3, words: str = "[a-zA-Z]+|[0-9]+", cjk: bool = True) -> Column:
    """The set of n-grams of words, and of CJK characters; what is shorter counts by its words, and as one run of characters."""
    low = F.lower(t)
    grams = lambda xs, sep, short: F.when(F.size(xs) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(xs, i, n), sep))).otherwise(short)
    latin = F.regexp_extract_all(low, F.lit(words), 0)
    # bound once, as an element: a lambda would take the text apart again for each gram
    bound = lambda xs, f: F.transform(F.array(xs), f)[0]
    found = bound(latin, lambda xs: grams(xs, " ", xs))
    if cjk:
        signs = F.regexp_extract_all(low, F.lit(CJK), 0)
        found = F.concat(found, F.filter(bound(signs, lambda xs: grams(xs, "", F.array(F.array_join(xs, "")))), lambda g: g != ""))
    return F.array_distinct(found)


def keywords(t: Column, n: int = 15) -> Column:
    return F.slice(F.filter(F.regexp_extract_all(F.lower(t), F.lit(rf"{CJK}+|[a-z]{{3,}}|[0-9]+(?:\.[0-9]+)?%?"), 0), lambda w: F.length(w) > 2), 1, n)
