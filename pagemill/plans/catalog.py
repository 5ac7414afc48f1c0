"""Every operator as a query over the driver's tables, with SQL for the same result where SQL can say it.

Bindings: a document is a row of ``documents``; its pages are its text in steps of 200 characters; items are spans of
texts whose true page is known, and passages of ``benchmark``; calls are rows of ``events``. Dictionaries are parameters of
the operators; here they hold words that occur in the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import chunking, evaluation, evidence, merge, pages, retrieval
from pagemill.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PAGE = 200
WORDS = ["the ", " de ", " der ", "license", "%"]
FIELDS = {"articles": ["the ", " der ", " la ", " le "], "marks": ["license", "%", " or ", "the "]}
LIMITS = {"articles": 4, "marks": 12}

# ---- SQL shared by the queries

SP = r"[\s\x0B\x{85}\p{Z}]"
PAGES_SQL = f"""pages_d AS (
  SELECT doc_id, lang, source, CAST(g AS INTEGER) AS page_no, CAST(ceil(length(text) / {PAGE}.0) AS INTEGER) AS total_pages,
         substring(text, (g - 1) * {PAGE} + 1, {PAGE}) AS text
  FROM documents, unnest(generate_series(1, CAST(ceil(length(text) / {PAGE}.0) AS BIGINT))) AS u(g)
)"""
ITEMS_SQL = """items AS (
  SELECT doc_id, ord, t AS text, CASE WHEN ord % 3 <> 0 THEN t ELSE '' END AS quote, CAST(1 + floor((ord - 1) * ceil(n / 200.0) / k) AS INTEGER) AS cited_page
  FROM (SELECT doc_id, length(text) AS n, len(parts) AS k, unnest(parts) AS t, CAST(generate_subscripts(parts, 1) AS INTEGER) AS ord FROM (SELECT *, string_split_regex(text, '[.!?\n]+ *') AS parts FROM documents)) WHERE length(t) >= 20
  UNION ALL SELECT d.doc_id, 0, b.text, b.text, 1 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE length(d.text) > 0
)"""


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{SP}+|{SP}+$', '', 'g')"


def hits_sql(t: str, word: str) -> str:
    return f"CAST(floor((length({t}) - length(replace({t}, '{word}', ''))) / {len(word)}) AS BIGINT)"


def capped_sql(t: str, words: list[str], cap: int) -> str:
    return "(" + " + ".join(f"least({hits_sql(t, w)}, {cap})" for w in words) + ")"


def any_sql(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def head_sql(t: str, n: int) -> str:
    return f"array_to_string(string_split({t}, chr(10))[1:{n}], chr(10))"


def count_sql(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def match_sql(t: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, '{flags}{p}')" for p in patterns) + ")"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_table(spark, f"{sf}/documents.parquet")


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_table(documents(spark, sf), PAGE)


def item_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of a document of 20 characters or more, cited at the page where it would stand if sentences were of one length, and
    a passage of ``benchmark``, which may or may not stand in the document. Every third sentence has no quotation."""
    docs = documents(spark, sf).where(F.length("text") > 0)
    marks = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("_k"), F.col("text").alias("_passage"))
    parts = docs.select("doc_id", F.ceil(F.length("text") / PAGE).alias("_pages"), F.split("text", "[.!?\n]+ *").alias("_parts")).select("doc_id", "_pages", F.size("_parts").alias("_k"), F.posexplode_outer("_parts").alias("_i", "text"))
    cited = (1 + F.floor(F.col("_i") * F.col("_pages") / F.col("_k"))).cast("int")
    own = parts.where(F.length("text") >= 20).select("doc_id", (F.col("_i") + 1).alias("ord"), "text", F.when((F.col("_i") + 1) % 3 != 0, F.col("text")).otherwise("").alias("quote"), cited.alias("cited_page"))
    # the table of passages is read whole and joined on a key; Spark broadcasts it if it is small
    other = docs.select("doc_id", (F.col("doc_id") % 40).alias("_k")).join(marks, "_k").select("doc_id", F.lit(0).alias("ord"), F.col("_passage").alias("text"), F.col("_passage").alias("quote"), F.lit(1).alias("cited_page"))
    return own.union(other)


KINDS = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_documents(name: str, kind: str, expr: Callable[[], Column], sql: str) -> None:
    """A scalar of each document."""
    add(name, lambda s, d: documents(s, d).select("doc_id", expr().cast(kind).alias("value")), f"SELECT doc_id, CAST({sql} AS {KINDS[kind]}) AS value FROM documents")


def on_pages(name: str, kind: str, expr: Callable[[], Column], sql: str) -> None:
    """A scalar of each page."""
    add(name, lambda s, d: page_rows(s, d).select("doc_id", "page_no", expr().cast(kind).alias("value")), f"WITH {PAGES_SQL} SELECT doc_id, page_no, CAST({sql} AS {KINDS[kind]}) AS value FROM pages_d")


T = lambda: F.col("text")
P, N = (lambda: F.col("page_no")), (lambda: F.col("total_pages"))

# ---- scans

add("sc3_tagged_text", lambda s, d: pages.tagged_text(page_rows(s, d)), f"""WITH {PAGES_SQL} SELECT doc_id, string_agg('[p' || page_no || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS text,
  CAST(length(string_agg('[p' || page_no || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no)) AS INTEGER) AS char_count
  FROM pages_d WHERE page_no <= 200 AND {strip_sql('text')} <> '' GROUP BY doc_id""")
add("sc4_page_count", lambda s, d: page_rows(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")), f"WITH {PAGES_SQL} SELECT doc_id, count(*) AS pages FROM pages_d GROUP BY doc_id")
add("sc5_first_pages", lambda s, d: pages.first_pages(page_rows(s, d), 5, 150).select("doc_id", "page_no", "text"), f"WITH {PAGES_SQL} SELECT doc_id, page_no, substring(text, 1, 150) AS text FROM pages_d WHERE page_no <= 5")
add("sc12_sample_lookup", lambda s, d: documents(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(documents(s, d).groupBy("lang").agg(F.min("doc_id").alias("sample_id")), "lang", "left"), "SELECT lang, count(*) AS n, min(doc_id) AS sample_id FROM documents GROUP BY lang")
add(
    "sc13_template_lookup",
    lambda s, d: documents(s, d).select("doc_id", F.coalesce(F.create_map(F.lit("en"), F.lit("english"), F.lit("de"), F.lit("german"))[F.col("lang")], F.lit("other")).alias("template")),
    "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'other' END AS template FROM documents",
)
add(
    "sc14_cited_text",
    lambda s, d: pages.cited_text(item_rows(s, d).select("doc_id", F.col("cited_page").alias("page_no")), page_rows(s, d), 150, 300),
    f"""WITH {PAGES_SQL}, {ITEMS_SQL}, c AS (SELECT DISTINCT doc_id, cited_page AS page_no FROM items)
  SELECT doc_id, substring(string_agg('[p' || page_no || ']' || chr(10) || substring(text, 1, 150), chr(10) ORDER BY page_no), 1, 300) AS text FROM pages_d JOIN c USING (doc_id, page_no) GROUP BY doc_id""",
)

# ---- tests of pages and documents

on_pages("fl1_empty_page", "boolean", lambda: tx.is_empty_page(T()), f"length(regexp_replace(text, '{SP}+', '', 'g')) < 100")
SKIP = ["^the ", "^(die|der)", "^un"]
on_pages("fl2_skip_page", "boolean", lambda: tx.is_skip_page(T(), SKIP), match_sql(head_sql(strip_sql("lower(text)"), 5), SKIP) + r" OR " + count_sql("text", r"(?m)\.\s*\d{1,3}\s*$") + " > 10")
on_pages("fl3_skip_by_first_line", "boolean", lambda: tx.is_skip_page_by_first_line(T(), SKIP), match_sql(head_sql(strip_sql("lower(text)"), 1), SKIP))
on_pages(
    "fl4_contents_page", "boolean", lambda: tx.is_contents_page(T(), P(), ["license", "the and"]),
    f"page_no <= 15 AND ({count_sql('text', '[.]{3,}|([.][ ]){3,}')} > 10 OR len(list_filter(string_split({strip_sql('text')}, chr(10)), lambda x: regexp_matches(x, '[0-9]{{1,3}}{SP}*$'))) > 15 OR {any_sql('lower(' + head_sql(strip_sql('text'), 5) + ')', ['license', 'the and'])})",
)
on_pages(
    "fl5_retrieval_skip", "boolean", lambda: tx.is_retrieval_skip_page(T(), P(), N(), ["^the "], ["license"]),
    f"length({strip_sql('text')}) < 80 OR (page_no <= 15 AND ({count_sql('text', '[.]{3,}|([.][ ]){3,}')} > 10 OR len(list_filter(string_split({strip_sql('text')}, chr(10)), lambda x: regexp_matches(x, '[0-9]{{1,3}}{SP}*$'))) > 15 OR {any_sql('lower(' + head_sql(strip_sql('text'), 5) + ')', ['license'])})) OR {match_sql(head_sql(strip_sql('text'), 3), ['^the '], '(?i)')} OR ({count_sql('text', '[(][0-9]{4}[)]|[0-9]{4}[;,]|[[][0-9]+[]]')} > 15 AND page_no > total_pages * 0.7)",
)
on_pages("fl6_key_page", "boolean", lambda: tx.is_key_page(T(), P(), N(), WORDS), f"page_no <= 2 OR page_no >= total_pages - 1 OR {any_sql('substring(lower(text), 1, 1500)', WORDS)}")
add(
    "fl7_text_layer", lambda s, d: pages.text_layer(page_rows(s, d)).select("doc_id", "coverage", "has_text"),
    f"WITH {PAGES_SQL} SELECT doc_id, avg(CAST(length({strip_sql('text')}) > 50 AS INTEGER)) AS coverage, avg(CAST(length({strip_sql('text')}) > 50 AS INTEGER)) >= 0.3 AS has_text FROM pages_d WHERE page_no <= 3 GROUP BY doc_id",
)
add(
    "fl8_ocr_route", lambda s, d: pages.text_layer(page_rows(s, d)).groupBy("route").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {PAGES_SQL}, c AS (SELECT doc_id, avg(CAST(length({strip_sql('text')}) > 50 AS INTEGER)) AS coverage FROM pages_d WHERE page_no <= 3 GROUP BY doc_id) SELECT CASE WHEN coverage < 0.3 THEN 'ocr' ELSE 'text' END AS route, count(*) AS n FROM c GROUP BY ALL",
)
add(
    "fl9_rejected", lambda s, d: documents(s, d).where(F.length(tx.strip(T())) < 100).select("doc_id", F.length(tx.strip(T())).cast("long").alias("n"), tx.too_short_message("ContentTooShort", F.lit(100), F.length(tx.strip(T()))).alias("reason")),
    f"SELECT doc_id, length({strip_sql('text')}) AS n, 'ContentTooShort，至少需要 100 个字符，当前 ' || length({strip_sql('text')}) || ' 个字符' AS reason FROM documents WHERE length({strip_sql('text')}) < 100",
)
on_documents("fl10_batch_minimum", "string", lambda: F.when(F.length(T()) < 500, "too short"), "CASE WHEN length(text) < 500 THEN 'too short' END")
MARKERS = ["/JavaScript", "license", "http", "%", "token"]
on_documents("fl12_markers", "string", lambda: F.array_join(tx.markers_found(T(), MARKERS), ","), "array_to_string(list_filter([" + ", ".join(f"'{m}'" for m in MARKERS) + "], lambda m: contains(text, m)), ',')")
add("fl13_extension", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", tx.has_extension(F.col("url"), "x").alias("value")), "SELECT page_id, coalesce(suffix(lower(url), 'x'), false) AND length(url) > 0 AS value FROM pages")
add(
    "fl14_limit_then_filter", lambda s, d: s.read.parquet(f"{d}/events.parquet").orderBy(F.desc("event_id")).limit(500).where("event_type = 'error'").select("event_id"),
    "SELECT event_id FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) WHERE event_type = 'error'",
)
on_documents("fl15_filled_fields", "long", lambda: tx.filled_fields([T(), F.col("lang"), F.col("source")], ["en", "src1"]), "(CASE WHEN text <> '' AND text NOT IN ('en', 'src1') THEN 1 ELSE 0 END) + (CASE WHEN lang <> '' AND lang NOT IN ('en', 'src1') THEN 1 ELSE 0 END) + (CASE WHEN source <> '' AND source NOT IN ('en', 'src1') THEN 1 ELSE 0 END)")
add(
    "fl16_usable", lambda s, d: page_rows(s, d).where("page_no = 1").select("doc_id", tx.is_usable(T(), N(), ["license"]).alias("value")),
    f"WITH {PAGES_SQL} SELECT doc_id, CASE WHEN total_pages < 2 THEN length({strip_sql('text')}) > 100 AND NOT contains(lower(text), 'license') ELSE true END AS value FROM pages_d WHERE page_no = 1",
)
add(
    "fl17_marker_lines", lambda s, d: pages.numbered_lines(pages.tagged_text(page_rows(s, d))).where(tx.is_page_marker_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {PAGES_SQL}, t AS (SELECT doc_id, unnest(string_split(string_agg('[p' || page_no || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no), chr(10))) AS line FROM pages_d WHERE page_no <= 200 AND {strip_sql('text')} <> '' GROUP BY doc_id) SELECT doc_id, count(*) AS n FROM t WHERE regexp_matches({strip_sql('line')}, '^[[](p|Page\\s+)[0-9]+[]]$') GROUP BY doc_id",
)

# ---- scalars

NOT_SIGN = r"[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x0B\x{85}\p{Z}]+"
TOKENS_SQL = f"CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(CAST(floor({count_sql('text', '[一-鿿㐀-䶿]')} * CAST(1.8 AS DOUBLE) + {count_sql('text', NOT_SPACE)} * CAST(1.3 AS DOUBLE) + {count_sql('text', NOT_SIGN)} * CAST(0.5 AS DOUBLE)) AS BIGINT), 1) END"
on_documents("sf1_token_estimate", "long", lambda: tx.token_estimate(T()), TOKENS_SQL)
on_documents("sf2_tokens_to_chars", "long", lambda: tx.tokens_to_chars(F.col("n_chars"), False) + tx.tokens_to_chars(F.col("n_chars")), "floor(n_chars / CAST(0.3 AS DOUBLE)) + floor(n_chars / CAST(1.8 AS DOUBLE))")
on_documents("sf3_prompt_budget", "long", lambda: tx.prompt_budget(T(), 8000), "CASE WHEN 16284 - CAST(floor(length(text) / CAST(1.2 AS DOUBLE)) AS BIGINT) < 8000 THEN greatest(1000, 16284 - CAST(floor(length(text) / CAST(1.2 AS DOUBLE)) AS BIGINT)) ELSE 8000 END")
on_pages("sf4_short_markers", "string", lambda: tx.short_page_markers(F.concat(F.lit("[Page "), P().cast("string"), F.lit("]"), T())), "'[p' || page_no || ']' || text")
add(
    "sf5_page_markers", lambda s, d: pages.tagged_text(page_rows(s, d)).select("doc_id", F.array_join(tx.page_markers(T()), ",").alias("value")),
    f"WITH {PAGES_SQL} SELECT doc_id, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS value FROM pages_d WHERE page_no <= 200 AND {strip_sql('text')} <> '' GROUP BY doc_id",
)
on_pages(
    "sf7_section_header", "boolean", lambda: tx.has_section_header(T(), [r"^[A-Z][a-z]+ (of|der|de)"]), "regexp_matches(text, '(?m)^[A-Z][a-z]+ (of|der|de)')"
)
SCORE_SQL = f"(CASE WHEN {match_sql(head_sql('lower(text)', 5), ['^the'])} THEN 4.0 ELSE 0.0 END + {capped_sql('lower(text)', WORDS, 3)} * 0.5 + least(length(text) / CAST(2000 AS DOUBLE), 3.0) + CASE WHEN page_no <= 5 OR page_no > total_pages - 3 THEN 2.0 ELSE 0.0 END)"
SCORE = lambda: tx.page_score(T(), P(), N(), WORDS, ["^the"])
on_pages("sf8_page_score", "double", lambda: F.round(SCORE(), 6), f"round({SCORE_SQL}, 6)")
PRIORITIES = [("license", 10), ("^the", 8), (" der ", 5), (" de ", 4)]
PRIORITY_SQL = "(greatest(0, " + ", ".join(f"CASE WHEN regexp_matches({head_sql('lower(text)', 5)}, '{p}') THEN {n} ELSE 0 END" for p, n in PRIORITIES) + ") + CASE WHEN page_no <= 3 OR page_no > total_pages - 3 THEN 3 ELSE 0 END)"
PRIORITY = lambda: tx.page_priority(T(), P(), N(), PRIORITIES)
on_pages("sf9_page_priority", "long", PRIORITY, PRIORITY_SQL)
for _field, _words in FIELDS.items():
    on_pages(f"sf10_field_score_{_field}", "long", lambda f=_field: tx.field_scores(T(), FIELDS)[f], capped_sql("lower(text)", _words, 5))
on_pages(
    "sf11_classification_score", "double", lambda: F.round(tx.classification_score(T(), [("the ", 1.5), (" der ", 2.0)], ["license"]), 6),
    f"CASE WHEN {strip_sql('text')} = '' THEN -1.0 ELSE round({count_sql('text', '[0-9]')} * 0.08 + {hits_sql('text', '%')} * 4.0 + least(length(text), 4000) / CAST(2500 AS DOUBLE) + {hits_sql('lower(text)', 'the ')} * 1.5 + {hits_sql('lower(text)', ' der ')} * 2.0 - {hits_sql('lower(text)', 'license')} * 2.0, 6) END",
)
on_pages(
    "sf12_importance", "double", lambda: tx.paragraph_importance(T(), ["%", "[0-9]+"], ["the and"]),
    "(CASE WHEN regexp_matches(text, '(?i)%') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?i)[0-9]+') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?i)the and') THEN 1.5 ELSE 0.0 END + CASE WHEN " + count_sql("text", "[0-9]+([.][0-9]+)?") + " > 3 THEN 1.0 ELSE 0.0 END) * CASE WHEN length(text) < 100 THEN 0.5 ELSE 1.0 END",
)


def grams_sql(t: str, n: int = 3) -> str:
    words = f"regexp_extract_all(lower({t}), '[a-zA-Z]+|[0-9]+')"
    return f"list_distinct(CASE WHEN len({words}) >= {n} THEN list_transform(generate_series(1, len({words}) - {n - 1}), lambda i: array_to_string({words}[i:i + {n - 1}], ' ')) ELSE {words} END)"


add("sf13_ngrams", lambda s, d: page_rows(s, d).select("doc_id", "page_no", F.array_join(F.array_sort(tx.ngrams(T())), ";").alias("value")), f"WITH {PAGES_SQL} SELECT doc_id, page_no, array_to_string(list_sort({grams_sql('text')}), ';') AS value FROM pages_d")
add("sf14_latin_ngrams", lambda s, d: page_rows(s, d).select("doc_id", "page_no", F.size(tx.ngrams(T(), 2, cjk=False)).cast("long").alias("value")), f"WITH {PAGES_SQL} SELECT doc_id, page_no, CAST(len({grams_sql('text', 2)}) AS BIGINT) AS value FROM pages_d")
on_pages("sf15_keywords", "string", lambda: F.array_join(tx.keywords(T()), ","), "array_to_string(list_filter(regexp_extract_all(lower(text), '[一-鿿]+|[a-z]{3,}|[0-9]+(?:[.][0-9]+)?%?'), lambda w: length(w) > 2)[1:15], ',')")
on_pages("sf16_item_key", "string", lambda: tx.item_key(T()), r"regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g')")
on_pages("sf17_whitespace", "string", lambda: tx.whitespace_normal(T()), f"lower({strip_sql(f"regexp_replace(text, '{SP}+', ' ', 'g')")})")
on_documents("sf18_source_page", "string", lambda: tx.source_page(F.col("source")), "CASE WHEN regexp_matches(source, '[0-9]+') THEN 'p' || regexp_extract(source, '[0-9]+') END")
on_documents(
    "sf19_sources", "string", lambda: F.array_join(tx.coerced_sources(F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 1, F.array("source", "lang")), F.when(F.col("doc_id") % 6 == 2, F.array("doc_id"))), ","),
    "CASE WHEN doc_id % 3 = 1 THEN source || ',' || lang WHEN doc_id % 6 = 2 THEN 'p' || doc_id WHEN doc_id % 3 = 0 THEN source ELSE '' END",
)
for _name, _last, _longer in (("sf20_page_range", 2, 5), ("sf21_page_range_variant", 2, 3)):
    add(
        _name, lambda s, d, last=_last, longer=_longer: page_rows(s, d).where("page_no = 1").select("doc_id", F.array_join(tx.page_range(F.concat(F.lit("p4, p7-P9; p2-5"), F.lit("")), N(), 3, last, longer).cast("array<string>"), ",").alias("value")),
        f"WITH {PAGES_SQL}, x AS (SELECT doc_id, total_pages, unnest([1, 2, 3, 4, 5, 7, 8, 9] || CASE WHEN total_pages > {_longer} THEN [total_pages - 1, total_pages] ELSE [] END) AS p FROM pages_d WHERE page_no = 1), y AS (SELECT DISTINCT doc_id, p FROM x WHERE p BETWEEN 1 AND total_pages) SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS value FROM y GROUP BY doc_id",
    )
on_documents("sf22_first_number", "long", lambda: tx.first_number(T()), r"CAST(nullif(regexp_extract(' ' || text || ' ', '[^\p{L}\p{N}_]([0-9]{2,6})[^\p{L}\p{N}_]', 1), '') AS BIGINT)")
add(
    "sf23_heading", lambda s, d: documents(s, d).select("doc_id", tx.heading(F.concat(F.lit(" ## 1.2 "), F.substring_index("text", "\n", 1), F.lit(":"))).alias("value")),
    f"SELECT doc_id, regexp_replace({strip_sql('string_split(text, chr(10))[1]' + " || ':'")}, '[:：]+$', '') AS value FROM documents",
)
on_documents("sf24_control", "string", lambda: tx.without_control(F.concat(F.lit("\x01"), T())), "regexp_replace(chr(1) || text, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")
on_documents("sf25_head_tail", "string", lambda: tx.head_and_tail(T(), 2000, 1000, 1000, "..."), "CASE WHEN length(text) > 2000 THEN substring(text, 1, 1000) || '...' || right(text, 1000) ELSE text END")
on_documents(
    "sf26_from_body", "string", lambda: F.md5(tx.from_body(T(), ["license", " der "], 3000, 500, 2000, "...").cast("binary")),
    "md5(CASE WHEN length(text) <= 3000 THEN text WHEN coalesce(nullif(instr(text, 'license'), 0), nullif(instr(text, ' der '), 0), 0) - 1 > 500 THEN substring(text, 1, 500) || '...' || substring(text, coalesce(nullif(instr(text, 'license'), 0), nullif(instr(text, ' der '), 0), 0), 2000) ELSE substring(text, 1, 3000) END)",
)
on_documents("sf27_unsupported", "string", lambda: tx.without_unsupported(F.concat(F.lit("seen 1999, and 2024, "), T()), F.concat(F.lit("in 1999 "), T()), r"(?:19|20)[0-9]{2},"), strip_sql("regexp_replace('seen 1999, and ' || CASE WHEN contains(text, '2024') THEN '2024,' ELSE '' END || ' ' || text, '[ \\t]{2,}', ' ', 'g')"))
on_documents("sf28_word_count", "long", lambda: tx.word_count(T(), F.when(F.col("lang") == "fr", "zh").otherwise(F.col("lang"))), f"CASE WHEN lang = 'fr' THEN length(text) ELSE {count_sql('text', NOT_SPACE)} END")
add("sf29_coverage", lambda s, d: page_rows(s, d).groupBy("doc_id", "total_pages").agg(F.collect_set(F.when(tx.holds_any(T(), ["license", "%"]), P())).alias("c")).select("doc_id", tx.coverage(F.col("c"), N()).alias("value")), f"WITH {PAGES_SQL} SELECT doc_id, CAST(count(DISTINCT CASE WHEN {any_sql('text', ['license', '%'])} THEN page_no END) AS DOUBLE) / total_pages AS value FROM pages_d GROUP BY doc_id, total_pages")
add("sf31_content_hash", lambda s, d: documents(s, d).select("doc_id", F.md5(T().cast("binary")).alias("value")), "SELECT doc_id, md5(text) AS value FROM documents")
on_documents("sf32_cache_key", "string", lambda: tx.cache_key(T(), F.col("lang"), 500, "medical", True, "auto"), "md5(text || ':' || lang || ':500:style=medical:is_medical=1:strategy=auto')")
on_documents("sf33_chunk_count", "long", lambda: tx.chunk_count(T(), 1000, 100), "CASE WHEN length(text) <= 1000 THEN 1 ELSE (length(text) - 100) // 900 + 1 END")
on_documents("sf34_error_message", "string", lambda: tx.too_short_message("x", F.when(F.col("doc_id") % 2 == 0, F.lit(100)), F.length(T())), "'x' || coalesce(CASE WHEN doc_id % 2 = 0 THEN '，至少需要 100 个字符，当前 ' || length(text) || ' 个字符' END, '')")
on_documents("sf36_percent", "string", lambda: tx.percent(F.col("n_chars") % 7, F.col("doc_id") % 8), "printf('%.2f%%', CASE WHEN doc_id % 8 > 0 THEN CAST(100.0 * (n_chars % 7) / (doc_id % 8) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")
add("sf38_iso_time", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", tx.iso_time(F.col("ts")).alias("value")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS value FROM events")
on_documents("sf40_judge_reply", "double", lambda: tx.judge_score(F.concat(F.col("doc_id").cast("string"), F.lit(".5 | "), T())), "doc_id + 0.5")
add("sk10_record_defaults", lambda s, d: documents(s, d).select("doc_id", F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("{}")).alias("metadata")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '{}' END AS metadata FROM documents")
