"""The second half of the catalog: operators that turn tables into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import evaluation, evidence, merge, pages, retrieval
from pagemill.plans.catalog import (
    FIELDS, ITEMS_SQL, LIMITS, PAGES_SQL, PRIORITY, PRIORITY_SQL, SCORE, SCORE_SQL, SP, TOKENS_SQL, WORDS, add, any_sql, capped_sql, count_sql, documents, grams_sql, head_sql, hits_sql, item_rows, on_documents, on_pages, page_rows, strip_sql,
)

T = lambda: F.col("text")

# ---- classification

TYPES = [("GUIDELINE", ["license"]), ("REVIEW", ["the the", " de "])]


def doc_type_sql(t: str) -> str:
    return f"CASE WHEN contains(lower({t}), 'license') THEN 'GUIDELINE' WHEN contains(lower({t}), 'the the') OR contains(lower({t}), ' de ') THEN 'REVIEW' ELSE 'OTHER' END"


def heads_sql(first: int, cap: int) -> str:
    return f"heads AS (SELECT doc_id, string_agg(substring(text, 1, {cap}), chr(10) ORDER BY page_no) AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM pages_d WHERE NOT (regexp_matches({head_sql(strip_sql('lower(text)'), 5)}, '^und') OR {count_sql('text', '(?m)[.]\\s*[0-9]{1,3}\\s*$')} > 10)) WHERE k <= {first} GROUP BY doc_id)"


add("cl1_doc_type", lambda s, d: pages.classify(page_rows(s, d), TYPES, 3, 1000, ["^und"]), f"WITH {PAGES_SQL}, {heads_sql(3, 1000)} SELECT doc_id, {doc_type_sql('head')} AS doc_type FROM heads")
add("cl2_doc_type_variant", lambda s, d: pages.classify(page_rows(s, d), [("REVIEW", ["%"]), *TYPES], 5, 150, ["^und"]), f"WITH {PAGES_SQL}, {heads_sql(5, 150)} SELECT doc_id, CASE WHEN contains(head, '%') THEN 'REVIEW' ELSE {doc_type_sql('head')} END AS doc_type FROM heads")
add(
    "cl3_reply_label", lambda s, d: documents(s, d).select("doc_id", F.coalesce(*(F.when(F.contains(F.upper("text"), F.lit(w)), w) for w in ("LICENSE", "THE", "DER")), F.lit("OTHER")).alias("value")),
    "SELECT doc_id, CASE WHEN contains(upper(text), 'LICENSE') THEN 'LICENSE' WHEN contains(upper(text), 'THE') THEN 'THE' WHEN contains(upper(text), 'DER') THEN 'DER' ELSE 'OTHER' END AS value FROM documents",
)
add(
    "cl4_reply_json", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.coalesce(F.get_json_object("props", "$.type"), F.get_json_object("props", "$.doc_type"), F.lit("OTHER")).alias("value")),
    "SELECT event_id, coalesce(json_extract_string(props, '$.type'), json_extract_string(props, '$.doc_type'), 'OTHER') AS value FROM events",
)
ONE = "FROM pages_d WHERE page_no = 1"
add("cl6_size_bucket", lambda s, d: page_rows(s, d).where("page_no = 1").select("doc_id", pages.size_bucket(F.col("total_pages")).alias("value")), f"WITH {PAGES_SQL} SELECT doc_id, CASE WHEN total_pages <= 15 THEN 'short' WHEN total_pages <= 50 THEN 'medium' ELSE 'long' END AS value {ONE}")
add("cl7_strategy", lambda s, d: page_rows(s, d).where("page_no = 1").select("doc_id", pages.strategy(F.col("total_pages")).alias("r")).select("doc_id", "r.route", "r.pages"), f"WITH {PAGES_SQL} SELECT doc_id, CASE WHEN total_pages <= 50 THEN 'single_short' WHEN total_pages <= 80 THEN 'single_long' ELSE 'mapreduce' END AS route, CASE WHEN total_pages <= 50 THEN 50 WHEN total_pages <= 80 THEN 60 ELSE 80 END AS pages {ONE}")
on_documents("cl8_summary_strategy", "string", lambda: pages.summary_strategy(tx.chunk_count(T(), 1000, 100), F.when(F.col("doc_id") % 2 == 0, "auto").otherwise("refine")), "CASE WHEN length(text) <= 1000 THEN CASE WHEN doc_id % 2 = 0 THEN 'stuff' ELSE 'refine' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'map_reduce' ELSE 'refine' END END")
# The length of each style of summary.
STYLES = {"brief": 200, "detailed": 800, "bullet": 500, "academic": 600, "medical": 800}
on_documents(
    "cl9_style_length", "long", lambda: F.coalesce(F.create_map(*(x for k, v in STYLES.items() for x in (F.lit(k), F.lit(v))))[F.element_at(F.array(*map(F.lit, [*STYLES, "none"])), (F.col("doc_id") % 6 + 1).cast("int"))], F.lit(321)),
    "CASE doc_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 800 WHEN 2 THEN 500 WHEN 3 THEN 600 WHEN 4 THEN 800 ELSE 321 END",
)

# ---- selection

EMPTY = f"length(regexp_replace(text, '{SP}+', '', 'g')) < 100"
add(
    "tk1_select_by_score", lambda s, d: pages.select_by_score(page_rows(s, d), F.round(SCORE(), 6), 20, tx.is_empty_page(T())).select("doc_id", "page_no", "score"),
    f"""WITH {PAGES_SQL}, k AS (SELECT *, round({SCORE_SQL}, 6) AS score, count(*) OVER (PARTITION BY doc_id) AS n, page_no <= 5 OR page_no > total_pages - 3 AS edge FROM pages_d WHERE NOT {EMPTY}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, edge ORDER BY score DESC, page_no) AS place FROM k)
  SELECT doc_id, page_no, score FROM r WHERE n <= 20 OR edge OR place <= 20 - least(total_pages, 8)""",
)


def staged(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        rows = page_rows(s, d).withColumns({"priority": PRIORITY().cast("long"), "edge": pages.edges()})
        most, stages = pages.priority_stages(name)
        return pages.select_in_stages(rows, 20, [(e, o, None if k is None else min(k, 6), b) for e, o, k, b in stages]).select("doc_id", "page_no", "priority")

    return query


def staged_sql(stages: list[tuple[str, str, int | None, bool]], most: int = 20) -> str:
    sql = f"WITH {PAGES_SQL}, s0 AS (SELECT *, {PRIORITY_SQL} AS priority, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) <= 5 OR row_number() OVER (PARTITION BY doc_id ORDER BY page_no DESC) <= 3 AS edge, count(*) OVER (PARTITION BY doc_id) AS n, false AS taken FROM pages_d)"
    for i, (eligible, order, limit, bounded) in enumerate(stages, 1):
        room = f"least({most} - count(*) FILTER (taken) OVER (PARTITION BY doc_id), {limit or 1 << 30})" if bounded else str(limit or 1 << 30)
        sql += f", f{i} AS (SELECT *, NOT taken AND ({eligible}) AS free, {room} AS quota FROM s{i - 1}), s{i} AS (SELECT * EXCLUDE (free, quota) REPLACE (taken OR (free AND row_number() OVER (PARTITION BY doc_id, free ORDER BY {order}, page_no) <= quota) AS taken) FROM f{i})"
    return sql + f" SELECT doc_id, page_no, CAST(priority AS BIGINT) AS priority FROM s{len(stages)} WHERE n <= {most} OR taken"


EDGE, BEST, LONG = ("edge", "page_no", None, False), ("true", "priority DESC", None, True), ("true", "length(text) DESC", None, True)
add("tk2_priority", staged("priority"), staged_sql([EDGE, BEST, LONG]))
add("tk3_priority_capped", staged("priority20"), staged_sql([EDGE, ("true", "priority DESC", 6, True), LONG]))
add("tk4_priority_five", staged("priority5"), staged_sql([EDGE, ("priority >= 5", "priority DESC", 6, False), LONG]))
add("tk5_hybrid", staged("hybrid"), staged_sql([("true", "priority DESC", 6, True), LONG]))
add("tk6_forty", staged("forty"), staged_sql([EDGE, BEST]))
add(
    "tk7_top_per_field", lambda s, d: pages.top_pages_by_field(page_rows(s, d), FIELDS, 3, 5).withColumn("score", F.col("score").cast("long")),
    f"WITH {PAGES_SQL}, x AS (" + " UNION ALL ".join(f"SELECT doc_id, page_no, '{f}' AS field, {capped_sql('lower(text)', w, 5)} AS score FROM pages_d" for f, w in FIELDS.items()) + "), r AS (SELECT *, max(score) OVER (PARTITION BY doc_id, field) AS best, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, page_no) AS k FROM x) SELECT doc_id, field, page_no, score FROM r WHERE CASE WHEN best > 0 THEN score > 0 AND k <= 3 ELSE page_no <= 5 END",
)
add(
    "tk8_two_stage", lambda s, d: page_rows(s, d).withColumn("priority", PRIORITY().cast("long")).withColumn("k", F.row_number().over(pages.by_doc().orderBy(F.desc("priority"), "page_no"))).where("page_no <= 10 OR k <= 25").select("doc_id", "page_no", (F.col("page_no") <= 10).alias("metadata"), (F.col("k") <= 25).alias("content")),
    f"WITH {PAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {PRIORITY_SQL} DESC, page_no) AS k FROM pages_d) SELECT doc_id, page_no, page_no <= 10 AS metadata, k <= 25 AS content FROM r WHERE page_no <= 10 OR k <= 25",
)
add("tk9_scan_fallback", lambda s, d: page_rows(s, d).where("page_no <= 10 OR page_no > total_pages - 3").select("doc_id", "page_no"), f"WITH {PAGES_SQL} SELECT doc_id, page_no FROM pages_d WHERE page_no <= 10 OR page_no > total_pages - 3")
add("tk10_budget", lambda s, d: pages.within_budget(page_rows(s, d), 150, 1000).select("doc_id", "page_no", "text"), f"WITH {PAGES_SQL}, r AS (SELECT doc_id, page_no, substring(text, 1, 150) AS text, sum(length(substring(text, 1, 150))) OVER (PARTITION BY doc_id ORDER BY page_no) AS n FROM pages_d) SELECT doc_id, page_no, text FROM r WHERE n <= 1000")
IMPORTANCE = lambda: tx.paragraph_importance(T(), ["%", "[0-9]+"], ["the and"])
add(
    "tk11_importance_budget", lambda s, d: pages.within_budget(page_rows(s, d).where(F.length("text") > 50).withColumn("score", IMPORTANCE()).where("score >= 1.0"), 200, 1000, F.desc("score")).select("doc_id", "page_no", "score"),
    f"WITH {PAGES_SQL}, i AS (SELECT *, (CASE WHEN contains(text, '%') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 2.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?i)the and') THEN 1.5 ELSE 0.0 END + CASE WHEN {count_sql('text', '[0-9]+([.][0-9]+)?')} > 3 THEN 1.0 ELSE 0.0 END) * CASE WHEN length(text) < 100 THEN 0.5 ELSE 1.0 END AS score FROM pages_d WHERE length(text) > 50), r AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY score DESC, page_no) AS n FROM i WHERE score >= 1.0) SELECT doc_id, page_no, CAST(score AS DOUBLE) AS score FROM r WHERE n <= 1000",
)
tokens = lambda s, d: documents(s, d).select("lang", F.explode(tx.keywords(F.col("text"), 1 << 20)).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
WORDS_SQL = "w AS (SELECT lang, unnest(list_filter(regexp_extract_all(lower(text), '[一-鿿]+|[a-z]{3,}|[0-9]+(?:[.][0-9]+)?%?'), lambda w: length(w) > 2)) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)"


def top_words(s: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("lang")
    top = tokens(s, d).withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "word"))).where("k <= 30")
    weighted = top.withColumn("weight", F.col("n") * F.when(F.col("word").isin("the", "der", "license"), 3).otherwise(1))
    return weighted.withColumn("k", F.row_number().over(by.orderBy(F.desc("weight"), "word"))).where("k <= 15").select("lang", "word", F.col("weight").cast("long").alias("weight"))


add(
    "sf39_tk12_keywords", top_words,
    f"WITH {WORDS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM c), v AS (SELECT *, n * CASE WHEN word IN ('the', 'der', 'license') THEN 3 ELSE 1 END AS weight FROM t WHERE k <= 30), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, word) AS j FROM v) SELECT lang, word, weight FROM r WHERE j <= 15",
)
add("tk13_last_n", lambda s, d: s.read.parquet(f"{d}/events.parquet").orderBy(F.desc("event_id")).limit(100).select("event_id", "event_type"), "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
add("tk14_result_order", lambda s, d: documents(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source"), "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY source")

# ---- sections and windows

RULES = [("marks", ["license", "%"]), ("english", [r"the\b", r"and\b"]), ("german", ["der "])]
SECTION_SQL = f"CASE WHEN regexp_matches({head_sql(strip_sql('lower(text)'), 5)}, 'license|%') THEN 'marks' WHEN regexp_matches({head_sql(strip_sql('lower(text)'), 5)} || ' ', '(the|and)[^\\p{{L}}\\p{{N}}_]') THEN 'english' WHEN contains({head_sql(strip_sql('lower(text)'), 5)}, 'der ') THEN 'german' ELSE 'body' END"
on_pages("ch1_section", "string", lambda: pages.section(T(), RULES), SECTION_SQL)
add("ch2_section_buckets", lambda s, d: pages.section_buckets(page_rows(s, d), RULES), f"WITH {PAGES_SQL} SELECT doc_id, {SECTION_SQL} AS section, min(page_no) AS first_page, count(*) AS pages FROM pages_d GROUP BY ALL")
LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
add(
    "ch3_sections", lambda s, d: pages.detect_sections(pages.numbered_lines(documents(s, d)), [("the", "^The "), ("of", "^(Of|De) ")]),
    f"WITH {LINES_SQL}, h AS (SELECT *, CASE WHEN regexp_matches(line, '^The ') THEN 'the' WHEN regexp_matches(line, '^(Of|De) ') THEN 'of' END AS name, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines) SELECT doc_id, name, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), last + 1) - 1 AS end_line FROM h WHERE name IS NOT NULL",
)
add(
    "ch4_three_way", lambda s, d: pages.three_way(pages.numbered_lines(documents(s, d)), "^the", "^(of|de)"),
    f"WITH {LINES_SQL}, f AS (SELECT doc_id, count(*) AS n, min(CASE WHEN length({strip_sql('line')}) <= 120 AND regexp_matches(lower(line), '^the') THEN line_no END) AS r0, min(CASE WHEN length({strip_sql('line')}) <= 120 AND regexp_matches(lower(line), '^(of|de)') THEN line_no END) AS d0 FROM lines GROUP BY doc_id), g AS (SELECT doc_id, n, coalesce(r0, CAST(floor(n * 0.4) AS BIGINT)) AS results_at, coalesce(d0, CAST(floor(n * 0.75) AS BIGINT)) AS d1 FROM f) SELECT doc_id, n, results_at, CASE WHEN d1 < results_at THEN least(n, results_at + CAST(floor(n * 0.2) AS BIGINT)) ELSE d1 END AS discussion_at FROM g",
)
WINDOWS_SQL = f"{PAGES_SQL}, places AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM pages_d), win AS (SELECT doc_id, page_no, text, c AS chunk FROM places, generate_series(0, (n - 1) // 17) AS g(c) WHERE p >= c * 17 AND p < c * 17 + 20)"
add("ch10_page_windows", lambda s, d: pages.page_windows(page_rows(s, d)).select("doc_id", "page_no", F.col("chunk").cast("long").alias("chunk")), f"WITH {WINDOWS_SQL} SELECT doc_id, page_no, chunk FROM win")
add("ch13_split_by_marker", lambda s, d: pages.tagged_text(page_rows(s, d)).select("doc_id", F.size(pages.split_by_marker(T())).cast("long").alias("parts")), f"WITH {PAGES_SQL} SELECT doc_id, count(*) AS parts FROM pages_d WHERE page_no <= 200 AND {strip_sql('text')} <> '' GROUP BY doc_id")
add(
    "ch14_greedy_segments", lambda s, d: pages.greedy_segments(page_rows(s, d), 300).select("doc_id", "page_no", F.col("segment").cast("long").alias("segment")),
    f"""WITH RECURSIVE {PAGES_SQL}, t AS (SELECT doc_id, page_no, {TOKENS_SQL} AS n FROM pages_d), f AS (
  SELECT doc_id, page_no, 0 AS segment, n AS total FROM t WHERE page_no = 1
  UNION ALL SELECT t.doc_id, t.page_no, CASE WHEN f.total + t.n <= 300 THEN f.segment ELSE f.segment + 1 END, CASE WHEN f.total + t.n <= 300 THEN f.total + t.n ELSE t.n END FROM f JOIN t ON t.doc_id = f.doc_id AND t.page_no = f.page_no + 1
) SELECT doc_id, page_no, CAST(segment AS BIGINT) AS segment FROM f""",
)
add("ch15_page_ranges", lambda s, d: pages.page_range_label(pages.page_windows(page_rows(s, d)), 500).select("doc_id", "page_range", "text"), f"WITH {WINDOWS_SQL} SELECT doc_id, 'p' || min(page_no) || '-p' || max(page_no) AS page_range, substring(string_agg(text, chr(10) ORDER BY page_no), 1, 500) AS text FROM win GROUP BY doc_id, chunk")

# ---- retrieval: a chunk is a page here

CHUNKS = lambda s, d: page_rows(s, d).select("doc_id", (F.col("page_no") - 1).alias("chunk"), "text", F.array("page_no").alias("pages"), (F.col("page_no") % 5 / 5.0).alias("density"), (F.col("page_no") % 3 == 0).alias("has_header"))
TF_SQL = f"{PAGES_SQL}, chunks AS (SELECT doc_id, page_no - 1 AS chunk, page_no, lower(text) AS low FROM pages_d), tf AS (" + " UNION ALL ".join(f"SELECT doc_id, chunk, '{f}' AS field, '{w}' AS keyword, {hits_sql('low', w)} AS tf FROM chunks WHERE {hits_sql('low', w)} > 0" for f, ws in FIELDS.items() for w in ws) + "), df AS (SELECT doc_id, keyword, count(*) AS df FROM tf GROUP BY ALL), nd AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)"
SCORED_SQL = TF_SQL + ", sc AS (SELECT tf.doc_id, chunk, field, n, sum(tf * ln((n - df + 0.5) / (df + 0.5) + 1)) AS raw FROM tf JOIN df USING (doc_id, keyword) JOIN nd USING (doc_id) GROUP BY ALL), scored AS (SELECT *, raw * CASE WHEN chunk = 0 THEN 1.4 WHEN chunk = n - 1 THEN 1.3 WHEN chunk <= 2 THEN 1.15 WHEN chunk >= n - 3 THEN 1.1 ELSE 1.0 END * (1.0 + ((chunk + 1) % 5 / 5.0) * 0.3) * CASE WHEN (chunk + 1) % 3 = 0 THEN 1.2 ELSE 1.0 END AS score FROM sc)"
add("rt1_term_frequency", lambda s, d: retrieval.term_frequencies(CHUNKS(s, d), FIELDS).withColumn("tf", F.col("tf").cast("long")), f"WITH {TF_SQL} SELECT doc_id, chunk, field, keyword, tf FROM tf")
add("rt2_document_frequency", lambda s, d: retrieval.document_frequencies(retrieval.term_frequencies(CHUNKS(s, d), FIELDS)), f"WITH {TF_SQL} SELECT doc_id, keyword, df FROM df")
add("rt3_score", lambda s, d: retrieval.scores(CHUNKS(s, d), FIELDS).select("doc_id", "chunk", "field", F.round("raw", 6).alias("raw")), f"WITH {SCORED_SQL} SELECT doc_id, chunk, field, round(raw, 6) AS raw FROM scored")
add("rt4_boosts", lambda s, d: retrieval.scores(CHUNKS(s, d), FIELDS).select("doc_id", "chunk", "field", F.round("score", 6).alias("score")), f"WITH {SCORED_SQL} SELECT doc_id, chunk, field, round(score, 6) AS score FROM scored")
RETRIEVED_SQL = SCORED_SQL + ", lim AS (SELECT *, CASE field WHEN 'articles' THEN 4 ELSE 12 END AS k FROM scored), rk AS (SELECT *, count(*) FILTER (score > 0.3) OVER (PARTITION BY doc_id, field) AS good, row_number() OVER (PARTITION BY doc_id, field ORDER BY round(score, 6) DESC, chunk) AS place FROM lim), ret AS (SELECT doc_id, field, chunk FROM rk WHERE place <= k AND CASE WHEN least(good, k) >= k // 2 THEN score > 0.3 ELSE score > 0 END UNION SELECT doc_id, f AS field, chunk FROM chunks JOIN nd USING (doc_id) CROSS JOIN (VALUES ('articles'), ('marks')) AS v(f) WHERE chunk = 0 OR chunk = n - 1)"


def retrieved(s: SparkSession, d: str) -> DataFrame:
    chunks = CHUNKS(s, d)
    return retrieval.retrieve(chunks, retrieval.scores(chunks, FIELDS).withColumn("score", F.round("score", 6)), LIMITS)


add("rt5_retrieve", retrieved, f"WITH {RETRIEVED_SQL} SELECT doc_id, field, chunk FROM ret")
add("rt6_covered_pages", lambda s, d: retrieval.covered_pages(retrieved(s, d), CHUNKS(s, d)).select("doc_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages")), f"WITH {RETRIEVED_SQL} SELECT doc_id, string_agg(CAST(chunk + 1 AS VARCHAR), ',' ORDER BY chunk) AS pages FROM (SELECT DISTINCT doc_id, chunk FROM ret) GROUP BY doc_id")
add(
    "ch12_pages_of_spans",
    lambda s, d: retrieval.pages_of_spans(
        documents(s, d).where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 450).cast("int"))).alias("chunk")).selectExpr("doc_id", "chunk", "chunk * 450 AS start_pos", "chunk * 450 + 500 AS end_pos"),
        page_rows(s, d).select("doc_id", "page_no", ((F.col("page_no") - 1) * 200).alias("start_p"), (F.col("page_no") * 200).alias("end_p"), (F.col("page_no") % 5 / 5.0).alias("density"), (F.col("page_no") % 3 == 0).alias("has_header")),
    ).select("doc_id", "chunk", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "density", "has_header"),
    f"WITH {PAGES_SQL}, c AS (SELECT doc_id, CAST(g AS INTEGER) AS chunk, g * 450 AS a, g * 450 + 500 AS b FROM documents, unnest(generate_series(0, (length(text) - 1) // 450)) AS u(g) WHERE length(text) > 0) SELECT c.doc_id, chunk, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS pages, max(CAST(page_no % 5 AS DOUBLE) / 5) AS density, bool_or(page_no % 3 = 0) AS has_header FROM c JOIN pages_d p ON p.doc_id = c.doc_id AND (page_no - 1) * 200 < b AND page_no * 200 > a GROUP BY c.doc_id, chunk",
)

# ---- evidence

def locate_sql(wanted: str, prefix: int, least: int, cap: int, threshold: float) -> str:
    return f"""prep AS (SELECT *, {strip_sql(f'lower({wanted})')} AS low, {grams_sql(wanted)} AS grams FROM items WHERE length({wanted}) >= {least}),
  book AS (SELECT doc_id, page_no, lower(substring(text, 1, {cap})) AS page, {grams_sql(f'substring(text, 1, {cap})')} AS of_page FROM pages_d),
  cand AS (SELECT i.doc_id, i.ord, p.page_no, CASE WHEN contains(page, substring(low, 1, {prefix})) THEN 3.0 ELSE len(list_intersect(grams, of_page)) / nullif(CAST(len(grams) AS DOUBLE), 0) END AS s FROM prep i JOIN book p USING (doc_id)),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY s DESC, page_no) AS k FROM cand),
  located AS (SELECT doc_id, ord, page_no, CASE WHEN s = 3.0 THEN 1.0 ELSE s END AS confidence FROM best WHERE k = 1 AND s >= {threshold})"""


QUOTE, QUOTE_SQL = (lambda: F.when(F.length("quote") > 0, F.col("quote")).otherwise(F.col("text"))), "(CASE WHEN length(quote) > 0 THEN quote ELSE text END)"
LOCATED_SQL = f"WITH {PAGES_SQL}, {ITEMS_SQL}, {locate_sql(QUOTE_SQL, 60, 10, 2500, 0.5)}"
locate = lambda s, d: evidence.locate(item_rows(s, d), page_rows(s, d), QUOTE())
add("ve1_ve3_locate", lambda s, d: locate(s, d).withColumn("confidence", F.round("confidence", 6)), f"{LOCATED_SQL} SELECT doc_id, ord, page_no, round(confidence, 6) AS confidence FROM located")
add(
    "ve4_verify", lambda s, d: evidence.verify(item_rows(s, d), locate(s, d)).select("doc_id", "ord", "status", "source"),
    f"{LOCATED_SQL} SELECT i.doc_id, i.ord, CASE WHEN l.page_no IS NULL THEN 'removed' WHEN l.page_no = cited_page THEN 'verified' ELSE 'fixed' END AS status, 'p' || l.page_no AS source FROM items i LEFT JOIN located l USING (doc_id, ord)",
)
add(
    "ag13_verification_stats", lambda s, d: evidence.verification_stats(evidence.verify(item_rows(s, d), locate(s, d)), "ord"),
    f"{LOCATED_SQL} SELECT i.ord, count(*) AS total, count(*) FILTER (l.page_no = cited_page) AS verified, count(*) FILTER (l.page_no <> cited_page) AS fixed, count(*) FILTER (l.page_no IS NULL) AS removed FROM items i LEFT JOIN located l USING (doc_id, ord) GROUP BY i.ord",
)
add(
    "ve5_locate_variant", lambda s, d: evidence.locate(item_rows(s, d), page_rows(s, d), QUOTE(), 50, 15, None, 0.3).withColumn("confidence", F.round("confidence", 6)),
    f"WITH {PAGES_SQL}, {ITEMS_SQL}, {locate_sql(QUOTE_SQL, 50, 15, 100000, 0.3)} SELECT doc_id, ord, page_no, round(confidence, 6) AS confidence FROM located",
)
add(
    "ve6_locate_by_words", lambda s, d: evidence.locate_by_words(item_rows(s, d), page_rows(s, d)),
    f"WITH {PAGES_SQL}, {ITEMS_SQL}, i AS (SELECT *, {strip_sql('lower(quote)')} AS low, regexp_extract_all({strip_sql('lower(quote)')}, '[a-z]{{4,}}')[1:8] AS ws FROM items), c AS (SELECT doc_id, ord, page_no, CASE WHEN length(substring(low, 1, 40)) > 0 AND contains(lower(p.text), substring(low, 1, 40)) THEN 2.0 WHEN len(ws) >= 3 THEN len(list_filter(ws, lambda w: contains(lower(p.text), w))) / CAST(len(ws) AS DOUBLE) ELSE 0.0 END AS s FROM i JOIN pages_d p USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY s DESC, page_no) AS k FROM c) SELECT doc_id, ord, page_no FROM b WHERE k = 1 AND s >= 0.5",
)
KW_SQL = "list_filter(regexp_extract_all(lower(i.text), '[一-鿿]+|[a-z]{3,}|[0-9]+(?:[.][0-9]+)?%?'), lambda w: length(w) > 2)[1:15]"
add(
    "ve7_verify_by_keywords", lambda s, d: evidence.verify_by_keywords(item_rows(s, d), page_rows(s, d)),
    f"WITH {PAGES_SQL}, {ITEMS_SQL}, k AS (SELECT i.*, {KW_SQL} AS ws FROM items i), c AS (SELECT doc_id, ord, cited_page, page_no, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: contains(lower(p.text), w))) / CAST(len(ws) AS DOUBLE) ELSE 0.0 END AS s FROM k JOIN pages_d p USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY s DESC, page_no) AS r, max(CASE WHEN page_no = cited_page THEN s END) OVER (PARTITION BY doc_id, ord) AS own FROM c) SELECT doc_id, ord, CASE WHEN coalesce(own, 0) < 0.3 AND s >= 0.3 THEN page_no ELSE cited_page END AS page_no, CASE WHEN coalesce(own, 0) < 0.3 AND s >= 0.3 THEN 'fixed' ELSE 'verified' END AS status FROM b WHERE r = 1",
)
add(
    "ve8_relocate", lambda s, d: evidence.relocate(item_rows(s, d), page_rows(s, d)),
    f"WITH {PAGES_SQL}, {ITEMS_SQL}, k AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3) AS ws FROM items), c AS (SELECT doc_id, ord, cited_page, page_no, least(len(ws), 10) AS n, least(len(ws), 15) AS f, len(list_filter(ws[1:10], lambda w: contains(lower(p.text), w))) AS a, len(list_filter(ws[1:15], lambda w: contains(lower(p.text), w))) AS s FROM k JOIN pages_d p USING (doc_id)), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY s DESC, page_no) AS r, coalesce(max(CASE WHEN page_no = cited_page THEN a END) OVER (PARTITION BY doc_id, ord), 0) >= greatest(2.0, n * 0.25) AS ok FROM c) SELECT doc_id, ord, CASE WHEN NOT ok AND s >= greatest(3.0, f * 0.25) THEN page_no ELSE cited_page END AS page_no, ok AS verified, NOT ok AND s >= greatest(3.0, f * 0.25) AS moved FROM b WHERE r = 1",
)
add("ve9_quote_on_page", lambda s, d: evidence.quote_on_cited_page(item_rows(s, d), page_rows(s, d)), f"WITH {PAGES_SQL}, {ITEMS_SQL} SELECT i.doc_id, ord, coalesce(contains(lower(p.text), substring(lower(quote), 1, 30)), false) AS found FROM items i LEFT JOIN pages_d p ON p.doc_id = i.doc_id AND p.page_no = cited_page")
add("ve10_quote_page", lambda s, d: evidence.quote_page(item_rows(s, d), page_rows(s, d)), f"WITH {PAGES_SQL}, {ITEMS_SQL} SELECT i.doc_id, ord, coalesce(min(p.page_no), -1) AS page_no FROM items i LEFT JOIN pages_d p ON p.doc_id = i.doc_id AND contains(lower(p.text), substring(lower(quote), 1, 40)) GROUP BY i.doc_id, ord")
add(
    "ve11_size_conflict", lambda s, d: documents(s, d).select("doc_id", evidence.size_conflict(F.concat(F.lit("n = "), F.col("n_chars").cast("string")), F.concat(F.lit("a: "), (F.col("n_chars") / 2).cast("int").cast("string"), F.lit(", b: "), (F.col("doc_id") + 10).cast("string"))).alias("w")).where("w IS NOT NULL").select("doc_id", "w.population_n", "w.groups_n_sum"),
    "WITH x AS (SELECT doc_id, CASE WHEN n_chars BETWEEN 10 AND 999999 THEN n_chars END AS n, (CASE WHEN n_chars // 2 >= 10 THEN n_chars // 2 ELSE 0 END) + doc_id + 10 AS g FROM documents) SELECT doc_id, n AS population_n, g AS groups_n_sum FROM x WHERE n > 0 AND g > 0 AND abs(g - n) / CAST(n AS DOUBLE) > 0.05",
)
