"""The fourth part of the catalog: whole extractions and summaries, with stand-ins for models.

The stand-in ``Lister`` answers with the lines that hold a word, so SQL can say what comes out at the other end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import evaluation, flows, generate, incremental, pages
from pagemill.plans.catalog import ITEMS_SQL, PAGES_SQL, add, documents, item_rows, page_rows, strip_sql
from pagemill.plans.catalog_runs import EVENTS, LAST_WORDS_SQL
from pagemill.plans.catalog_tables import CHUNKS, LINES_SQL, RETRIEVED_SQL, locate_sql, retrieved
from pagemill.storage import shared_folder

MARK = "license"
LISTER = flows.Lister(MARK)
TYPES = lambda s, d: documents(s, d).select("doc_id", F.when(F.col("lang") == "en", "REVIEW").otherwise("OTHER").alias("doc_type"), F.to_json(F.struct("lang")).alias("upstream"))
BY_TYPE = {"REVIEW": "From {page_range}:\n{text}\n", "OTHER": "{text}\n"}


def items_sql(rows: str, order: str, key: str = "items") -> str:
    """The JSON of a list of {text, sources}, made of the columns text and sources."""
    return f"""'{{"{key}": [' || coalesce((SELECT string_agg('{{"text": ' || to_json(text) || ', "sources": [' || sources || ']}}', ', ' ORDER BY {order}) FROM {rows}), '') || ']}}'"""


PAGE_LINES_SQL = f"""{PAGES_SQL}, page_lines AS (SELECT doc_id, page_no, total_pages, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages_d),
  hits AS (SELECT *, '"p' || page_no || '"' AS sources FROM page_lines WHERE contains(text, '{MARK}'))"""

add(
    "gn6_direct_summary", lambda s, d: flows.direct_summary(documents(s, d), generate.Echo(), "{length} {text}").select("doc_id", "summary", F.size("key_points").cast("long").alias("points"), "error"),
    f"SELECT doc_id, CASE WHEN length({strip_sql('text')}) >= 100 THEN {LAST_WORDS_SQL("('400-600字 ' || text)", 1800)} END AS summary, CASE WHEN length({strip_sql('text')}) >= 100 THEN 0 ELSE NULL END AS points, CASE WHEN length({strip_sql('text')}) < 100 THEN '{flows.TOO_SHORT}' END AS error FROM documents",
)
add(
    "gn7_field_tasks", lambda s, d: generate.field_tasks(retrieved(s, d), CHUNKS(s, d)),
    f"WITH {RETRIEVED_SQL} SELECT doc_id, field, substring(string_agg(p.text, chr(10) || chr(10) ORDER BY chunk), 1, 12000) AS text FROM ret JOIN pages_d p USING (doc_id) WHERE p.page_no = chunk + 1 GROUP BY doc_id, field",
)
add(
    "gn9_windowed_extraction", lambda s, d: flows.windowed_extraction(page_rows(s, d), TYPES(s, d), LISTER, BY_TYPE).select("doc_id", "value", "parts"),
    f"""WITH {PAGE_LINES_SQL}, n AS (SELECT doc_id, (max(total_pages) - 1) // 22 + 1 AS parts FROM pages_d GROUP BY doc_id),
  once AS (SELECT h.doc_id, page_no, text, sources, min(i) AS i FROM hits h JOIN n USING (doc_id) GROUP BY h.doc_id, page_no, text, sources, CASE WHEN parts = 1 THEN i END)
  SELECT doc_id, {items_sql('once o WHERE o.doc_id = n.doc_id', 'page_no, i')} AS value, parts FROM n""",
)
add(
    "gn10_hybrid_union",
    lambda s, d: flows.hybrid_union(
        documents(s, d).select("doc_id", F.to_json(F.struct(F.array("lang").alias("key_findings"))).alias("value")),
        documents(s, d).select("doc_id", F.inline(F.array(F.struct(F.lit("findings").alias("field"), F.to_json(F.split("text", "\n")).alias("value")), F.struct(F.lit("metadata").alias("field"), F.to_json(F.struct("source")).alias("value"))))),
        TYPES(s, d),
    ),
    """SELECT doc_id, '{"key_findings": [' || CASE WHEN contains(text, chr(10)) THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x: CAST(to_json(x) AS VARCHAR)), ', ') ELSE CAST(to_json(lang) AS VARCHAR) END || '], "doc_metadata": {"source": ' || to_json(source) || '}}' AS value FROM documents""",
)
add(
    "gn11_scan_then_extract", lambda s, d: flows.scan_then_extract(page_rows(s, d), TYPES(s, d), generate.Echo(), LISTER, {"OTHER": "{text}"}, {"OTHER": "{text}"}).select("doc_id", "value"),
    f"WITH {PAGE_LINES_SQL}, k AS (SELECT * FROM hits WHERE page_no <= 10 OR page_no > total_pages - 3), n AS (SELECT DISTINCT doc_id FROM pages_d) SELECT doc_id, {items_sql('k WHERE k.doc_id = n.doc_id', 'page_no, i')} AS value FROM n",
)
add("gn12_quoted", lambda s, d: flows.quoted(item_rows(s, d)).select("doc_id", "ord"), f"WITH {ITEMS_SQL} SELECT doc_id, ord FROM items WHERE {strip_sql('quote')} <> ''")
add(
    "gn13_gn26_three_stages",
    lambda s, d: flows.three_stages(page_rows(s, d), flows.Lister(MARK, type="REVIEW"), flows.Lister(MARK, "findings"), flows.Lister('"text"'), {"classify": "{text}", "merge": "{metadata}\n{pages}"}, {"OTHER": "{text}"}).select("doc_id", "doc_type", "value", "calls"),
    f"""WITH {PAGE_LINES_SQL}, first5 AS (SELECT DISTINCT doc_id, page_no FROM pages_d WHERE page_no <= 5), plain AS (SELECT *, '' AS none FROM hits),
  told AS (SELECT doc_id, page_no, {items_sql("(SELECT doc_id AS d, page_no AS p, text, none AS sources, i FROM plain) x WHERE x.d = f.doc_id AND x.p = f.page_no", 'i', 'findings')} AS text, '' AS sources FROM first5 f WHERE EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = f.doc_id AND h.page_no = f.page_no)),
  n AS (SELECT doc_id, count(*) AS pages FROM first5 GROUP BY doc_id) SELECT doc_id, 'REVIEW' AS doc_type, {items_sql('told t WHERE t.doc_id = n.doc_id', 'page_no')} AS value, pages + 2 AS calls FROM n""",
)
PARTS_SQL = f"{LINES_SQL}, f AS (SELECT doc_id, count(*) AS n, min(CASE WHEN length({strip_sql('line')}) <= 120 AND regexp_matches(lower(line), '^the') THEN line_no END) AS r0, min(CASE WHEN length({strip_sql('line')}) <= 120 AND regexp_matches(lower(line), '^(of|de)') THEN line_no END) AS d0 FROM lines GROUP BY doc_id), g AS (SELECT doc_id, n, coalesce(r0, CAST(floor(n * 0.4) AS BIGINT)) AS r, coalesce(d0, CAST(floor(n * 0.75) AS BIGINT)) AS d1 FROM f), cuts AS (SELECT doc_id, r, CASE WHEN d1 < r THEN least(n, r + CAST(floor(n * 0.2) AS BIGINT)) ELSE d1 END AS d FROM g), placed AS (SELECT doc_id, line_no, line AS text, '' AS sources, CASE WHEN line_no < r THEN 0 WHEN line_no < d THEN 1 ELSE 2 END AS part FROM lines JOIN cuts USING (doc_id))"
add(
    "gn14_gn24_by_parts", lambda s, d: flows.extraction_by_parts(pages.numbered_lines(documents(s, d)), {p: LISTER for p in flows.PART_TOKENS}, {p: "{text}" for p in flows.PART_TOKENS}, "^the", "^(of|de)").select("doc_id", "value", "parts"),
    f"""WITH {PARTS_SQL}, n AS (SELECT doc_id, count(DISTINCT part) AS parts FROM placed GROUP BY doc_id), once AS (SELECT p.doc_id, text, sources, min(line_no) AS i FROM placed p JOIN n USING (doc_id) WHERE contains(text, '{MARK}') GROUP BY p.doc_id, text, sources, CASE WHEN parts = 1 THEN line_no END)
  SELECT doc_id, {items_sql('once o WHERE o.doc_id = n.doc_id', 'i')} AS value, parts FROM n""",
)
add("gn15_routed_extraction", lambda s, d: flows.routed_extraction(documents(s, d), TYPES(s, d), LISTER, BY_TYPE))
add(
    "gn16_judge", lambda s, d: generate.judge(documents(s, d).select("doc_id"), generate.Echo(), "{n}.5 | of 10", 3, n=F.col("doc_id") % 10).select("doc_id", "run", "score"),
    "SELECT doc_id, run, doc_id % 10 + CAST(0.5 AS DOUBLE) AS score FROM documents, (VALUES (1), (2), (3)) AS r(run)",
)
add(
    "gn17_samples", lambda s, d: flows.sample_documents(documents(s, d), LISTER, "{doc_type}\n{text}", "lang").select("lang", "doc_id", "sample"),
    f"WITH {LINES_SQL}, n AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang) SELECT lang, doc_id, {items_sql(f"(SELECT doc_id AS d, line AS text, '' AS sources, line_no FROM lines WHERE contains(line, '{MARK}')) l WHERE l.d = n.doc_id", 'line_no')} AS sample FROM n",
)


def exact_tokens(s: SparkSession, d: str) -> DataFrame:
    import public_tokenizers as P

    return flows.exact_tokens(documents(s, d), P.path("byte_bpe_50k.json"))


add("gn25_exact_tokens", exact_tokens)
add(
    "sc1_too_short", lambda s, d: documents(s, d).select("doc_id", F.when(F.length(tx.strip(F.coalesce("text", F.lit("")))) < 100, "ContentTooShort").alias("error")).select("doc_id", "error", generate.status_of(F.col("error")).cast("long").alias("status")),
    f"SELECT doc_id, CASE WHEN length({strip_sql('text')}) < 100 THEN 'ContentTooShort' END AS error, CASE WHEN length({strip_sql('text')}) < 100 THEN 422 ELSE 200 END AS status FROM documents",
)
add(
    "wn11_eviction", lambda s, d: evaluation.evict_finished(EVENTS(s, d), F.col("event_type") != "error", ["ts", "event_id"], 5000).select("event_id"),
    "WITH u AS (SELECT event_id FROM events WHERE event_type = 'error'), f AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'error') SELECT event_id FROM u UNION ALL SELECT event_id FROM f WHERE k <= greatest(0, 5000 - (SELECT count(*) FROM u))",
)


def incremental_run(s: SparkSession, d: str) -> DataFrame:
    """The table of documents as a stream, run twice; the second run finds nothing to do."""
    folder = f"{shared_folder(s)}/extraction-{uuid.uuid4().hex}"
    schema = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").schema
    kinds = lambda docs: docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "REVIEW").otherwise("OTHER").alias("doc_type"))
    for _ in range(2):
        # a pattern, since the table may be a file and a stream's plain path must be a folder
        incremental.run(s.readStream.schema(schema).parquet(f"{d}/documents.parque[t]"), folder, lambda docs: incremental.extracted(docs, kinds, LISTER, BY_TYPE), "1")
    return incremental.latest(incremental.cached(s, folder)).select("doc_id", "hash", "total", "verified", "fixed", "removed", "failed", "batch")


add(
    "ca4_gn23_incremental", incremental_run,
    f"""WITH {PAGE_LINES_SQL}, n AS (SELECT doc_id, (max(total_pages) - 1) // 22 + 1 AS parts FROM pages_d GROUP BY doc_id),
  once AS (SELECT h.doc_id, page_no, text, min(i) AS i FROM hits h JOIN n USING (doc_id) GROUP BY h.doc_id, page_no, text, CASE WHEN parts = 1 THEN i END),
  items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, i) AS ord, text, page_no AS cited_page FROM once), {locate_sql('text', 60, 10, 2500, 0.5)},
  st AS (SELECT i.doc_id, count(*) AS total, count(*) FILTER (l.page_no = cited_page) AS verified, count(*) FILTER (l.page_no <> cited_page) AS fixed, count(*) FILTER (l.page_no IS NULL) AS removed FROM items i LEFT JOIN located l USING (doc_id, ord) GROUP BY i.doc_id)
  SELECT doc_id, md5(text) AS hash, coalesce(total, 0) AS total, coalesce(verified, 0) AS verified, coalesce(fixed, 0) AS fixed, coalesce(removed, 0) AS removed, 0 AS failed, 0 AS batch FROM documents LEFT JOIN st USING (doc_id)""",
)
