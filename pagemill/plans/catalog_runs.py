"""The third part of the catalog: merging, replies, runs, calls and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import json as js
from pagemill.functions import text as tx
from pagemill.operators import caches, chunking, condense, evaluation, generate, merge, pages
from pagemill.plans.catalog import ITEMS_SQL, PAGES_SQL, SP, TOKENS_SQL, add, documents, item_rows, on_documents, page_rows, strip_sql
from pagemill.plans.catalog_tables import RULES, SECTION_SQL
from pagemill.sources import sinks
from pagemill.streaming import states

T = lambda: F.col("text")

# ---- merging: a document's lines are its items, a line's last sentence is its quotation


def line_items(s: SparkSession, d: str) -> DataFrame:
    lines = documents(s, d).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("_at", "text"))
    quote = F.when(F.contains("text", F.lit(". ")), F.substring_index("text", ". ", -1)).otherwise(F.lit(""))
    return lines.select("doc_id", (F.col("_at") + 1).cast("long").alias("ord"), "text", quote.alias("quote"), "lang")


LINE_ITEMS_SQL = "items AS (SELECT doc_id, ord, line AS text, CASE WHEN contains(line, '. ') THEN string_split(line, '. ')[-1] ELSE '' END AS quote, lang FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents))"
add(
    "dm1_dedup_two_keys", lambda s, d: merge.dedup_two_keys(line_items(s, d)).select("doc_id", "ord"),
    f"""WITH RECURSIVE {LINE_ITEMS_SQL}, o AS (SELECT *, md5(regexp_replace(lower({strip_sql('text')}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS t, lower({strip_sql('quote')}) AS q, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM items WHERE {strip_sql('text')} <> ''),
  f AS (SELECT doc_id, ord, k, true AS kept, [t] AS ts, CASE WHEN q <> '' THEN [q] ELSE []::VARCHAR[] END AS qs FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.ord, o.k, NOT (list_contains(ts, t) OR (q <> '' AND list_contains(qs, q))),
    CASE WHEN list_contains(ts, t) OR (q <> '' AND list_contains(qs, q)) THEN ts ELSE list_append(ts, t) END, CASE WHEN q = '' OR list_contains(ts, t) OR list_contains(qs, q) THEN qs ELSE list_append(qs, q) END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1) SELECT doc_id, ord FROM f WHERE kept""",
)
NEAR_SQL = "len(list_filter(seen, lambda v: coalesce(len(list_intersect(v, w)) / nullif(CAST(least(len(v), len(w)) AS DOUBLE), 0), 0) > 0.6)) > 0"
add(
    "dm2_dedup_fuzzy", lambda s, d: merge.dedup_fuzzy(line_items(s, d)).select("doc_id", "ord"),
    f"""WITH RECURSIVE {LINE_ITEMS_SQL}, o AS (SELECT doc_id, ord, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM items WHERE length(text) >= 10),
  f AS (SELECT doc_id, ord, k, true AS kept, [w] AS seen FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.ord, o.k, NOT {NEAR_SQL}, CASE WHEN {NEAR_SQL} THEN seen ELSE list_append(seen, w) END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1) SELECT doc_id, ord FROM f WHERE kept""",
)
add(
    "dm3_dedup_prefix", lambda s, d: merge.dedup_prefix(line_items(s, d), 120, 25).select("doc_id", "ord"),
    f"WITH {LINE_ITEMS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substring({strip_sql('lower(text)')}, 1, 120) ORDER BY ord) AS k FROM items), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS j FROM a WHERE k = 1) SELECT doc_id, ord FROM b WHERE j <= 25",
)
add("dm4_first_filled", lambda s, d: merge.first_filled(line_items(s, d), ["doc_id"], "ord", "quote", "text"), f"WITH {LINE_ITEMS_SQL} SELECT doc_id, arg_min(quote, ord) FILTER (quote <> '') AS quote, arg_min(text, ord) FILTER (text <> '') AS text FROM items GROUP BY doc_id")
add(
    "dm5_merge_lists", lambda s, d: merge.merge_lists(line_items(s, d).withColumn("words", F.split("text", " ")), ["doc_id"], "ord", "words").select("doc_id", F.array_join("words", "|").alias("words")),
    f"WITH {LINE_ITEMS_SQL}, w AS (SELECT doc_id, ord, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM items), f AS (SELECT doc_id, w, min(ord * 1000000 + i) AS place FROM w GROUP BY ALL) SELECT doc_id, string_agg(w, '|' ORDER BY place) AS words FROM f GROUP BY doc_id",
)
add(
    "dm6_overwrite", lambda s, d: documents(s, d).select("doc_id", merge.overwrite(F.create_map(F.lit("lang"), F.col("lang"), F.lit("a"), F.lit("x")), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.col("source"))).otherwise(F.create_map(F.lit("b"), F.lit("y")))).alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.size("m").cast("long").alias("n")),
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS n FROM documents",
)
add(
    "dm7_composite_merge", lambda s, d: merge.composite_merge(line_items(s, d).withColumn("chunk", F.floor(F.col("ord") / 5)).withColumn("mark", F.when(F.contains("text", F.lit("license")), "license")), ["quote", "mark"]).select("doc_id", "ord"),
    f"WITH {LINE_ITEMS_SQL}, c AS (SELECT *, ord // 5 AS chunk, {strip_sql('lower(quote)')} || '|' || CASE WHEN contains(text, 'license') THEN 'license' ELSE '' END AS key FROM items), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY chunk, ord) AS k, min(chunk) OVER (PARTITION BY doc_id) AS f FROM c) SELECT doc_id, ord FROM r WHERE chunk = f OR (k = 1 AND replace(key, '|', '') <> '')",
)
on_documents("dm9_fill_missing", "string", lambda: merge.fill_missing(F.when(F.col("doc_id") % 2 == 0, F.lit("Not Reported")).otherwise(F.col("lang")), F.col("source")), "CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END")
add(
    "dm10_reduce", lambda s, d: merge.reduce_notes(line_items(s, d).selectExpr("doc_id", "ord", "text AS note", "concat('p', ord div 5) AS source", "nullif(quote, '') AS scalar"), ["doc_id"], "ord").withColumn("sources", F.array_join("sources", "|")),
    f"WITH {LINE_ITEMS_SQL}, n AS (SELECT doc_id, text, min(ord) AS place FROM items WHERE text <> '' GROUP BY ALL), a AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY place) AS notes FROM n GROUP BY doc_id), b AS (SELECT doc_id, string_agg(DISTINCT 'p' || ord // 5, '|' ORDER BY 'p' || ord // 5) AS sources, arg_max(quote, ord) FILTER (quote <> '') AS scalar FROM items GROUP BY doc_id) SELECT doc_id, coalesce(notes, '') AS notes, sources, scalar FROM b LEFT JOIN a USING (doc_id)",
)
on_documents("dm11_longer", "string", lambda: F.array_join(merge.longer(F.array("lang"), F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang"))), ","), "CASE WHEN doc_id % 2 = 0 THEN source || ',' || lang ELSE lang END")
HALVES = lambda first: F.array_distinct(F.flatten(F.collect_list(F.when((F.col("page_no") * 2 <= F.col("total_pages")) == first, F.split("text", " ")))))
add(
    "dm12_compare_sets", lambda s, d: page_rows(s, d).groupBy("doc_id").agg(HALVES(True).alias("a"), HALVES(False).alias("b")).select("doc_id", merge.compare_sets(F.col("a"), F.col("b")).alias("c")).select("doc_id", F.size("c.common").cast("long").alias("common"), F.array_join("c.only_left", " ").alias("l"), F.array_join("c.only_right", " ").alias("r")),
    f"WITH {PAGES_SQL}, w AS (SELECT DISTINCT doc_id, page_no * 2 <= total_pages AS first, unnest(string_split(text, ' ')) AS w FROM pages_d), g AS (SELECT doc_id, w, bool_or(first) AS a, bool_or(NOT first) AS b FROM w GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a, b ORDER BY w) AS k FROM g) SELECT doc_id, count(*) FILTER (a AND b) AS common, coalesce(string_agg(w, ' ' ORDER BY w) FILTER (a AND NOT b AND k <= 5), '') AS l, coalesce(string_agg(w, ' ' ORDER BY w) FILTER (b AND NOT a AND k <= 5), '') AS r FROM p GROUP BY doc_id",
)
add("dm13_page_union", lambda s, d: page_rows(s, d).where("page_no <= 3").select("doc_id", "page_no").union(page_rows(s, d).where(F.contains(T(), F.lit("license"))).select("doc_id", "page_no")).distinct(), f"WITH {PAGES_SQL} SELECT doc_id, page_no FROM pages_d WHERE page_no <= 3 OR contains(text, 'license')")
add(
    "dm14_chunk_summaries", lambda s, d: pages.joined(page_rows(s, d), "page_no", F.concat(F.lit("[部分 "), F.col("page_no").cast("string"), F.lit("] "), F.col("text")), "\n\n"),
    f"WITH {PAGES_SQL} SELECT doc_id, string_agg('[部分 ' || page_no || '] ' || text, chr(10) || chr(10) ORDER BY page_no) AS text FROM pages_d GROUP BY doc_id",
)

# ---- replies

REPLY = lambda: F.concat(F.lit("<think>{x</think>```json\n{\"lang\": \""), F.col("lang"), F.lit("\", \"n\": ["), F.col("doc_id").cast("string"), F.lit(",], }\n```"))
on_documents("js1_first_object", "long", lambda: F.get_json_object(js.first_object(F.concat(F.lit("note {\"n\": "), F.col("doc_id").cast("string"), F.lit(", \"s\": \"}{\"} tail }"))), "$.n"), "doc_id")
on_documents("js2_extract", "string", lambda: F.get_json_object(js.extracted(REPLY()), "$.lang"), "lang")
on_documents("js3_untruncated", "string", lambda: js.untruncated(F.concat(F.lit("{\"a\":[{\"n\":"), F.col("doc_id").cast("string"), F.lit("}],\"b\":[{\"n\":"))), "'{\"a\":[{\"n\":' || doc_id || '}]}'")
on_documents("js4_closed", "string", lambda: js.closed(F.concat(F.lit("{\"a\":[["), F.col("doc_id").cast("string"))), "'{\"a\":[[' || doc_id || ']]}'")
on_documents("js5_source_lists", "long", lambda: F.aggregate(js.flattened_sources(F.concat(F.lit("{\"a\":{\"sources\":[\"p1\"]},\"b\":[{\"sources\":[\"p"), F.col("doc_id").cast("string"), F.lit("\",\"p2\"]}]}"))), F.lit(0), lambda n, x: n + F.size(x["sources"])), "3")
on_documents("js7_sample", "string", lambda: js.sample(F.struct(F.split("text", " ").alias("findings")), {"findings": 2}, 40), "substring('{\"findings\":' || to_json(string_split(text, ' ')[1:2]) || '}', 1, 40)")
on_documents("js9_greedy", "string", lambda: js.greedy(F.concat(F.lit("so {\"lang\":\""), F.col("lang"), F.lit("\"} ok"))), "'{\"lang\":\"' || lang || '\"}'")
on_documents("js10_ordered", "string", lambda: F.get_json_object(js.or_summary(F.when(F.col("doc_id") % 2 == 0, F.lit("plain words")).otherwise(F.concat(F.lit("```json\n{\"summary\":\""), F.col("lang"), F.lit("\"}```")))), "$.summary"), "CASE WHEN doc_id % 2 = 0 THEN 'plain words' ELSE lang END")

# ---- aggregates over runs; labels and lengths stand for scores

add(
    "ag1_histogram", lambda s, d: evaluation.histogram(documents(s, d), F.col("lang"), F.col("n_chars") < 200).withColumn("percent", F.round("percent", 6)),
    "WITH t AS (SELECT CASE WHEN n_chars < 200 THEN 'ERROR' ELSE lang END AS type, count(*) AS n FROM documents GROUP BY ALL) SELECT type, n, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 6) AS percent FROM t",
)
LABELLED = lambda s, d: documents(s, d).join(s.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
add("ag2_scored_mean", lambda s, d: LABELLED(s, d).groupBy("source").agg(F.round(evaluation.scored_mean(F.col("quality")), 6).alias("mean"), F.count("quality").alias("n")), "SELECT source, round(avg(quality), 6) AS mean, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
add(
    "ag3_run_scores", lambda s, d: evaluation.run_scores(documents(s, d).withColumn("score", (F.col("n_chars") % 11).cast("double")), ["source"]),
    "SELECT source, round(avg(n_chars % 11), 2) AS mean, round(stddev_pop(n_chars % 11), 2) AS std, count(*) AS n_runs FROM documents WHERE n_chars % 11 > 0 GROUP BY source",
)
EVENTS = lambda s, d: s.read.parquet(f"{d}/events.parquet")
add(
    "ag4_throughput", lambda s, d: evaluation.throughput(EVENTS(s, d), ["user_id"], F.col("value"), F.col("event_type") != "error").select("user_id", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "per_minute", "success_rate"))),
    "SELECT user_id, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(count(*) / (sum(value) / 60), 6) AS per_minute, round(avg(CAST(event_type <> 'error' AS INTEGER)), 6) AS success_rate FROM events GROUP BY user_id",
)
add("ag5_threshold_share", lambda s, d: documents(s, d).groupBy("lang").agg(F.round(evaluation.share(F.col("n_chars") % 11 >= 8), 6).alias("value")), "SELECT lang, round(avg(CAST(n_chars % 11 >= 8 AS INTEGER)), 6) AS value FROM documents GROUP BY lang")
add("ag6_group_mean", lambda s, d: documents(s, d).groupBy("lang").agg(F.round(F.avg(F.col("n_chars")), 6).alias("mean"), F.count_if(F.contains("text", F.lit("license"))).alias("marked"), F.count(F.lit(1)).alias("n")), "SELECT lang, round(avg(n_chars), 6) AS mean, count(*) FILTER (contains(text, 'license')) AS marked, count(*) AS n FROM documents GROUP BY lang")
add("ag7_token_totals", lambda s, d: page_rows(s, d).groupBy("doc_id").agg(F.sum(tx.token_estimate(T())).alias("tokens")), f"WITH {PAGES_SQL} SELECT doc_id, CAST(sum({TOKENS_SQL}) AS BIGINT) AS tokens FROM pages_d GROUP BY doc_id")
add(
    "ag8_source_hit_rate", lambda s, d: evaluation.source_hit_rate(documents(s, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p1"), F.lit("P3"), F.concat(F.lit("p"), (F.col("doc_id") % 40).cast("string")), F.lit("x"))).alias("sources")), page_rows(s, d)).withColumn("rate", F.round("rate", 6)),
    "WITH c AS (SELECT doc_id, ceil(length(text) / 200.0) AS n FROM documents), h AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 3 END AS total, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (CASE WHEN 1 <= n THEN 1 ELSE 0 END) + (CASE WHEN 3 <= n THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 40 BETWEEN 1 AND n THEN 1 ELSE 0 END) END AS hits FROM c) SELECT doc_id, hits, total, CASE WHEN total = 0 THEN 1.0 ELSE round(hits / CAST(total AS DOUBLE), 6) END AS rate FROM h",
)
add("ag9_completion", lambda s, d: LABELLED(s, d).select("doc_id", F.round(tx.filled_fields([F.col("lang"), F.col("source"), F.col("quality").cast("string"), F.col("toxic").cast("string")]) / 4.0, 3).alias("value")), "SELECT doc_id, CASE WHEN quality IS NULL THEN 0.5 ELSE 1.0 END AS value FROM documents LEFT JOIN labels USING (doc_id)")
VERDICTS = lambda s, d: s.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("truth"), (F.col("doc_id") % 2).cast("int").alias("a"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("b"))
add(
    "ag10_agreement", lambda s, d: evaluation.agreement(VERDICTS(s, d), "a", "b", "truth"),
    "WITH v AS (SELECT quality AS t, doc_id % 2 AS a, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS b FROM labels) SELECT count(*) FILTER (a = t) AS a_right, count(*) FILTER (b = t) AS b_right, count(*) FILTER (a = t AND b = t) AS both, count(*) FILTER (a = t AND b <> t) AS only_a, count(*) FILTER (a <> t AND b = t) AS only_b, count(*) FILTER (a <> b) AS disagree, count(*) AS n FROM v",
)
add(
    "ag11_delta", lambda s, d: evaluation.deltas(documents(s, d).withColumn("v", F.when(F.col("doc_id") % 2 == 0, "old").otherwise("new")), ["source"], "v", "old", "new", ["n_chars"]).withColumn("n_chars", F.round("n_chars", 6)),
    "SELECT source, round(avg(n_chars) FILTER (doc_id % 2 = 1) - avg(n_chars) FILTER (doc_id % 2 = 0), 6) AS n_chars FROM documents GROUP BY source",
)
add("ag12_citation_rate", lambda s, d: item_rows(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("quote") != "").cast("int")).alias("rate")), f"WITH {ITEMS_SQL} SELECT doc_id, count(*) AS items, avg(CAST(quote <> '' AS INTEGER)) AS rate FROM items GROUP BY doc_id")
add("ag14_all_statuses", lambda s, d: evaluation.all_statuses(EVENTS(s, d), "event_type", ["click", "error", "never"]), "SELECT v AS status, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('never')) AS t(v) LEFT JOIN events ON event_type = v GROUP BY v")
add("ag15_rollup", lambda s, d: page_rows(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(tx.is_empty_page(T())).alias("skipped"), F.array_join(F.array_sort(F.collect_list(F.when(F.contains("text", F.lit("license")), F.col("page_no")))).cast("array<string>"), ",").alias("key_pages")), f"WITH {PAGES_SQL} SELECT doc_id, count(*) AS total, count(*) FILTER (length(regexp_replace(text, '{SP}+', '', 'g')) < 100) AS skipped, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (contains(text, 'license')), '') AS key_pages FROM pages_d GROUP BY doc_id")
add(
    "ag16_best_of", lambda s, d: evaluation.best_of(documents(s, d).withColumn("score", F.col("n_chars") % 11), ["source"], "score", "doc_id", "doc_id"),
    "WITH r AS (SELECT *, n_chars % 11 AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars % 11 DESC, doc_id) AS k FROM documents WHERE n_chars % 11 > 0) SELECT source, doc_id, score FROM r WHERE k = 1",
)
add("ag17_mean_by_size", lambda s, d: documents(s, d).withColumn("score", F.col("n_chars") % 11).where("score > 0").groupBy(pages.size_bucket(F.ceil(F.length("text") / 200)).alias("bucket")).agg(F.round(F.avg("score"), 6).alias("mean")), "SELECT CASE WHEN ceil(length(text) / 200.0) <= 15 THEN 'short' WHEN ceil(length(text) / 200.0) <= 50 THEN 'medium' ELSE 'long' END AS bucket, round(avg(n_chars % 11), 6) AS mean FROM documents WHERE n_chars % 11 > 0 GROUP BY ALL")
add(
    "ag18_dimensions", lambda s, d: LABELLED(s, d).agg(*(F.round(F.avg(F.coalesce(c, F.lit(0))), 6).alias(c) for c in ("quality", "toxic")), *(F.round(evaluation.share(F.col("n_chars") % 11 >= n), 6).alias(f"share_{n}") for n in (8, 9))),
    "SELECT round(avg(coalesce(quality, 0)), 6) AS quality, round(avg(coalesce(toxic, 0)), 6) AS toxic, round(avg(CAST(n_chars % 11 >= 8 AS INTEGER)), 6) AS share_8, round(avg(CAST(n_chars % 11 >= 9 AS INTEGER)), 6) AS share_9 FROM documents LEFT JOIN labels USING (doc_id)",
)
add("ag19_integer_mean", lambda s, d: documents(s, d).groupBy("source").agg(evaluation.integer_mean(F.col("n_chars")).alias("value")), "SELECT source, CAST(sum(n_chars) // count(*) AS BIGINT) AS value FROM documents GROUP BY source")
add("ag20_run_totals", lambda s, d: LABELLED(s, d).select("doc_id", (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) + F.col("n_chars")).alias("value")), "SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) + n_chars AS value FROM documents LEFT JOIN labels USING (doc_id)")
on_documents("ag21_item_count", "long", lambda: F.coalesce(F.size(F.when(F.col("doc_id") % 2 == 0, F.split("text", "\n"))), F.lit(0)), "CASE WHEN doc_id % 2 = 0 THEN len(string_split(text, chr(10))) ELSE 0 END")

# ---- calls

LAST = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW"


def metrics(s: SparkSession, d: str, size: int) -> DataFrame:
    return evaluation.window_metrics(EVENTS(s, d), "user_id", ["ts", "event_id"], F.col("event_type") != "error", "value", size)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*("user_id", "event_id"), *(F.round(c, 9).alias(c) for c in columns))


add("wn1_error_rate", lambda s, d: rounded(metrics(s, d, 100), "error_rate", "mean_latency"), f"SELECT user_id, event_id, round(avg(CAST(event_type = 'error' AS INTEGER)) OVER ({LAST.format(99)}), 9) AS error_rate, round(avg(value) OVER ({LAST.format(99)}), 9) AS mean_latency FROM events")
P99_SQL = f"WITH l AS (SELECT user_id, event_id, ts, list_sort(list(value) OVER ({LAST.format(99)})) AS v FROM events), p AS (SELECT user_id, event_id, ts, v[least(CAST(floor(len(v) * CAST(0.99 AS DOUBLE)) AS BIGINT), len(v) - 1) + 1] AS p99, len(v) AS n FROM l)"
add("wn2_p99", lambda s, d: rounded(metrics(s, d, 100), "p99"), f"{P99_SQL} SELECT user_id, event_id, round(p99, 9) AS p99 FROM p")
add("wn4_failure_rate", lambda s, d: rounded(metrics(s, d, 10), "error_rate"), f"SELECT user_id, event_id, round(avg(CAST(event_type = 'error' AS INTEGER)) OVER ({LAST.format(9)}), 9) AS error_rate FROM events")
add(
    "ag22_snapshot", lambda s, d: evaluation.latest(metrics(s, d, 100), ["user_id"], ["ts", "event_id"]).select("user_id", F.round("error_rate", 2).alias("error_rate"), F.round("p99", 2).alias("p99")),
    f"WITH l AS (SELECT user_id, event_id, ts, list_sort(list(value) OVER ({LAST.format(99)})) AS v, avg(CAST(event_type = 'error' AS INTEGER)) OVER ({LAST.format(99)}) AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, round(e, 2) AS error_rate, round(v[least(CAST(floor(len(v) * CAST(0.99 AS DOUBLE)) AS BIGINT), len(v) - 1) + 1], 2) AS p99 FROM l WHERE k = 1",
)
CALLS = lambda s, d: EVENTS(s, d).select(F.col("user_id").alias("client"), "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
add("wn3_alerts", lambda s, d: states.fold(CALLS(s, d), states.Alerts).where("outcome <> ''"))
add("wn5_breaker", lambda s, d: states.fold(CALLS(s, d), states.Breaker))
add("wn9_backpressure", lambda s, d: states.fold(CALLS(s, d), states.Backpressure))
add("wn6_rate_limiter", lambda s, d: states.fold(CALLS(s, d), states.RateLimiter))
add(
    "wn6_request_count", lambda s, d: EVENTS(s, d).select("event_id", evaluation.requests_within(EVENTS(s, d), "user_id", 3600).alias("n")),
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events",
)
add(
    "wn7_remaining", lambda s, d: EVENTS(s, d).select("event_id", F.greatest(F.lit(0), F.lit(3) - evaluation.requests_within(EVENTS(s, d), "user_id", 3600)).cast("long").alias("n")),
    "SELECT event_id, greatest(0, 3 - count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)) AS n FROM events",
)
add("wn10_latest_status", lambda s, d: evaluation.latest(EVENTS(s, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type"), "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
add(
    "wn8_idle_clients", lambda s, d: states.idle_clients(CALLS(s, d)).withColumns({c: F.round(c, 3) for c in ("last_seen", "evicted_at")}),
    "WITH c AS (SELECT user_id AS client, epoch_us(ts) / 1e6 AS t, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT client, round(t, 3) AS last_seen, round(t + 3600, 3) AS evicted_at FROM c WHERE n IS NULL OR n - t >= 3600",
)
add("wn10_task_states", lambda s, d: states.fold(CALLS(s, d), states.Tasks))


def kept_tasks(s: SparkSession, d: str) -> DataFrame:
    rows = EVENTS(s, d)
    latest = rows.agg(F.max("ts").alias("_now"))  # one row
    fresh = rows.crossJoin(F.broadcast(latest)).where(~((F.col("event_type") == "purchase") & (F.col("ts") < F.col("_now") - F.expr("INTERVAL 10 DAYS"))))
    return fresh.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


add("wn11_expiry", kept_tasks, "SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type = 'purchase' AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAYS) GROUP BY event_type")
add("wn14_request_log", lambda s, d: EVENTS(s, d).where("event_type <> 'view'").select("event_id", F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO").alias("level"), F.round("value", 2).alias("seconds")), "SELECT event_id, CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level, round(value, 2) AS seconds FROM events WHERE event_type <> 'view'")

# ---- caches: a hash is a text's, a version its source

ENTRIES = lambda s, d: documents(s, d).select(F.md5(F.col("text").cast("binary")).alias("hash"), F.col("source").alias("version"), F.col("doc_id").alias("created_at"), F.col("n_chars").alias("value"))
add(
    "ca4_missing_work", lambda s, d: caches.missing_work(ENTRIES(s, d), ENTRIES(s, d).where("created_at % 3 = 0")).select("hash", "created_at"),
    "WITH e AS (SELECT md5(text) AS hash, source AS version, doc_id AS created_at FROM documents) SELECT hash, created_at FROM e WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.created_at % 3 = 0 AND c.hash = e.hash AND c.version = e.version)",
)
add(
    "ca4_replace", lambda s, d: caches.replace_entries(ENTRIES(s, d).where("created_at % 2 = 0"), ENTRIES(s, d).where("created_at % 2 = 1")).select("hash", "version"),
    "SELECT hash, version FROM (SELECT md5(text) AS hash, source AS version, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1",
)
add("ca1_live_entries", lambda s, d: caches.live_entries(documents(s, d).selectExpr("doc_id AS hash", "n_chars AS created_at", "n_chars AS used_at"), 5000, 4500, 50).select("hash"), "SELECT doc_id AS hash FROM documents WHERE n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 50")
KEYED = lambda s, d: documents(s, d).select(F.col("doc_id").alias("hash"), F.col("lang").alias("value"))
TIERS = lambda s, d: caches.two_tiers(KEYED(s, d).select("hash"), KEYED(s, d).where("hash % 3 = 0"), KEYED(s, d).where("hash % 2 = 0"))
add("ca2_two_tiers", TIERS, "SELECT doc_id AS hash, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN lang END AS value, CASE WHEN doc_id % 3 = 0 THEN 'l1' WHEN doc_id % 2 = 0 THEN 'l2' ELSE 'miss' END AS tier FROM documents")
add("ca6_stats", lambda s, d: caches.stats(TIERS(s, d)), "SELECT count(*) FILTER (doc_id % 3 = 0 OR doc_id % 2 = 0) AS hits, count(*) FILTER (NOT (doc_id % 3 = 0 OR doc_id % 2 = 0)) AS misses, avg(CAST(doc_id % 3 = 0 OR doc_id % 2 = 0 AS INTEGER)) AS hit_rate FROM documents")
add("ca5_summary_cache", lambda s, d: documents(s, d).groupBy(tx.cache_key(T(), F.col("lang"), 500).alias("key")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "SELECT md5(text || ':' || lang || ':500') AS key, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY ALL")

# ---- prompts, tasks, chunks, exports

on_documents("gn3_prompt", "string", lambda: generate.prompt("Summarise ({lang}): {text} END", lang=F.col("lang"), text=F.col("text")), "'Summarise (' || lang || '): ' || text || ' END'")
SECTION_TASKS_SQL = f"WITH {PAGES_SQL}, s AS (SELECT doc_id, page_no, {SECTION_SQL} AS section FROM pages_d), p AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY doc_id, section ORDER BY page_no) - 1 AS at_ FROM s WINDOW w AS (PARTITION BY doc_id, section)), c AS (SELECT doc_id, section, page_no, CAST(0 AS BIGINT) AS chunk FROM p WHERE n <= 30 UNION ALL SELECT doc_id, section, page_no, g FROM p, generate_series(0, (n - 1) // 17) AS u(g) WHERE n > 30 AND at_ >= g * 17 AND at_ < g * 17 + 20) SELECT doc_id, section, chunk, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS pages FROM c GROUP BY ALL"
add("gn8_section_tasks", lambda s, d: generate.section_tasks(page_rows(s, d), RULES), SECTION_TASKS_SQL)
add("gn21_status", lambda s, d: documents(s, d).select("doc_id", generate.status_of(F.when(F.length("text") < 100, "ContentTooShort").when(F.length("text") > 10000, "Other")).cast("long").alias("value")), "SELECT doc_id, CASE WHEN length(text) < 100 THEN 422 WHEN length(text) > 10000 THEN 500 ELSE 200 END AS value FROM documents")
add("gn23_errors", lambda s, d: generate.generate(documents(s, d).select("doc_id", "text"), F.col("text"), generate.Echo(poison="license"), 5, 1).select("doc_id", (F.col("error").isNotNull()).alias("failed")), "SELECT doc_id, contains(text, 'license') AS failed FROM documents")
NORMAL_SQL = lambda t: strip_sql(f"regexp_replace({t}, '{SP}+', ' ', 'g')")
LAST_WORDS_SQL = lambda t, n: f"array_to_string(string_split({NORMAL_SQL(t)}, ' ')[-{n}:], ' ')"
add(
    "gn4_map_reduce", lambda s, d: generate.map_reduce(page_rows(s, d).selectExpr("doc_id", "page_no - 1 AS chunk", "text"), generate.Echo(), "{text}", "{text}", 100),
    f"WITH {PAGES_SQL}, m AS (SELECT doc_id, string_agg('[部分 ' || page_no || '] ' || {LAST_WORDS_SQL('text', 100)}, chr(10) || chr(10) ORDER BY page_no) AS t FROM pages_d GROUP BY doc_id) SELECT doc_id, {LAST_WORDS_SQL('t', 100)} AS reply, CAST(NULL AS VARCHAR) AS error FROM m",
)
add(
    "gn5_refine", lambda s, d: generate.refine(page_rows(s, d).selectExpr("doc_id", "page_no AS chunk", "text"), generate.Echo(), "{text}", "{summary} {text}", 20),
    f"WITH {PAGES_SQL}, m AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_no) AS t FROM pages_d GROUP BY doc_id) SELECT doc_id, {LAST_WORDS_SQL('t', 20)} AS reply, CAST(NULL AS VARCHAR) AS error FROM m",
)
for _mode, _options in (("chars", {"size": 800, "overlap": 100}), ("tokens", {"most": 200, "overlap": 30}), ("sliding", {"size": 1200, "overlap": 200})):
    add(f"ch_{_mode}_chunks", lambda s, d, m=_mode, o=_options: chunking.chunks(documents(s, d), chunking.chunker(m, **o)))
add("sk2_markdown", lambda s, d: documents(s, d).select("doc_id", sinks.markdown(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.col("n_chars"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text")).alias("value")), "SELECT doc_id, '# Doc ' || doc_id || chr(10) || chr(10) || '- **words**: ' || format('{:,}', n_chars) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- **source**: ' || source || chr(10) ELSE '' END || chr(10) || text AS value FROM documents")
add("sk8_batch_summary", lambda s, d: sinks.batch_summary(documents(s, d).select(F.col("lang").alias("doc_type"), (F.col("n_chars") >= 200).alias("success"))), "SELECT lang AS doc_type, count(*) AS n, count(*) FILTER (n_chars >= 200) AS success FROM documents GROUP BY lang")

# ---- the rest

on_documents(
    "sf6_content_density", "double", lambda: F.round(tx.content_density(T()), 9),
    f"CASE WHEN length(regexp_replace(text, '{SP}+', '', 'g')) = 0 THEN 0.0 ELSE round(least(1.0, list_sum(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')), lambda w: length(w)) || [0]) / CAST(length(regexp_replace(text, '{SP}+', '', 'g')) AS DOUBLE) * CASE WHEN len(regexp_extract_all(text, '[.]{{3,}}')) > 5 THEN 0.3 ELSE 1.0 END), 9) END",
)
on_documents("sf30_compression", "double", lambda: tx.compression_ratio(tx.whitespace_normal(T()), T()), f"CASE WHEN length(text) > 0 THEN round_even(length({strip_sql(f"regexp_replace(text, '{SP}+', ' ', 'g')")}) / CAST(length(text) AS DOUBLE), 2) ELSE 0.0 END")
on_documents("sf35_megabytes", "double", lambda: tx.megabytes(F.col("n_chars") * 100), "round_even(n_chars * 100 / CAST(1048576 AS DOUBLE), 2)")
add("sf37_json_log", lambda s, d: EVENTS(s, d).select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), F.col("event_type").alias("message"))).alias("value")), """SELECT event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","message":"' || event_type || '"}' AS value FROM events""")
add(
    "dm8_merge_by_text", lambda s, d: merge.merge_lists(item_rows(s, d).withColumn("key", tx.item_key(F.col("text"))).withColumn("sources", F.array(F.concat(F.lit("p"), F.col("cited_page").cast("string")))), ["doc_id", "key"], "ord", "sources").select("doc_id", "key", F.array_join("sources", ",").alias("sources")),
    f"WITH {ITEMS_SQL}, k AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS key, cited_page, min(ord) AS ord FROM items GROUP BY ALL) SELECT doc_id, key, string_agg('p' || cited_page, ',' ORDER BY ord) AS sources FROM k GROUP BY doc_id, key",
)
add(
    "dm5_deep_merge", lambda s, d: condense.deep_merged(line_items(s, d).select("doc_id", "ord", F.to_json(F.struct("lang", F.split("text", " ").alias("words"))).alias("value"))),
    f"WITH {LINE_ITEMS_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM items), w AS (SELECT doc_id, lang, ord, n, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM c), f AS (SELECT doc_id, lang, w, min(ord * 1000000 + i) AS place FROM w GROUP BY doc_id, lang, w, CASE WHEN n = 1 THEN i END) SELECT doc_id, '{{\"lang\": ' || to_json(lang) || ', \"words\": [' || string_agg(CAST(to_json(w) AS VARCHAR), ', ' ORDER BY place) || ']}}' AS value FROM f GROUP BY doc_id, lang",
)
add(
    "cl5_classification_pages", lambda s, d: pages.classification_pages(page_rows(s, d), F.round(tx.classification_score(T(), [("the ", 1.5)], []), 6), {"mark": (tx.hits(T(), "license"), 10), "percent": (tx.hits(T(), "%"), 80)}).select("doc_id", "page_no", "must"),
    f"""WITH {PAGES_SQL}, a AS (SELECT *, CASE WHEN {strip_sql('text')} = '' THEN -1.0 ELSE round(len(regexp_extract_all(text, '[0-9]')) * 0.08 + (length(text) - length(replace(text, '%', ''))) * 4.0 + least(length(text), 4000) / CAST(2500 AS DOUBLE) + floor((length(text) - length(replace(lower(text), 'the ', ''))) / 4) * 1.5, 6) END AS score,
  CASE WHEN page_no <= 10 THEN floor((length(text) - length(replace(text, 'license', ''))) / 7) ELSE 0 END AS h1, CASE WHEN page_no <= 80 THEN length(text) - length(replace(text, '%', '')) ELSE 0 END AS h2, count(*) FILTER (page_no <= 40) OVER (PARTITION BY doc_id) AS near FROM pages_d),
  b AS (SELECT *, page_no = 1 OR (h1 > 0 AND row_number() OVER (PARTITION BY doc_id ORDER BY h1 DESC, page_no) = 1) OR (h2 > 0 AND row_number() OVER (PARTITION BY doc_id ORDER BY h2 DESC, page_no) = 1) AS must FROM a WHERE page_no <= CASE WHEN near < 6 THEN 80 ELSE 40 END),
  c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY must DESC, score DESC, page_no DESC) AS place FROM b) SELECT doc_id, page_no, must FROM c WHERE must OR place <= 6""",
)

# ---- condensing: every line of a document begins a table here, and what stands behind a comma a figure


def captioned(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\nTable 2. ")), F.lit(", "), F.lit("\nFig. 7 ")).alias("text"))


CAPTIONED_SQL = "c AS (SELECT doc_id, replace(replace(text, chr(10), chr(10) || 'Table 2. '), ', ', chr(10) || 'Fig. 7 ') AS text FROM documents)"


def matches_sql(name: str, pattern: str) -> str:
    """As the operator has it, on the table c: matches, the pieces between them, and running sums of both."""
    pattern = "(?i)" + pattern.replace(r"\s", SP).replace(f":{SP}]", f":{SP[1:-1]}]")
    return f"""{name} AS (SELECT doc_id, text, k - 1 AS ord, f[k] AS caption, regexp_extract(f[k], '{pattern}', 2) AS number, CAST(list_sum(list_transform(b[1:k], lambda x: length(x))) + list_sum(list_transform(f[1:k], lambda x: length(x))) AS BIGINT) AS e
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS b FROM c), unnest(generate_series(1, len(f))) AS u(k))"""


BODY_END_SQL = "(?s)" + condense.BODY_END.replace(r"\s", SP) + ".*"
CAPTIONS_SQL = f"""{matches_sql('tm', condense.TABLE)}, {matches_sql('fm', condense.FIGURE)},
  caps AS (SELECT doc_id, 'table' AS kind, ord, number, caption, {strip_sql(f"regexp_replace(substring(text, e + 1, 1500), '{BODY_END_SQL}', '')")} AS body FROM tm
  UNION ALL SELECT doc_id, 'figure', ord, number, caption, {strip_sql("string_split(substring(text, e + 1, 200), chr(10))[1]")} FROM fm)"""
add("ch5_captions", lambda s, d: condense.caption_rows(captioned(s, d)), f"WITH {CAPTIONED_SQL}, {CAPTIONS_SQL} SELECT doc_id, kind, CAST(ord AS INTEGER) AS ord, number, caption, body FROM caps")

# budgets a twentieth of the operator's own, so that texts of some thousand characters reach every rule
CONDENSED = {"most": 2500, "header": 400, "caps": (750, 150, 75), "tables": 500, "footer": 250, "room": 250, "reserve": 50}
SECTIONS = [("opening", r"(Table 2\. )?(The|La|Der|El|Die|Le) ", 1), ("list", r"(Table 2\. )?[0-9]", 3), ("aside", r"(Table 2\. )?[A-D]", 2)]
STATS, CONCLUSIONS = ["%", "[0-9]+", "license"], ["the", " de "]
add(
    "ch6_condensed", lambda s, d: condense.condensed(captioned(s, d), SECTIONS, STATS, CONCLUSIONS, **CONDENSED).withColumns({"sections": F.array_join("sections", ","), "ratio": F.round("ratio", 6)}),
    f"""WITH c0 AS (SELECT doc_id, replace(replace(text, chr(10), chr(10) || 'Table 2. '), ', ', chr(10) || 'Fig. 7 ') AS text FROM documents), c AS (SELECT * FROM c0 WHERE length(text) > 2500), {CAPTIONS_SQL},
  l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM c),
  s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, CASE {' '.join(f"WHEN regexp_matches({strip_sql('line')}, '^(?:{p})') THEN {k}" for k, (_, p, _) in enumerate(SECTIONS))} END AS r FROM l),
  m AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY i) - 1, length(text)) AS z FROM s WHERE r IS NOT NULL),
  h AS (SELECT doc_id, i, ['opening', 'list', 'aside'][r + 1] AS name, [1, 3, 2][r + 1] AS p, substring(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS t FROM m),
  tf AS (SELECT doc_id, string_agg(CASE WHEN kind = 'table' THEN '[表格] ' || caption || chr(10) || body WHEN body <> '' THEN '[图注] ' || caption || ' ' || body END, chr(10) || chr(10) ORDER BY kind DESC, ord) AS t, count(*) FILTER (kind = 'table') AS nt, count(*) FILTER (kind = 'figure') AS nf FROM caps GROUP BY doc_id),
  above AS (SELECT doc_id, 0 AS place, 0 AS i, 'header' AS name, substring(text, 1, 400) AS t FROM c
  UNION ALL SELECT doc_id, 1, i, name, CASE p WHEN 1 THEN substring(t, 1, 750) WHEN 3 THEN substring(t, 1, 75) ELSE CASE WHEN length(t) > 300 THEN substring(t, 1, 150) || chr(10) || '...[省略]...' || chr(10) || right(t, 150) ELSE t END END FROM h
  UNION ALL SELECT doc_id, 2, 0, 'tables_figures', substring(t, 1, 500) FROM tf WHERE t <> ''),
  u AS (SELECT doc_id, sum(length(t)) AS used FROM above GROUP BY doc_id HAVING sum(length(t)) < 2250),
  g AS (SELECT doc_id, unnest(string_split_regex(text, '\\n{SP}*\\n')) AS t, generate_subscripts(string_split_regex(text, '\\n{SP}*\\n'), 1) AS i FROM c),
  sc AS (SELECT *, ({' + '.join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN {w} ELSE 0 END" for w, ps in ((2.0, STATS), (1.5, CONCLUSIONS)) for p in ps)} + CASE WHEN len(regexp_extract_all(t, '[0-9]+([.][0-9]+)?')) > 3 THEN 1.0 ELSE 0 END) * CASE WHEN length(t) < 100 THEN 0.5 ELSE 1 END AS score FROM g WHERE length({strip_sql('t')}) > 50),
  rk AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) AS taken, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM sc JOIN u USING (doc_id) WHERE score >= 1),
  im AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY k) AS t FROM rk WHERE taken <= 2500 - used - 50 GROUP BY doc_id),
  parts AS (FROM above UNION ALL SELECT doc_id, 3, 0, 'important', t FROM im UNION ALL SELECT doc_id, 4, 0, 'footer', right(string_split_regex(text, '(?i){condense.REFERENCES.replace(chr(92) + 's', SP)}')[1], 250) FROM c),
  w AS (SELECT doc_id, substring(string_agg('[' || upper(name) || ']' || chr(10) || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place, i), 1, 2500) AS t, coalesce(string_agg(name, ',' ORDER BY i) FILTER (place = 1), '') AS sections FROM parts GROUP BY doc_id)
  SELECT doc_id, coalesce(w.t, c0.text) AS text, coalesce(sections, '') AS sections, CAST(CASE WHEN tf.t <> '' THEN nt ELSE 0 END AS INTEGER) AS tables, CAST(CASE WHEN tf.t <> '' THEN nf ELSE 0 END AS INTEGER) AS figures, CASE WHEN w.t IS NULL THEN 1.0 ELSE round(length(w.t) / CAST(length(c0.text) AS DOUBLE), 6) END AS ratio
  FROM c0 LEFT JOIN w USING (doc_id) LEFT JOIN tf USING (doc_id)""",
)
