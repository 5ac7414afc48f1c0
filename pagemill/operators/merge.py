"""Deduplicating and merging extraction items.

The ordered deduplications are defined as folds: whether an item stays depends on which before it stayed. They are worked out for all
documents at once, in rounds: what has nothing undecided before it stays, what meets one of these goes, and the next round
begins with the rest. The first undecided item of a document is decided in every round, so rounds end; there are as many as the longest chain
of items of which each is spared because the one before it went, two or three in texts as they are. No row ever holds a long document's items;
where a document has few, ``dedup_fuzzy`` folds them inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.storage import Steps

#: Items of a document that is one row of them; a longer one is never in one row.
FEW = 64


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.union(df)
    return out


def dedup_two_keys(items: DataFrame) -> DataFrame:
    """Keeps the first of items with equal text or equal quote; only what is kept counts as seen. Blank texts go.

    A round keeps the items that are the first undecided of their text and of their quote; items that share either with them go.
    Items with the same doc_id and ord stay or go together.
    """
    steps = Steps(items.sparkSession, "two-keys")
    quote = F.lower(tx.strip(F.coalesce("quote", F.lit(""))))
    rows = items.where(F.length(tx.strip(F.col("text"))) > 0).select("doc_id", "ord", tx.item_key(tx.strip(F.col("text"))).alias("_t"), F.when(quote != "", F.md5(quote.cast("binary"))).alias("_q"))
    # of equal rows in both keys only the first can stay
    open_ = steps.save(rows.groupBy("doc_id", "_t", "_q").agg(F.min("ord").alias("ord")))
    kept = []
    while not open_.isEmpty():
        by_text = open_.groupBy("doc_id", "_t").agg(F.min("ord").alias("_first_t"))
        by_quote = open_.where("_q IS NOT NULL").groupBy("doc_id", "_q").agg(F.min("ord").alias("_first_q"))
        ranked = open_.join(by_text, ["doc_id", "_t"]).join(by_quote, ["doc_id", "_q"], "left")
        stay = steps.save(ranked.where("ord = _first_t AND (_q IS NULL OR ord = _first_q)").select("doc_id", "ord", "_t", "_q"))
        left = steps.save(open_.join(stay, ["doc_id", "_t"], "left_anti").join(stay.where("_q IS NOT NULL"), ["doc_id", "_q"], "left_anti"))
        steps.drop(open_)
        kept.append(stay.select("doc_id", "ord"))
        open_ = left
    return items.join(_united(kept), ["doc_id", "ord"], "left_semi") if kept else items.where("false")


def overlapping(sets: DataFrame, share: float) -> DataFrame:
    """(doc_id, early, late): items of a document whose words overlap by more than ``share`` of the smaller set. ``sets``: doc_id, ord, words, of one set a document each.

    The smaller set has at least ``needed`` of its words in the other one, hence one of its rarest size - needed + 1 (rare by the number of the
    document's sets with it). So only these are looked up among all words of sets at least as large, and what is found is verified.
    """
    size = F.size("words")
    words = sets.select("doc_id", "ord", size.alias("_n"), F.explode("words").alias("_word"))
    spread = words.groupBy("doc_id", "_word").agg(F.count(F.lit(1)).alias("_in"))
    ranked = words.join(spread, ["doc_id", "_word"]).groupBy("doc_id", "ord", "_n").agg(F.sort_array(F.collect_list(F.struct("_in", "_word")))["_word"].alias("_rare"))
    needed = F.greatest(F.lit(1), F.floor(F.col("_n") * share).cast("int"))
    few = ranked.select("doc_id", F.col("ord").alias("_small"), F.col("_n").alias("_m"), F.explode(F.slice("_rare", F.lit(1), F.col("_n") - needed + 1)).alias("_word"))
    met = few.join(words, ["doc_id", "_word"]).where((F.col("_m") <= F.col("_n")) & (F.col("_small") != F.col("ord")))
    pairs = met.select("doc_id", F.least("_small", "ord").alias("early"), F.greatest("_small", "ord").alias("late")).distinct()
    of = lambda name: sets.select("doc_id", F.col("ord").alias(name), F.col("words").alias(f"_{name}"))
    both = pairs.join(of("early"), ["doc_id", "early"]).join(of("late"), ["doc_id", "late"])
    return both.where(F.size(F.array_intersect("_early", "_late")) / F.least(F.size("_early"), F.size("_late")) > share).select("doc_id", "early", "late")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def _folded(parts: Column, share: float) -> Column:
    """The ords that stay of a document's items in order, (ord, text) each: the fold itself, for few items."""
    listed = F.transform(parts, lambda p: F.struct(p["ord"].alias("ord"), _words(p["text"]).alias("words")))
    near = lambda v, x: F.size(F.array_intersect(v["words"], x["words"])) / F.least(F.size(v["words"]), F.size(x["words"])) > share
    fold = lambda xs: F.aggregate(xs, F.slice(xs, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda v: near(v, x)), kept).otherwise(F.concat(kept, F.array(x))))
    bound = lambda xs, f: F.transform(F.array(xs), f)[0]  # noqa: E731  evaluated once
    stay = lambda xs: F.concat(F.filter(xs, lambda x: F.size(x["words"]) == 0), bound(F.filter(xs, lambda x: F.size(x["words"]) > 0), fold))
    return bound(listed, stay)["ord"]


def dedup_fuzzy(items: DataFrame, least: int = 10, share: float = 0.6) -> DataFrame:
    """Drops short texts and those whose words overlap too much with a text that was kept, relative to the smaller set. Texts without words stay.

    A document of up to ``FEW`` items is one row of them, in which the fold is worked out: their texts are shuffled once. In longer ones it is rounds, and pairs
    are searched among distinct sets: of items with the same set of words only the first can stay, and it meets what the others meet.
    """
    steps = Steps(items.sparkSession, "fuzzy")
    rows = steps.save(items.where((F.length("text") >= least) & F.col("doc_id").isNotNull() & F.col("ord").isNotNull()).select("doc_id", "ord", "text"))
    many = steps.save(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select("doc_id"))
    few = rows.join(many, "doc_id", "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_parts"))
    kept = few.select("doc_id", F.explode(_folded(F.col("_parts"), share)).alias("ord"))
    if not many.isEmpty():
        kept = kept.union(_kept_in_rounds(rows.join(many, "doc_id", "left_semi"), share, steps))
    return items.join(kept, ["doc_id", "ord"], "left_semi")


def _kept_in_rounds(rows: DataFrame, share: float, steps: Steps) -> DataFrame:
    """(doc_id, ord) of what stays of the items of long documents."""
    rows = steps.save(rows.select("doc_id", "ord", F.sort_array(_words(F.col("text"))).alias("words")))
    filled = rows.where(F.size("words") > 0)
    sets = steps.save(filled.groupBy("doc_id", F.md5(F.array_join("words", " ").cast("binary")).alias("_set")).agg(F.min("ord").alias("ord"), F.first("words").alias("words")).drop("_set"))
    links, gone = steps.save(overlapping(sets, share)), []
    while not links.isEmpty():
        first = links.select(F.col("early").alias("ord"), "doc_id").join(links.select("doc_id", F.col("late").alias("ord")), ["doc_id", "ord"], "left_anti").distinct()
        out = steps.save(links.join(first.withColumnRenamed("ord", "early"), ["doc_id", "early"], "left_semi").select("doc_id", "late").distinct())
        left = steps.save(links.join(out, ["doc_id", "late"], "left_anti").join(out.withColumnRenamed("late", "early"), ["doc_id", "early"], "left_anti"))
        steps.drop(links)
        gone.append(out.withColumnRenamed("late", "ord"))
        links = left
    kept = sets.select("doc_id", "ord")
    if gone:
        kept = kept.join(_united(gone), ["doc_id", "ord"], "left_anti")
    return kept.union(rows.where(F.size("words") == 0).select("doc_id", "ord"))


def dedup_prefix(items: DataFrame, prefix: int = 120, most: int = 25) -> DataFrame:
    """The first item of each beginning, at most ``most`` a document."""
    key = F.substring(tx.strip(F.lower("text")), 1, prefix)
    first = items.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", key).orderBy("ord"))).where("_k = 1").drop("_k")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("_k") <= most).drop("_k")


def first_filled(rows: DataFrame, keys: list[str], order: str, *fields: str) -> DataFrame:
    """Per group and field the first value in order that is filled."""
    return rows.groupBy(*keys).agg(*(F.min_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.col(order))).alias(f) for f in fields))


def overwrite(left: Column, right: Column) -> Column:
    """A map in which the right side wins."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(left), lambda e: ~F.map_contains_key(right, e["key"])), F.map_entries(right)))


def merge_lists(rows: DataFrame, keys: list[str], order: str, field: str) -> DataFrame:
    """The distinct members of the lists of a group in order of appearance."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(field).alias("v"))))
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(parts, lambda p: p["v"]))).alias(field))


def composite_merge(rows: DataFrame, keys: list[str], chunk: str = "chunk") -> DataFrame:
    """Keeps the first chunk's rows as they are; later rows only where their key is new and not blank."""
    key = F.array_join(F.array(*(tx.strip(F.lower(F.coalesce(k, F.lit("")))) for k in keys)), "|")
    rows = rows.withColumn("_key", key)
    group = Window.partitionBy("doc_id", "_key").orderBy(chunk, "ord")
    first = F.min(chunk).over(Window.partitionBy("doc_id"))
    rows = rows.withColumns({"_k": F.row_number().over(group), "_first": first, "_blank": F.regexp_replace("_key", r"\|", "") == ""})
    return rows.where((F.col(chunk) == F.col("_first")) | ((F.col("_k") == 1) & ~F.col("_blank"))).drop("_key", "_k", "_first", "_blank")


def fill_missing(value: Column, other: Column, empty: tuple[str, ...] = ("", "Not Reported")) -> Column:
    return F.when(value.isNull() | value.isin(*empty), other).otherwise(value)


def longer(a: Column, b: Column) -> Column:
    """The second list if it is longer."""
    return F.when(F.coalesce(F.size(b), F.lit(0)) > F.coalesce(F.size(a), F.lit(0)), b).otherwise(a)


def compare_sets(a: Column, b: Column, most: int = 5) -> Column:
    return F.struct(
        F.array_sort(F.array_intersect(a, b)).alias("common"),
        F.slice(F.array_sort(F.array_except(a, b)), 1, most).alias("only_left"),
        F.slice(F.array_sort(F.array_except(b, a)), 1, most).alias("only_right"),
    )


def reduce_notes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Notes as distinct lines in order, sources as a sorted set, the last filled scalar."""
    notes = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("note").alias("v"))))
    distinct = F.array_distinct(F.filter(F.transform(notes, lambda p: p["v"]), lambda v: v.isNotNull() & (v != "")))
    return rows.groupBy(*keys).agg(F.array_join(distinct, "\n").alias("notes"), F.array_sort(F.collect_set("source")).alias("sources"), F.max_by("scalar", F.when(F.col("scalar").isNotNull(), F.col(order))).alias("scalar"))
