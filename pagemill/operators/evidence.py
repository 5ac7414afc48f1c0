"""Evidence: which page a quotation stands on, and what becomes of an item's citation.

Items have doc_id, ord (the two are an item's key), text, quote and cited_page. A document of up to ``FEW`` pages is one row of them, which its items
meet once, on doc_id: texts are shuffled once, and the pages are searched inside the row. In longer documents an item meets a page only where an
index of n-grams says so: the join is on (doc_id, gram), so neither a long document nor one with many items is a cross product.

- A page that holds the beginning of a text holds every n-gram of words inside that beginning, whose first and last word may be cut.
  One of them, the middle one, leads to the pages that are searched. Beginnings with too few words for one are searched on all pages.
- Of m n-grams a page must hold at least ``threshold`` m. Items with fewer in all of the document are out by that count; of the
  others, a page with enough holds one of the rarest ``present - needed + 1``, so only pages with one of these are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.storage import Steps

ITEM = ["doc_id", "ord"]
PHRASE, START = 2, 3
#: Above any page number: a rank and a page in one long, since a maximum of longs is a hash aggregation and one of structs a sort.
STEP = 1 << 32
#: Pages of a document that is one row of them; a longer one is never in one row.
FEW = 128


def best_page(rank: Column, page: str = "page_no") -> Column:
    """The maximum of this is that of the highest rank, and of these the earliest page; ``rank_of`` and ``page_of`` take it apart."""
    return F.max(rank.cast("long") * STEP - F.col(page))


def rank_of(best: Column) -> Column:
    return F.floor((best + STEP - 1) / STEP)


def page_of(best: Column) -> Column:
    return (rank_of(best) * STEP - best).cast("int")


def books(pages: DataFrame, page: Column) -> tuple[DataFrame, DataFrame]:
    """Documents of up to FEW pages, a row each with their pages in lower case as ``_book``; and the pages of the others, written once: the index has
    many branches, each of which would read and cut all texts to find them."""
    rows = pages.select("doc_id", "page_no", page.alias("text")).withColumn("_count", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    few = rows.where(F.col("_count") <= FEW).groupBy("doc_id").agg(F.collect_list(F.struct("page_no", F.lower("text").alias("_page"))).alias("_book"))
    return few, Steps(pages.sparkSession, "pages").save(rows.where(F.col("_count") > FEW).drop("_count"))


def split_items(items: DataFrame, many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items dealt out by document, and those of them whose document is among ``many``, written once too. What is worked out of a text comes behind the shuffle."""
    rows = items.repartition("doc_id")
    if many.isEmpty():  # nothing is planned for them
        return rows, items.limit(0)
    return rows, Steps(items.sparkSession, "items").save(items.join(many.select("doc_id").distinct(), "doc_id", "left_semi"))


def first_in_book(holds) -> Column:
    """The first page of ``_book`` for which ``holds`` is true, or null."""
    return F.array_min(F.transform(F.filter("_book", holds), lambda p: p["page_no"]))


def best_in_book(rank) -> Column:
    """As ``best_page``, over the pages of ``_book``; a rank that is null does not count."""
    return F.aggregate("_book", F.lit(-(1 << 62)), lambda best, p: F.greatest(best, rank(p).cast("long") * STEP - p["page_no"]))


def worked_out(rows: DataFrame, *columns: Column, kept: Sequence[str] = ITEM) -> DataFrame:
    """``kept`` and these columns as fields of what a generator makes. A condition on a projection is put ahead of it, below joins too, with all that
    the projection works out in it once more, and there for rows that the join leaves out; one on a generator's fields stays behind it."""
    return rows.select(*kept, F.explode_outer(F.array(F.struct(*columns))).alias("_made")).select(*kept, "_made.*")  # of no rows Spark plans an exploded array away


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, when it is asked for."""
    return F.transform(F.array(value), use)[0]


def candidates(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items beside the pages of their document, which are lower-cased once, before they meet."""
    return items.join(pages.select("doc_id", "page_no", F.lower("text").alias("_page")), "doc_id")


def _cjk(t: Column) -> Column:
    # each of these characters has three bytes, so most texts in Latin letters need not be searched
    return F.when(F.octet_length(t) - F.length(t) < 2, F.substring(t, 1, 0)).otherwise(F.regexp_replace(t, f"[^{tx.CJK[1:-1]}]+", ""))


def gram_digests(t: Column, n: int = 3) -> Column:
    """The set of ``text.ngrams`` as digests: of n words in a row, or of single words where there are fewer, and of n CJK characters, or of all where there are fewer."""
    return grams_of(F.lower(t), n)


def grams_of(low: Column, n: int = 3) -> Column:
    """``gram_digests`` of a text in lower case."""
    words = F.transform(F.regexp_extract_all(low, F.lit("[a-z]+|[0-9]+"), 0), lambda w: F.xxhash64(w))
    rows = lambda xs: F.transform(xs, lambda x, i: F.xxhash64(x, *[F.get(xs, i + k) for k in range(1, n)]))
    latin = lambda xs: F.when(F.size(xs) >= n, F.slice(rows(xs), F.lit(1), F.greatest(F.size(xs) - n + 1, F.lit(0)))).otherwise(xs)
    signs = lambda s: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.substr(s, i, F.lit(n))))).when(F.length(s) > 0, F.array(F.xxhash64(s))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(bound(words, latin), bound(_cjk(low), signs)))


def page_index(pages: DataFrame, cap: int | None = None, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pages in lower case with the digests of their n-grams, and a row per page and gram."""
    page = F.lower(F.col("text") if cap is None else F.substring("text", 1, cap))
    book = pages.select("doc_id", "page_no", page.alias("_page")).select("*", gram_digests(F.col("_page"), n).alias("_of_page"))
    return book, book.select("doc_id", "page_no", F.explode("_of_page").alias("_gram"))


def probe(start: Column, n: int = 3) -> Column:
    """The digest of an n-gram that every page with ``start`` (in lower case) has; null if it has none inside."""
    inside = F.regexp_extract_all(F.regexp_replace(start, "^([a-z]+|[0-9]+)|([a-z]+|[0-9]+)$", ""), F.lit("[a-z]+|[0-9]+"), 0)
    signs = _cjk(start)
    middle = lambda xs: F.when(F.size(xs) >= n, F.xxhash64(*[F.xxhash64(F.get(xs, F.floor((F.size(xs) - n) / 2).cast("int") + i)) for i in range(n)]))
    return F.coalesce(F.transform(F.array(inside), middle)[0], F.when(F.length(signs) >= n, F.xxhash64(F.substring(signs, 1, n))))


def pages_with(wanted: DataFrame, book: DataFrame, index: DataFrame) -> DataFrame:
    """(kind, page_no) pairs per item: pages that hold ``_needle``; of kind PHRASE, whose CJK characters do. ``wanted``: ITEM, _kind, _needle, _gram."""
    text = book.select("doc_id", "page_no", "_page")
    led = wanted.where(F.col("_gram").isNotNull()).join(index, ["doc_id", "_gram"]).select(*ITEM, "_kind", "_needle", "page_no").join(text, ["doc_id", "page_no"])
    blind = wanted.where(F.col("_gram").isNull()).join(text, "doc_id")
    holds = F.when(F.col("_kind") == PHRASE, F.contains(_cjk(F.col("_page")), F.col("_needle"))).otherwise(F.contains("_page", F.col("_needle")))
    return led.where(holds).select(*ITEM, "_kind", "page_no").union(blind.where(holds).select(*ITEM, "_kind", "page_no"))


def first_page(items: DataFrame, pages: DataFrame, start: Column) -> DataFrame:
    """The first page that holds ``start`` (in lower case), for the items that have one."""
    few, many = books(pages, F.col("text"))
    rows, others = split_items(items.select(*ITEM, start.alias("_needle")), many)
    found = rows.join(few, "doc_id").select(*ITEM, first_in_book(lambda p: F.contains(p["_page"], F.col("_needle"))).alias("page_no"))
    wanted = worked_out(others, F.lit(START).alias("_kind"), F.col("_needle"), probe(F.col("_needle")).alias("_gram"))
    return found.union(pages_with(wanted, *page_index(many)).select(*ITEM, "page_no")).groupBy(*ITEM).agg(F.min("page_no").alias("page_no")).where("page_no IS NOT NULL")


def most_shared(wanted: DataFrame, book: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """The earliest page with the largest share of an item's n-grams, and the share, if it is enough. ``wanted``: ITEM, _grams."""
    size = F.size("_grams")
    rows = wanted.where(F.col("_grams").isNotNull() & (size > 0))  # as the explode below has it, so that both ways share what is before
    spread = index.groupBy("doc_id", "_gram").agg(F.count(F.lit(1)).alias("_n"), F.min("page_no").alias("_first"))
    known = rows.select(*ITEM, size.alias("_m"), F.explode("_grams").alias("_gram")).join(spread, ["doc_id", "_gram"])
    by_item = known.groupBy(*ITEM, "_m").agg(F.sort_array(F.collect_list(F.struct("_n", "_first", "_gram"))).alias("_known"))
    needed = F.greatest(F.lit(1), F.floor(F.col("_m") * threshold - 1e-9).cast("int"))  # not more than are needed
    probes = by_item.where(F.size("_known") >= needed).select(*ITEM, F.explode(F.slice("_known", F.lit(1), F.size("_known") - needed + 1)["_gram"]).alias("_gram"))
    met = probes.join(index, ["doc_id", "_gram"]).select(*ITEM, "page_no").distinct()
    both = met.join(rows.select(*ITEM, "_grams"), ITEM).join(book.select("doc_id", "page_no", "_of_page"), ["doc_id", "page_no"])
    best = both.groupBy(*ITEM).agg(best_page(F.size(F.array_intersect("_grams", "_of_page"))).alias("_b"), F.first(size).alias("_m"))
    share = rank_of(F.col("_b")) / F.col("_m")
    return best.where(share >= threshold).select(*ITEM, page_of(F.col("_b")).alias("page_no"), share.alias("confidence"))


def locate(items: DataFrame, pages: DataFrame, wanted: Column, prefix: int = 60, least: int = 10, per_page: int | None = 2500, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """page_no and confidence per item: the earliest page with the beginning of the text, else with its
    CJK characters, else the earliest page with the largest share of its n-grams, if that is enough."""
    few, many = books(pages, F.col("text") if per_page is None else F.substring("text", 1, per_page))
    rows, others = split_items(items.where(F.length(wanted) >= least).select(*ITEM, wanted.alias("_wanted")), many)
    low = tx.strip(F.lower("_wanted"))
    texts = [F.substring(low, 1, prefix).alias("_start"), _cjk(low).alias("_signs")]
    return _locate_in_books(rows.select(*ITEM, "_wanted", *texts), few, threshold, n).union(_locate_by_index(worked_out(others, *texts, gram_digests(F.col("_wanted"), n).alias("_grams")), many, threshold, n))


def _locate_in_books(prepared: DataFrame, few: DataFrame, threshold: float, n: int) -> DataFrame:
    page = lambda p: F.struct(p["page_no"].alias("page_no"), p["_page"].alias("_page"), _cjk(p["_page"]).alias("_signs"), grams_of(p["_page"], n).alias("_grams"))
    both = prepared.join(few.select("doc_id", F.transform("_book", page).alias("_book")), "doc_id")
    # one expression, since each projection copies the book for every item; only what is not settled goes on to the next step
    needle = F.when(F.length("_signs") >= 8, F.substring("_signs", 1, 20))
    result = lambda page_no, confidence: F.struct(page_no.cast("int").alias("page_no"), confidence.cast("double").alias("confidence"))
    exact = first_in_book(lambda p: F.contains(p["_page"], F.col("_start")))
    signs = F.when(needle.isNotNull(), first_in_book(lambda p: F.contains(p["_signs"], needle)))
    # the smaller set is the one that is hashed
    most = lambda own: best_in_book(lambda p: F.size(F.array_intersect(p["_grams"], own)))
    enough = lambda best, share: F.when((share > 0) & (share >= threshold), result(page_of(best), share))
    shared = bound(gram_digests(F.col("_wanted"), n), lambda own: F.when(F.size(own) > 0, bound(most(own), lambda best: enough(best, rank_of(best) / F.size(own)))))
    found = bound(exact, lambda at: F.when(at.isNotNull(), result(at, F.lit(1.0))).otherwise(bound(signs, lambda by: F.when(by.isNotNull(), result(by, F.lit(0.95))).otherwise(shared))))
    return both.select(*ITEM, F.inline_outer(F.array(found))).where("page_no IS NOT NULL")


def _locate_by_index(prepared: DataFrame, pages: DataFrame, threshold: float, n: int) -> DataFrame:
    book, index = page_index(pages, None, n)
    needle = lambda kind, text: F.struct(F.lit(kind).alias("_kind"), text.alias("_needle"), probe(text, n).alias("_gram"))
    needles = F.array(needle(START, F.col("_start")), needle(PHRASE, F.when(F.length("_signs") >= 8, F.substring("_signs", 1, 20))))
    exact = pages_with(prepared.select(*ITEM, F.explode(needles).alias("_made")).select(*ITEM, "_made.*").where("_needle IS NOT NULL"), book, index).groupBy(*ITEM).agg(best_page(F.col("_kind")).alias("_b"))
    # an outer join in place of an anti join needs the same columns of ``exact`` as ``found``, which therefore is worked out once
    rest = prepared.select(*ITEM, "_grams").join(exact, ITEM, "left").where("_b IS NULL")
    found = exact.select(*ITEM, page_of(F.col("_b")).alias("page_no"), F.when(rank_of(F.col("_b")) == START, 1.0).otherwise(0.95).alias("confidence"))
    return found.union(most_shared(rest, book, index, threshold))


def verify(items: DataFrame, located: DataFrame) -> DataFrame:
    """verified, fixed or removed, and the sources that result."""
    rows = items.join(located, ITEM, "left")
    status = F.when(F.col("page_no").isNull(), "removed").when(F.col("page_no") == F.col("cited_page"), "verified").otherwise("fixed")
    source = F.when(F.col("page_no").isNotNull(), F.concat(F.lit("p"), F.col("page_no").cast("string")))
    return rows.select(*items.columns, "page_no", "confidence", status.alias("status"), source.alias("source"))


def verification_stats(verified: DataFrame, *keys: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return verified.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count("verified"), count("fixed"), count("removed"))


def _held(words: str, page: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(page, w)))


def _best_beside(items: DataFrame, pages: DataFrame, words: str, *kept: str) -> DataFrame:
    """``best_page`` by the words that a page holds, of items that meet every page of their document; texts end at the join, ahead of the aggregation."""
    met = candidates(items, pages).select(*ITEM, *kept, F.size(words).alias("_size"), "page_no", _held(words, F.col("_page")).alias("_rank"))
    return met.groupBy(*ITEM, *kept).agg(best_page(F.col("_rank")).alias("_b"), F.max("_size").alias("_size"))


def locate_by_words(items: DataFrame, pages: DataFrame, prefix: int = 40, words: int = 8, least: int = 3, share: float = 0.5) -> DataFrame:
    """The earliest page with the beginning of the quotation, else the page with the most of its first longer words."""
    few, many = books(pages, F.col("text"))
    rows, others = split_items(items.select(*ITEM, "quote"), many)
    low = tx.strip(F.lower("quote"))
    texts = [F.substring(low, 1, prefix).alias("_start"), F.slice(F.regexp_extract_all(low, F.lit(r"[a-z]{4,}"), 0), 1, words).alias("_words")]

    both = rows.select(*ITEM, *texts).join(few, "doc_id")
    exact = both.withColumn("_at", F.when(F.length("_start") > 0, first_in_book(lambda p: F.contains(p["_page"], F.col("_start")))))
    best = F.when(F.col("_at").isNull() & (F.size("_words") >= least), best_in_book(lambda p: _held("_words", p["_page"])))
    found = exact.select(*ITEM, "_at", F.size("_words").alias("_size"), best.alias("_b")).select(*ITEM, F.coalesce("_at", F.when(rank_of(F.col("_b")) / F.col("_size") >= share, page_of(F.col("_b")))).alias("page_no"))

    prepared = others.select(*ITEM, *texts)
    wanted = prepared.where(F.length("_start") > 0).select(*ITEM, F.lit(START).alias("_kind"), F.col("_start").alias("_needle")).withColumn("_gram", probe(F.col("_needle")))
    first = pages_with(wanted, *page_index(many)).groupBy(*ITEM).agg(F.min("page_no").alias("page_no"))
    # words count inside of others too, so no index of words can say where they are; only what is not settled meets the pages
    rest = _best_beside(prepared.where(F.size("_words") >= least).join(first, ITEM, "left_anti"), many, "_words")
    more = rest.where(rank_of(F.col("_b")) / F.col("_size") >= share).select(*ITEM, page_of(F.col("_b")).alias("page_no"))
    return found.where("page_no IS NOT NULL").union(first.select(*ITEM, "page_no")).union(more)


def on_cited_page(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with their cited page in lower case, null if there is none."""
    return items.join(pages.select("doc_id", F.col("page_no").alias("cited_page"), F.lower("text").alias("_page")), ["doc_id", "cited_page"], "left")


def verify_by_keywords(items: DataFrame, pages: DataFrame, n: int = 15, share: float = 0.3) -> DataFrame:
    """Checks the cited page by keywords and looks for a better one; what cannot be fixed stays as it is. Items of documents without pages are left out."""
    few, many = books(pages, F.col("text"))
    rows, others = split_items(items.select(*ITEM, "cited_page", "text"), many)
    words = tx.keywords(F.col("text"), n).alias("_words")
    part = lambda held, size: F.when(size > 0, held / size).otherwise(0.0)

    def settled(found: DataFrame) -> DataFrame:
        """found: _found, _size and, where it is false, _b."""
        moved = ~F.col("_found") & (part(rank_of(F.col("_b")), F.col("_size")) >= share)
        return found.select(*ITEM, F.when(moved, page_of(F.col("_b"))).otherwise(F.col("cited_page")).alias("page_no"), F.when(moved, "fixed").otherwise("verified").alias("status"))

    hit = lambda page: part(_held("_words", page), F.size("_words")) >= share
    both = rows.select(*ITEM, "cited_page", words).join(few, "doc_id").withColumn("_found", F.lit(share <= 0) | F.exists("_book", lambda p: (p["page_no"] == F.col("cited_page")) & hit(p["_page"])))
    near = both.select(*ITEM, "cited_page", F.coalesce("_found", F.lit(False)).alias("_found"), F.size("_words").alias("_size"), F.when(~F.coalesce("_found", F.lit(False)), best_in_book(lambda p: _held("_words", p["_page"]))).alias("_b"))

    own = on_cited_page(others.select(*ITEM, "cited_page", words), many).withColumn("_found", F.lit(share <= 0) | F.coalesce(hit(F.col("_page")), F.lit(False))).drop("_page")
    kept = own.where("_found").select(*ITEM, "cited_page", "_found", F.size("_words").alias("_size"), F.lit(None).cast("long").alias("_b"))
    # only what is not on its page meets the others
    far = _best_beside(own.where(~F.col("_found")), many, "_words", "cited_page").select(*ITEM, "cited_page", F.lit(False).alias("_found"), "_size", "_b")
    return settled(near.union(kept).union(far))


def relocate(items: DataFrame, pages: DataFrame, near: int = 10, far: int = 15, share: float = 0.25) -> DataFrame:
    """Keeps a citation with enough of the text's first longer words, else moves it to the page with the most."""
    few, many = books(pages, F.col("text"))
    rows, others = split_items(items.select(*ITEM, "cited_page", "text"), many)
    long = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) > 3)
    words = lambda df: df.select(*ITEM, "cited_page", F.slice(long, 1, near).alias("_near"), F.slice(long, 1, far).alias("_far"))
    least = F.greatest(F.lit(2.0), F.size("_near") * share)

    both = words(rows).join(few, "doc_id").withColumn("_own", F.coalesce(F.exists("_book", lambda p: (p["page_no"] == F.col("cited_page")) & (_held("_near", p["_page"]) >= least)), F.lit(False)))
    here = both.select(*ITEM, "cited_page", "_own", F.size("_far").alias("_size"), F.when(~F.col("_own"), best_in_book(lambda p: _held("_far", p["_page"]))).alias("_b"))

    own = on_cited_page(words(others), many).withColumn("_own", F.coalesce(_held("_near", F.col("_page")), F.lit(0)) >= least).drop("_page")
    kept = own.where("_own").select(*ITEM, "cited_page", "_own", F.size("_far").alias("_size"), F.lit(None).cast("long").alias("_b"))
    there = _best_beside(own.where(~F.col("_own")), many, "_far", "cited_page").select(*ITEM, "cited_page", F.lit(False).alias("_own"), "_size", "_b")
    moved = ~F.col("_own") & (rank_of(F.col("_b")) >= F.greatest(F.lit(3.0), F.col("_size") * share))
    found = here.union(kept).union(there).withColumn("_moved", F.coalesce(moved, F.lit(False)))
    return found.select(*ITEM, F.when(F.col("_moved"), page_of(F.col("_b"))).otherwise(F.col("cited_page")).alias("page_no"), F.col("_own").alias("verified"), F.col("_moved").alias("moved"))


def quote_on_cited_page(items: DataFrame, pages: DataFrame, head: int = 50, prefix: int = 30) -> DataFrame:
    start = F.substring(F.substring(F.lower("quote"), 1, head), 1, prefix)
    rows = items.join(pages.select("doc_id", F.col("page_no").alias("cited_page"), F.col("text").alias("_page")), ["doc_id", "cited_page"], "left")
    return rows.select(*ITEM, F.coalesce(F.contains(F.lower("_page"), start), F.lit(False)).alias("found"))


def quote_page(items: DataFrame, pages: DataFrame, prefix: int = 40) -> DataFrame:
    """The first page with the beginning of the quotation, or -1."""
    first = first_page(items, pages, F.substring(F.lower("quote"), 1, prefix))
    return items.select(*ITEM).join(first, ITEM, "left").select(*ITEM, F.coalesce("page_no", F.lit(-1)).alias("page_no"))


def size_conflict(population: Column, groups: Column, share: float = 0.05) -> Column:
    """A warning where the sizes of at most three groups add up to something else than the population."""
    sizes = F.slice(F.transform(F.regexp_extract_all(groups, F.lit(r"[0-9]{2,6}"), 0), lambda x: x.cast("int")), 1, 3)
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    n = tx.first_number(population)
    return F.when((n > 0) & (total > 0) & (F.abs(total - n) / n > share), F.struct(n.alias("population_n"), total.alias("groups_n_sum")))
