"""The n-gram index against a plain search over all pages of a document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import evidence

CJK = re.compile("[一-鿿]")


def grams(text, n=3):
    low = text.lower()
    words, signs = re.findall("[a-zA-Z]+|[0-9]+", low), CJK.findall(low)
    of = lambda xs, sep, short: {sep.join(xs[i : i + n]) for i in range(len(xs) - n + 1)} if len(xs) >= n else short
    return of(words, " ", set(words)) | of(signs, "", {"".join(signs)} - {""})


def plain(text, pages, prefix=60, least=10, per_page=2500, threshold=0.5):
    """(page, confidence) or None, page by page."""
    if text is None or len(text) < least:
        return None
    low = text.lower().strip()
    signs = "".join(CJK.findall(low))
    book = [(no, page[:per_page].lower()) for no, page in sorted(pages)]
    for no, page in book:
        if low[:prefix] in page:
            return no, 1.0
    for no, page in book:
        if len(signs) >= 8 and signs[:20] in "".join(CJK.findall(page)):
            return no, 0.95
    own = grams(text)
    best = max(((len(own & grams(page)) / len(own), -no) for no, page in book), default=(0, 0)) if own else (0, 0)
    return (-best[1], best[0]) if best[0] >= threshold else None


def made(seed):
    rng = random.Random(seed)
    words = ["the", "of", "a", "An", "x1", "12", "cells", "Trial", "患者应当", "接受标准治疗方案", "—", "é", "cell"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "", "\n"]) for _ in range(n))
    books = {d: [(k + 1, "All rights reserved by the owner. " * rng.randrange(2) + text(rng.randrange(1, 40))) for k in range(rng.randrange(1, 12))] for d in range(12)}
    items = []
    for d, pages in books.items():
        for o in range(25):
            _, page = rng.choice(pages)
            at = rng.randrange(len(page))
            span = page[at : at + rng.randrange(5, 120)]
            kind = rng.randrange(5)
            items.append((d, o, [span, span.replace("the", "cell"), span + text(5), text(8), "All rights reserved by the owner. " + text(2)][kind], rng.randrange(1, 4)))
    items += [(0, 100, None, 1), (0, 101, "", 1), (0, 102, " " * 20, 1), (77, 0, "a document without any page", 1), (None, 1, "no document at all here", 1)]
    return books, items


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"prefix": 20, "threshold": 0.3, "per_page": 60}), (3, {"prefix": 6, "threshold": 0.8}), (4, {"prefix": 50, "least": 15, "per_page": None, "threshold": 0.3})])
def test_locate_equals_a_search_of_all_pages(spark, seed, options):
    books, rows = made(seed)
    pages = spark.createDataFrame([(d, no, t) for d, ps in books.items() for no, t in ps], "doc_id long, page_no int, text string").repartition(3)
    items = spark.createDataFrame(rows, "doc_id long, ord int, text string, cited_page int").repartition(3)
    got = {(r.doc_id, r.ord): (r.page_no, round(r.confidence, 9)) for r in evidence.locate(items, pages, F.col("text"), **options).collect()}
    want = {}
    for d, o, text, _ in rows:
        found = plain(text, books.get(d, []), **{**{"per_page": 2500}, **options, **({"per_page": 10**6} if options.get("per_page", 1) is None else {})})
        if found:
            want[d, o] = (found[0], round(found[1], 9))
    assert got == want and len(got) > 100 and {c for _, c in got.values()} > {1.0}


def test_first_page_and_words(spark):
    books, rows = made(5)
    pages = spark.createDataFrame([(d, no, t) for d, ps in books.items() for no, t in ps], "doc_id long, page_no int, text string")
    items = spark.createDataFrame([(d, o, t, t, c) for d, o, t, c in rows if d is not None], "doc_id long, ord int, text string, quote string, cited_page int")
    got = {(r.doc_id, r.ord): r.page_no for r in evidence.quote_page(items, pages, 12).collect()}
    assert got == {(d, o): next((no for no, p in books.get(d, []) if t is not None and t.lower()[:12] in p.lower()), -1) for d, o, t, _ in rows if d is not None}
    checked = {(r.doc_id, r.ord): (r.page_no, r.status) for r in evidence.verify_by_keywords(items, pages).collect()}
    for d, o, t, cited in rows:
        if d is None or t is None or d not in books:
            continue
        words = [w for w in re.findall("[一-鿿]+|[a-z]{3,}|[0-9]+(?:\\.[0-9]+)?%?", t.lower()) if len(w) > 2][:15]
        share = {no: sum(w in p.lower() for w in words) / len(words) if words else 0.0 for no, p in books[d]}
        best = max((s, -no) for no, s in share.items())
        moved = share.get(cited, 0.0) < 0.3 <= best[0]
        assert checked[d, o] == ((-best[1], "fixed") if moved else (cited, "verified"))


def test_pages_without_a_shared_gram_meet_no_item(spark):
    pages = spark.createDataFrame([(1, k, f"page {k} speaks of thing{k} and nothing{k} else{k}") for k in range(300)], "doc_id long, page_no int, text string")
    items = spark.createDataFrame([(1, k, f"speaks of thing{k} and nothing{k} else{k}") for k in range(300)], "doc_id long, ord int, text string")
    found = evidence.locate(items, pages, F.col("text"))
    assert found.count() == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [k for k in re.findall(r"Join \[([^\]]*)\]", plan)]
    assert any("_gram" in k for k in keys) and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    book, index = evidence.page_index(pages)
    wanted = items.select("doc_id", "ord", F.lit(evidence.START).alias("_kind"), F.lower("text").alias("_needle")).withColumn("_gram", evidence.probe(F.col("_needle")))
    assert wanted.where("_gram IS NULL").count() == 0
    assert wanted.join(index, ["doc_id", "_gram"]).count() < 2 * 300
