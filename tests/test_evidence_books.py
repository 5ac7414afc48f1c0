"""Documents of few pages, which are one row, and of many, which go by an index: the same results, and texts shuffled once."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import evidence
from tests.test_evidence import made

CALLS = {
    "locate": lambda i, p: evidence.locate(i, p, F.col("text")),
    "quote_page": lambda i, p: evidence.quote_page(i, p, 12),
    "locate_by_words": evidence.locate_by_words,
    "verify_by_keywords": evidence.verify_by_keywords,
    "relocate": evidence.relocate,
}


def tables(spark):
    books, rows = made(6)
    pages = spark.createDataFrame([(d, no, t) for d, ps in books.items() for no, t in ps], "doc_id long, page_no int, text string")
    return spark.createDataFrame([(d, o, t, t, c) for d, o, t, c in rows], "doc_id long, ord int, text string, quote string, cited_page int"), pages


@pytest.mark.parametrize("name", CALLS)
def test_few_and_many_pages_agree(spark, monkeypatch, name):
    items, pages = tables(spark)
    found = []
    for few in (0, 5, 64):  # all by the index, both, all as one row
        monkeypatch.setattr(evidence, "FEW", few)
        found.append(sorted(map(str, CALLS[name](items, pages).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


@pytest.mark.parametrize("name", ["locate_by_words", "verify_by_keywords", "relocate"])
def test_no_text_is_sorted_for_an_aggregation(spark, name):
    items, pages = tables(spark)
    plan = CALLS[name](items, pages)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_short_documents_shuffle_no_grams(spark):
    items, pages = tables(spark)
    few, many = evidence.books(pages, F.col("text"))
    rows, _ = evidence.split_items(items.select("doc_id", "ord", F.col("text").alias("_wanted")), many)
    low = F.lower("_wanted")
    found = evidence._locate_in_books(rows.select("doc_id", "ord", "_wanted", low.alias("_start"), F.lit("").alias("_signs")), few, 0.5, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert keys and all(re.fullmatch(r"doc_id#\d+L?", k) for k in keys)
    assert few.count() == pages.select("doc_id").distinct().count() and many.isEmpty()


def test_a_book_is_searched_once_an_item(spark):
    """No filter ahead of the result repeats the search, and with no long document nothing is planned for the index."""
    pages = spark.createDataFrame([(1, k, f"page {k} of a short document with words") for k in range(1, 4)], "doc_id long, page_no int, text string")
    items = spark.createDataFrame([(1, 0, "of a short document with"), (1, 1, "nothing of this stands there")], "doc_id long, ord int, text string")
    found = evidence.locate(items, pages, F.col("text"))
    assert [(r.ord, r.page_no) for r in found.collect()] == [(0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "Join" in plan
    assert not any("array_intersect" in line or "Contains" in line for line in plan.splitlines() if "Join " in line or "Filter " in line)
