"""Whole flows on small cases whose outcome is worked out by hand, refusals and missing answers among them."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagemill.operators import chunking, condense, evaluation, flows, generate

# workers cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Says:
    """Replies by the first of its keys that the prompt holds; refuses a prompt with ``poison``."""

    def __init__(self, replies, poison=None):
        self.replies, self.poison = replies, poison

    def reply(self, prompt, max_tokens):
        if self.poison and self.poison in prompt:
            raise ValueError("refused")
        return next((r for k, r in self.replies.items() if k in prompt), "no answer")


def pages(spark, *texts, doc_id=1):
    return spark.createDataFrame([(doc_id, k, len(texts), t) for k, t in enumerate(texts, 1)], "doc_id long, page_no int, total_pages int, text string")


TYPES = "doc_id long, doc_type string"


def test_null_prompts_are_not_asked(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = generate.generate(rows, F.col("text"), generate.Echo("> "), 5).orderBy("doc_id").collect()
    assert [(r.reply, r.error, r.tokens) for r in got] == [("> a", None, 3), (None, None, 0)]


def test_map_reduce_fails_with_a_part(spark):
    chunks = spark.createDataFrame([(1, 0, "fine"), (1, 1, "bad"), (2, 0, "good")], "doc_id long, chunk int, text string")
    got = {r.doc_id: (r.reply, r.error) for r in generate.map_reduce(chunks, generate.Echo(poison="bad"), "{text}", "{text}", 100).collect()}
    assert got == {1: (None, "1 parts failed"), 2: ("[部分 1] good", None)}


def test_direct_summary(spark):
    body = "x" * 100 + " 3月4日 "
    docs = spark.createDataFrame([(1, body), (2, body + "odd"), (3, " short "), (4, None), (5, body + "poison")], "doc_id long, text string")
    dated = json.dumps({"summary": "seen 3月4日 and  截至2024年5月6日，all", "key_points": ["k"]}, ensure_ascii=False)
    rows = flows.direct_summary(docs, Says({"odd": "plain words", "x": dated}, "poison"), "{length}: {text}", "short").orderBy("doc_id").collect()
    got = [(r.summary, r.key_points, r.error) for r in rows]
    assert got[:2] == [("seen 3月4日 and all", ["k"], None), ("plain words", [], None)]
    assert got[2:4] == [(None, None, flows.TOO_SHORT)] * 2
    assert got[4][:2] == (flows.FAILED, []) and "refused" in got[4][2]


def test_windows_are_merged_in_order(spark):
    book = pages(spark, *(f"license {k}" for k in range(1, 31)))
    types = spark.createDataFrame([(1, "GUIDELINE")], TYPES)
    row = flows.windowed_extraction(book, types, flows.Lister("license"), {"GUIDELINE": "{page_range}\n{text}", "OTHER": "-"}, 25, 3).first()
    assert [i["sources"] for i in json.loads(row.value)["items"]] == [[f"p{k}"] for k in range(1, 31)] and row.parts == 2


def test_failed_windows_are_left_out(spark):
    book = pages(spark, "license a", "poison", "license b").union(pages(spark, "poison", doc_id=2))
    types = spark.createDataFrame([], TYPES)
    lister = Says({"license a": '{"items": ["a"]}', "license b": '{"items": ["b"]}'}, "poison")
    rows = {r.doc_id: r for r in flows.windowed_extraction(book, types, lister, {"OTHER": "{text}"}, 1, 0).collect()}
    assert (json.loads(rows[1].value), rows[1].parts, rows[1].failed, rows[1].error) == ({"items": ["a", "b"]}, 2, 1, None)
    assert rows[2].value is None and "refused" in rows[2].error


@pytest.mark.parametrize(
    "reply,total,want",
    [
        ('{"key_pages": [9, 40, 5]}', 12, [1, 2, 3, 5, 9, 11, 12]),
        ('{"doc_title": "t"}', 3, [1, 2, 3]),
        ("nothing", 20, [*range(1, 11), 18, 19, 20]),
        (None, 2, [1, 2]),
        (json.dumps({"key_pages": [*range(1, 60)]}), 60, [*range(1, 31)]),
    ],
)
def test_key_pages(spark, reply, total, want):
    row = spark.createDataFrame([(reply, total)], "reply string, total int").select(flows.key_pages(F.col("reply"), F.col("total")).alias("p")).first()
    assert row.p == want


def test_scan_decides_what_is_read(spark):
    book = pages(spark, *(f"license {k} " + "w" * 100 for k in range(1, 21)))
    types = spark.createDataFrame([], TYPES)
    row = flows.scan_then_extract(book, types, Says({"p7: license": '{"key_pages": [7]}'}), flows.Lister("license"), {"OTHER": "{text}"}, {"OTHER": "{text}"}).first()
    assert [i["sources"][0] for i in json.loads(row.value)["items"]] == ["p1", "p2", "p3", "p7", "p19", "p20"]


def test_three_stages(spark):
    book = pages(spark, "one license", "two", "three").union(pages(spark, "odd", doc_id=2))
    first = Says({"license": '{"type": "RCT", "metadata": {"year": "2020"}}'})
    got = {r.doc_id: r for r in flows.three_stages(book, first, flows.Lister("license", "found"), generate.Echo('{"all": true} '), {"classify": "{text}", "merge": "{metadata}"}, {"RCT": "{page_no} {text}", "OTHER": "-"}).collect()}
    assert (got[1].doc_type, got[1].calls, json.loads(got[1].value), got[1].error) == ("RCT", 5, {"all": True}, None)
    assert (got[2].doc_type, got[2].calls, got[2].value, got[2].error) == (None, 1, None, "stage 1 failed")


def test_routed_extraction_reads_the_whole_text(spark):
    text = "\n".join(f"line {k} license" for k in range(200))
    docs = spark.createDataFrame([(1, text), (2, "license"), (3, None), (4, "")], "doc_id long, text string")
    kinds = spark.createDataFrame([(1, "RCT", '{"type":"RCT"}')], "doc_id long, doc_type string, upstream string")
    rows = {r.doc_id: r for r in flows.routed_extraction(docs, kinds, flows.Lister("license"), {"RCT": "{text}", "OTHER": "{text}"}, 1000, 100).collect()}
    told = {i["text"] for i in json.loads(rows[1].value)["items"]}
    assert set(text.split("\n")) <= told and rows[1].parts == len([*chunking.sliding(text, 1000, 100, flows.CHUNK_SEPARATORS)])
    assert sorted(rows) == [1, 2]


def test_overlay():
    unified = {"doc_metadata": {"title": "t", "year": "1"}, "recommendations": [1, 2], "key_findings": [1]}
    parts = {"metadata": {"year": "2"}, "recommendations": [3], "findings": [4, 5], "conclusions": {"main": "m"}}
    assert flows.overlay(unified, parts, True) == {"doc_metadata": {"title": "t", "year": "2"}, "recommendations": [1, 2], "key_findings": [1], "conclusions": {"main": "m"}}
    assert flows.overlay(unified, parts, False)["key_findings"] == [4, 5]


def test_deep_merge_keeps_the_order_of_appearance():
    assert condense.deep_merge({"l": [1, {"a": 1}], "s": "N/A"}, {"l": [3, 1, {"a": 1}], "s": "v"}) == {"l": [1, {"a": 1}, 3], "s": "v"}
    assert condense.deep_merge(None, "") is None


def test_exact_tokens(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = ["", "Hello  world", "naïve 指南 " * 50]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "doc_id long, text string")
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r.tokens for r in flows.exact_tokens(docs, P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()] == [*want, 0]


def test_eviction_keeps_what_runs(spark):
    tasks = spark.createDataFrame([(k, k % 2 == 0) for k in range(10)], "at int, done boolean")
    left = lambda most: sorted(r.at for r in evaluation.evict_finished(tasks, F.col("done"), ["at"], most).collect())
    assert left(7) == [1, 3, 5, 6, 7, 8, 9] and left(3) == [1, 3, 5, 7, 9] and left(20) == [*range(10)]
