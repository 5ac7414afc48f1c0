"""Operators on hand-written cases: mixed scripts, edges, order of rows, state machines, outside services."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.functions import json as js
from pagemill.functions import text as tx
from pagemill.operators import chunking, evidence, generate, merge, pages, retrieval
from pagemill.sources import files, sinks
from pagemill.streaming import states


def one(spark, build, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(build(*(F.col(k) for k in values)).alias("x")).first().x


def test_pages_by_hand(spark):
    assert one(spark, tx.is_skip_page, t="  Table of Contents\nIntro .... 3")
    assert one(spark, tx.is_skip_page, t="目录\n第一章") and not one(spark, tx.is_skip_page, t="Intro\nReferences are many")
    assert one(spark, tx.is_skip_page, t="\n".join(f"Chapter {i} . {i}" for i in range(12)))
    assert one(spark, tx.is_empty_page, t=" x \n" * 99) and not one(spark, tx.is_empty_page, t="x" * 100)
    score = lambda t, p, n: tx.page_score(t, p, n, tx.GUIDELINE_WORDS)
    assert one(spark, score, t="Abstract\nWe recommend; must must must must", p=9, n=30) == pytest.approx(4 + 0.5 + 1.5 + 38 / 2000, abs=0.01)
    assert one(spark, tx.has_section_header, t="x\n1.2 Methods") and one(spark, tx.has_section_header, t="第三章 方法")


def test_numbers_of_texts(spark):
    assert one(spark, tx.token_estimate, t="") == 0
    assert one(spark, tx.token_estimate, t="中文 two words.") == int(2 * 1.8 + 2 * 1.3 + 0.5)
    assert chunking.token_estimate("中文 two words.") == int(2 * 1.8 + 2 * 1.3 + 0.5)
    assert one(spark, tx.content_density, t="abc def!") == pytest.approx(6 / 7)
    assert one(spark, lambda t: tx.page_range(t, F.lit(12)), t="p4, p7-p8 and p9-10") == [1, 2, 3, 4, 7, 8, 9, 10, 11, 12]
    assert one(spark, tx.source_page, t="Page P12") == "p12" and one(spark, tx.source_page, t="none") is None
    assert one(spark, tx.first_number, t="n1 = 1234567, then 250 men") == 250
    assert one(spark, tx.heading, t=" ## 2.1 Methods：") == "Methods"
    assert one(spark, lambda t: tx.without_unsupported(t, F.lit("in 1999"), r"(?:19|20)\d{2},?"), t="1999, 2024, end") == "1999, end"


def test_ngrams(spark):
    assert set(one(spark, tx.ngrams, t="A b C d")) == {"a b c", "b c d"}
    assert set(one(spark, tx.ngrams, t="a b 中文字符")) == {"a", "b", "中文字", "文字符"}
    assert set(one(spark, tx.ngrams, t="中文")) == {"中文"}


def test_selection_counts_dropped_edges(spark):
    rows = [(1, p, 20, "x" * (150 if p > 2 else 5), float(p % 7)) for p in range(1, 21)]
    got = pages.select_by_score(spark.createDataFrame(rows, "doc_id long, page_no int, total_pages int, text string, s double"), F.col("s"), 10, tx.is_empty_page(F.col("text")))
    assert [r.page_no for r in got.orderBy("page_no").collect()] == [3, 4, 5, 6, 13, 18, 19, 20]


def test_windows_have_a_redundant_tail(spark):
    rows = spark.createDataFrame([(1, p, 60, "x") for p in range(1, 61)], "doc_id long, page_no int, total_pages int, text string")
    got = pages.page_windows(rows, 25, 3).groupBy("chunk").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b")).orderBy("chunk").collect()
    assert [(r.a, r.b) for r in got] == [(1, 25), (23, 47), (45, 60)]


@pytest.mark.parametrize("n", [0, 1, 7999, 8000, 8001, 20000])
def test_character_chunks(n):
    spans = [*chunking.by_characters("x" * n)]
    assert spans[0][0] == 0 and spans[-1][1] == n and all(b > c for (_, b), (c, _) in zip(spans, spans[1:]))
    if n == 20000:
        assert spans == [(0, 8000), (7500, 15500), (15000, 20000), (19500, 20000)]
        assert [*chunking.by_characters("x" * n, legacy_tail=False)] == spans[:-1]


def test_chunks_break_at_the_best_separator():
    text = "a" * 7700 + "\n\n" + "b" * 200 + ". " + "c" * 5000
    assert [*chunking.by_characters(text)][0] == (0, 7702)
    spans = [*chunking.sliding("word. " * 5000, 1200, 200)]
    assert spans[-1][1] == 30000 and all(b - a <= 1200 for a, b in spans)
    for spans in ([*chunking.by_tokens("some words here. " * 3000, chunking.token_estimate, 1000, 50)],):
        assert spans[0][0] == 0 and spans[-1][1] == 51000 and all(b >= c for (_, b), (c, _) in zip(spans, spans[1:]))


def items(spark, rows):
    return spark.createDataFrame([(1, i, t, q, 1) for i, (t, q) in enumerate(rows)], "doc_id long, ord int, text string, quote string, cited_page int")


def test_ordered_dedup_registers_kept_rows_only(spark):
    rows = [("Alpha!", "q1"), ("alpha", "q2"), ("Beta", "q2"), ("Gamma", "Q1"), (" ", "q9"), ("Delta", "")]
    assert [r.ord for r in merge.dedup_two_keys(items(spark, rows)).orderBy("ord").collect()] == [0, 2, 5]
    near = [("one two three four five", ""), ("one two three four six", ""), ("seven eight nine ten", ""), ("short", "")]
    assert [r.ord for r in merge.dedup_fuzzy(items(spark, near)).orderBy("ord").collect()] == [0, 2]


def test_locate(spark):
    book = spark.createDataFrame([(1, 1, "nothing of note on this page"), (1, 2, "患者应当接受标准治疗方案并且随访"), (1, 3, "the quick brown fox jumps over the lazy dog")], "doc_id long, page_no int, text string")
    rows = items(spark, [("", "The quick brown fox jumps"), ("", "结论：患者应当接受标准治疗方案。"), ("", "quick brown fox jumps high over a dog"), ("", "unrelated words that stand nowhere at all"), ("", "short")])
    got = {r.ord: (r.page_no, round(r.confidence, 2)) for r in evidence.locate(rows, book, F.col("quote")).collect()}
    assert got[0] == (3, 1.0) and got[1][0] == 2 and 3 not in got and 4 not in got
    checked = {r.ord: r.status for r in evidence.verify(rows, evidence.locate(rows, book, F.col("quote"))).collect()}
    assert checked[0] == "fixed" and checked[3] == "removed"


def test_keyword_of_two_fields_counts_twice(spark):
    chunks = spark.createDataFrame([(1, i, "aim aim" if i == 0 else "x", 0.0, False) for i in range(4)], "doc_id long, chunk int, text string, density double, has_header boolean")
    tf = retrieval.term_frequencies(chunks, {"a": ["aim"], "b": ["aim"]})
    assert retrieval.document_frequencies(tf).first().df == 2


@pytest.mark.parametrize(
    "text, want",
    [
        ('<think>{no</think>```json\n{"a": [1,], }\n```', {"a": [1]}),
        ('said {"s": "a } in \\" a string", "t": 1} and more }', {"s": 'a } in " a string', "t": 1}),
        ("no object", None),
        ('{"open": 1', None),
    ],
)
def test_extracted(spark, text, want):
    got = one(spark, js.extracted, t=text)
    assert (json.loads(got) if got else None) == want


def test_replies(spark):
    assert json.loads(one(spark, js.untruncated, t='{"a":[{"n":1}],"b":[{"n"')) == {"a": [{"n": 1}]}
    assert one(spark, js.untruncated, t="nothing") == "{}"
    assert json.loads(one(spark, js.or_summary, t="plain")) == {"summary": "plain", "key_points": []}
    assert [tuple(x) for x in one(spark, js.flattened_sources, t='{"a":{"sources":["p1"]},"l":[{"sources":[2]}]}')] == [("a", ["p1"]), ("l[0]", ["2"])]
    assert js.normalised_summary("【B】two\n【A】one\n# tail", ["【A】", "【B】", "【C】"], []) == "【A】\none\n\n【B】\ntwo\n\n【C】\n-"


def test_state_machines():
    limiter = states.RateLimiter()
    assert [limiter.step(i / 100, True, 0) for i in range(12)].count("rejected") == 2
    assert limiter.step(2.0, True, 0) == "admitted"  # rejected calls left no trace
    breaker = states.Breaker()
    assert breaker.step(0, False, 0) == "open"  # one failure of one call
    assert breaker.step(10, True, 0) == "open"  # refused
    assert [breaker.step(40 + i, True, 0) for i in range(3)] == ["half_open", "half_open", "closed"]
    assert [breaker.step(50 + i, ok, 0) for i, ok in enumerate((True, False, False))] == ["closed", "closed", "closed"]  # 3 of 7 calls
    assert breaker.step(60, False, 0) == "open" and breaker.step(91, False, 0) == "open"  # 4 of 8; fails again half-open
    many = states.Breaker(rate=1.1)
    assert [many.step(i, i % 2 > 0, 0) for i in range(9)] == ["closed"] * 8 + ["open"]  # the fifth failure
    assert [many.step(40 + i, True, 0) for i in range(3)][-1] == "closed" and many.step(50, False, 0) == "closed"  # counted anew
    alerts = states.Alerts()
    assert [alerts.step(t, False, 1) for t in (0, 100, 299, 301)] == ["error_rate", "", "", "error_rate"]
    task = states.Tasks()
    assert [task.step(0, ok, p) for ok, p in ((True, -5), (True, 140), (False, 3))] == ["processing", "completed", "completed"]


def test_generation_never_fails_the_job(spark):
    rows = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d e"), (2, 0, "poison")], "doc_id long, chunk int, text string")
    got = {(r.doc_id, r.chunk): (r.reply, r.error) for r in generate.generate(rows, F.col("text"), generate.Echo(poison="poison"), 2, tries=2, wait=0).collect()}
    assert got[1, 0] == ("b c", None) and got[2, 0][0] is None and "refused" in got[2, 0][1]
    folded = {r.doc_id: r.reply for r in generate.refine(rows.where("doc_id = 1"), generate.Echo(), "{text}", "{summary} {text}", 9).collect()}
    assert folded == {1: "a b c d e"}


def test_files(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 /JavaScript /Type /Page " + b"x" * 200)
    (tmp_path / "a.PDF").write_bytes(b"no" * 100)
    rows = files.pdf_files(spark, str(tmp_path), 10)
    assert [r.path[-5:] for r in rows.orderBy("path").collect()] == ["a.PDF", "b.pdf"]
    found = {r.path[-5:]: r.v for r in rows.select("path", files.validation(F.col("content"), F.col("length"), 10_000).alias("v")).collect()}
    assert found["b.pdf"].valid and found["b.pdf"].version == "1.7" and found["b.pdf"].warnings == ["/JavaScript", "/JS"][:1] and found["a.PDF"].error == "not a PDF"

    def parser(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("bad")
        return ["one", "two"], {"title": "t"}

    got = files.pdf_pages(rows, parser).collect()
    assert sorted(r.page_no for r in got if r.page_no) == [1, 2] and sum(r.error is not None for r in got) == 1
    images = spark.createDataFrame([("p", 1, bytearray(b"\x89PNG\r\n\x1a\n..")), ("p", 2, bytearray(b""))], "path string, page_no int, image binary")
    assert images.select(files.data_url(F.col("image")).alias("u")).first().u.startswith("data:image/png;base64,")

    def read(image):
        if not image:
            raise OSError("blank")
        return "text", 0.9

    assert [(r.text, r.confidence) for r in files.ocr_pages(images, read).orderBy("page_no").collect()] == [("text", 0.9), ("", 0.0)]
    with pytest.raises(ValueError):
        files.check_path("x.txt")
    with pytest.raises(FileNotFoundError):
        files.check_path("x.pdf")


def test_export():
    body, kind, extension = sinks.export({"title": "T", "summary": "S", "words": 1234, "metadata": None}, "JSON")
    assert json.loads(body)["data"]["metadata"] == {} and (kind, extension) == ("application/json", "json")
    assert b"1,234" in sinks.export({"title": "T", "summary": "S", "words": 1234}, "md")[0]
    with pytest.raises(ValueError):
        sinks.export({}, "xls")


def test_deep_merge():
    from pagemill.operators import condense

    assert condense.deep_merge({"a": "", "l": [1], "o": {"x": 1}}, {"a": "v", "l": [1, 2], "o": {"y": 2}, "b": 3}) == {"a": "v", "l": [1, 2], "o": {"x": 1, "y": 2}, "b": 3}


def plain_token_chunks(text, estimate, most, overlap, separators, reach=500):
    """The rules of the chunker one after the other, with slices in place of positions."""
    total = estimate(text)
    if total <= most:
        return [(0, len(text))]
    per_char = total / len(text)
    if per_char < 0.3:
        per_char = 0.3
    out, start = [], 0
    while start < len(text):
        stop = min(len(text), start + int(most / per_char))
        while estimate(text[start:stop]) > most and stop - start > 500:
            stop = start + int(0.8 * (stop - start))
        if stop < len(text):
            tail = max(start, stop - reach)
            for s in separators:
                if s in text[tail:stop]:
                    cut = tail + text[tail:stop].rindex(s) + len(s)
                    stop = cut if cut > start + 200 else stop
                    break
        if text[start:stop].strip():
            out.append((start, stop))
        after = stop - int(overlap / per_char)
        start = stop if after <= start else after
    return out


@pytest.mark.parametrize("most, overlap", [(6000, 300), (200, 30), (50, 200)])
def test_token_chunks(most, overlap):
    import random

    rng = random.Random(most)
    words = ["word", "another", "and", "结果", "研究。", "end. ", "new\n", "part\n\n", "a-b!", "x"]
    texts = ["", "short", " ".join(rng.choice(words) for _ in range(30_000)), "long" * 20_000, "字" * 9000 + ". " + "tail " * 5000, " " * 5000 + "x " * 9000]
    for text in texts:
        got = list(chunking.by_tokens(text, chunking.token_estimate, most, overlap))
        assert got == plain_token_chunks(text, chunking.token_estimate, most, overlap, chunking.SEPARATORS)


def test_fuzzy_dedup_of_blank_texts(spark):
    items = spark.createDataFrame([(1, 0, " " * 12), (1, 1, "\t" * 12), (1, 2, "one two three four"), (1, 3, "one two three four five"), (1, 4, "short")], "doc_id long, ord long, text string")
    assert sorted(r.ord for r in merge.dedup_fuzzy(items).collect()) == [0, 1, 2]


class Flaky:
    """Fails to connect on the first calls; refuses some prompts."""

    calls = 0

    def reply(self, prompt, max_tokens):
        if "poison" in prompt:
            raise ValueError("refused")
        type(self).calls += 1
        if type(self).calls <= 1:
            raise ConnectionError("down")
        return prompt


def test_refused_prompts_do_not_open_the_circuit():
    from pagemill.operators import generate

    Flaky.calls = 0
    prompts = ["poison"] * 30 + ["good"] * 5 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(prompts, pa.string())], ["prompt"])
    out = next(iter(generate._call(iter([batch]), Flaky(), 10, 3, 0.0, timeout=0.01))).to_pydict()
    assert [e is None for e in out["error"]] == [False] * 30 + [True] * 6


def test_backpressure():
    gate = states.Backpressure(flight=3, running=2, patience=5.0)
    calls = [(0, 4), (0, 9), (1, 1), (2, 1), (4.5, 1), (6, 1), (6, 1), (6, 1)]
    assert [gate.step(at, True, n) for at, n in calls] == ["admitted", "admitted", "admitted", "rejected", "admitted", "admitted", "admitted", "rejected"]
    full = states.Backpressure(flight=9, running=1, patience=5.0)
    assert [full.step(at, True, n) for at, n in ((0, 10), (1, 1), (5, 1), (6, 1))] == ["admitted", "timeout", "admitted", "admitted"]
