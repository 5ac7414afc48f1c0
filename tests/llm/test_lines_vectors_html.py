"""Line dedup, vectors and pages against plain versions."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill.llm import html_text
from pagemill.llm import line_dedup as line_dedup_module
from pagemill.llm._spark import Scratch
from pagemill.llm.html_text import extract_text, main_text, valid_tokens
from pagemill.llm.line_dedup import OP2_SQL, line_dedup
from pagemill.llm.vector_dedup import OP5_SQL, vector_dedup

WORDS = ["w%d" % i for i in range(30)]


def plain_line_dedup(rows, min_words):
    """Every window of lines with enough words, oldest first."""
    rows = sorted(rows)
    seen, out = set(), {}
    for doc, text in rows:
        if text is None:
            out[doc] = None
            continue
        lines = text.split("\n")
        held = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\x0b")]
        gone = set()
        for a in range(len(held)):
            n = 0
            for b in range(a, len(held)):
                n += len([w for w in lines[held[b]].replace("\t", " ").split(" ") if w])
                if n >= min_words:
                    key = tuple(lines[i] for i in held[a : b + 1])
                    if key in seen:
                        gone.update(held[a : b + 1])
                    seen.add(key)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def made_documents(seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    hot = "one common line"
    passages = [[line(rng.choice((3, 8, 20))) for _ in range(rng.choice((1, 2, 4, 7)))] for _ in range(6)]
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            kind = rng.random()
            lines += [hot] if kind < 0.3 else rng.choice(passages) if kind < 0.75 else [line(rng.randrange(0, 9))]
        rows.append((doc, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, rows[3][1]), (104, rows[3][1]), (105, "x " * 5000 + "\n" + hot)]


@pytest.mark.parametrize("min_words", [1, 6, 25])
def test_line_dedup_matches_a_plain_version(spark, min_words):
    rows = made_documents(min_words)
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, p string, _line int").repartition(3)
    got = line_dedup(docs, min_words=min_words, removed="n")
    assert got.columns == [*docs.columns, "n"]
    assert {r.doc_id: r.text for r in got.collect()} == plain_line_dedup(rows, min_words)


def test_line_dedup_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b\nc d"), (None, "a b\nc d"), (5, "a b\nc d\ne"), (5, "z\na b\nc d"), (6, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id, r.text) for r in line_dedup(docs, min_words=4).collect()), key=str)
    assert sorted(t or "" for _, _, t in got) == ["", "a b\nc d", "a b\nc d", "e", "z"]
    assert line_dedup(docs.limit(0)).count() == 0


def test_words_of_odd_lines(spark):
    lines = ["a", " a b ", "a  b", "a\tb c", "\ta", "a\r", "\x0ba\x0cb", "a\u00a0b c", "\u00e9 \u4e2d  x", " \t a \r\t b  c \x0c"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup_module._words(F.col("line")).alias("n")).collect()
    assert {r.line: r.n for r in got} == {x: len([w for w in re.split("[ \t\r\x0c\x0b]", x) if w]) for x in lines}


def test_suffix_array_matches_a_plain_version(spark):
    rng = random.Random(11)
    rows = [(d, "\n".join(rng.choice("abc") for _ in range(rng.randrange(2, 40)))) for d in range(12)]
    rows += [(20, "\n".join("a" * 70)), (21, "\n".join("ab" * 35)), (22, rows[3][1]), (23, rows[3][1] + "\nb"), (24, "\n".join("a" * 70) + "\nonce\n" + rows[5][1])]
    scratch = Scratch(spark, "test")
    table = line_dedup_module.repeated_stretches(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 1, scratch)
    held, keys = {}, {}
    for r in sorted(table.collect(), key=lambda r: r.p):
        held.setdefault((r._id, r._seg), []).append(r)
        keys[r._id] = (r._a, r._b)
    suffixes = sorted(([x.r0 for x in g[j:]], d, keys[d], g[j].p) for (d, _), g in held.items() for j in range(len(g)))
    want = []
    for before, (lines, d, _, p) in zip([([],), *suffixes], suffixes):
        want.append((d, p, next((n for n, (x, y) in enumerate(zip(lines, before[0])) if x != y), min(len(lines), len(before[0])))))
    got = line_dedup_module.suffix_array(*line_dedup_module.doubled(table, scratch), scratch).orderBy("_at").collect()
    assert [(r._id, r.p, r.lcp) for r in got] == want


def test_finished_stretches_leave_the_rounds(spark, monkeypatch):
    line = lambda *key: " ".join("%s%d" % (key, i) for i in range(30))
    short = [(i, "\n".join(line(i % 100, j) for j in range(3))) for i in range(200)]
    long = "\n".join(line("long", j) for j in range(70))
    docs = spark.createDataFrame([*short, (300, long), (301, long)], "doc_id long, text string")
    written, save = [], Scratch.save

    def counted(self, df):
        out = save(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert all((got[i] == "") == (i >= 100) for i in range(200)) and got[300] == long and got[301] == ""
    # 740 repeated lines and eight rounds, most of which are for the long text alone
    assert sum(written) < 16 * 740


def test_line_dedup_sql(spark):
    rows = [(d, None if t is None else "\n".join(x * 1 for x in t.split("\n"))) for d, t in made_documents(9)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1] for r in con.execute(OP2_SQL).fetchall()}
    assert want == plain_line_dedup(rows, 50)


def plain_links(rows):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            top = max(map(abs, v))
            good[k] = [x / top / math.sqrt(sum((y / top) ** 2 for y in v)) for x in v]
    near = {k: {j for j in good if j != k and len(good[j]) == len(good[k]) and sum(a * b for a, b in zip(good[j], good[k])) >= 0.9} for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        reach, stack = {k}, [k]
        while stack:
            for j in near.get(stack.pop(), ()):
                if j not in reach:
                    reach.add(j), stack.append(j)
        out.append((i, len(near.get(k, ())), min(rows[j][0] for j in reach)))
    return sorted(out)


def test_vectors_match_brute_force(spark):
    rng = random.Random(5)
    point = lambda: [rng.gauss(0, 1) for _ in range(16)]
    shaken = lambda v, s: [x + rng.gauss(0, s) for x in v]
    rows = [(i, point()) for i in range(150)]
    rows += [(200 + i, shaken(rows[0][1], 0.05)) for i in range(120)] + [(400 + i, rows[1][1]) for i in range(30)]
    rows += [(500 + i, shaken(rows[i][1], 0.3)) for i in range(2, 60)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1e300] * 16), (906, [2e300] * 16), (907, [1.0, 2.0]), (908, [2.0, 4.0])]
    vectors = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, _key string").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup(vectors, block=64, window=24, members=40).collect())
    assert got == plain_links(rows)
    assert vector_dedup(vectors.limit(0)).count() == 0


def test_vector_sql(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(r[:3] for r in con.execute(OP5_SQL).fetchall()) == plain_links(rows)


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>'
    '<nav><ul><li><a href="/a">%s</a></ul></nav><div class="ad">%s</div><article><h1>A &amp; B</h1><p><b>one\n two<br>three'
    '<p>four &lt;x&gt; <script>no</script>five</p><div class="user-comments"><p>bad</p></div></article><footer>&copy; x</footer></body></html>'
)


def test_main_text():
    assert main_text(PAGE % ("menu", "buy"), []) == "A & B\n\none two three\n\nfour <x> five"
    assert main_text(None, []) == main_text("", []) == main_text("<", [])[1:] == ""
    assert main_text("<p>broken <div>off <b", []) == "broken\n\noff"
    assert main_text('<body><div class="cookie-notice">We use cookies</div><p>text</p><form>f</form><aside>s</aside>', []) == "text"


def test_classes_must_be_in_order():
    assert valid_tokens(["a", "x", "b", "c"], [["a", "b", "c"]]) == {"a", "b", "c"}
    assert valid_tokens(["b", "a", "c", "b"], [["a", "b", "c"], ["x"]]) == set()


def test_template_text_is_dropped(spark):
    page = lambda i: f"<html><body><div>Our great site since 1999</div><div><p>story {i} about {i * 7} things</p></div><div>All rights stay here</div></body></html>"
    rows = [(i, "http://host.example/%d" % i, page(i)) for i in range(12)] + [(50, "http://other.example/", page(50)), (51, None, None), (52, "http://host.example/", ""), (53, "http://host.example/", "<p>" + "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, host string, text string").repartition(3)
    got = {r.page_id: r for r in extract_text(pages).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == f"story {i} about {i * 7} things" for i in range(12))
    assert got[50].text == "Our great site since 1999\n\nstory 50 about 350 things\n\nAll rights stay here"
    assert got[51].text == got[52].text == "" and got[53].n_chars == 5 * 50_000 - 1
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    [
        '<body class="has-sidebar"><article><p>the story</p></article></body>',
        '<body class="sidebar"><p>the story</p></body>',
        '<div id="content-with-sidebar"><p>the story</p></div>',
        '<article class="post comments-open"><p>the story</p></article>',
        '<div class="share-enabled"><article><p>the story</p></article></div>',
        '<div class="widget"><main><p>the story</p></main></div><div class="widget"><p>no</p></div>',
        '<article><p>the story</p></article><section id="comments"><article class="comment"><p>no</p></article></section>',
        '<div class="social-post"><p>the story</p></div><div class="sidebar-left"><p>no</p></div>',
        '<main><div class="comments-wrapper"><article><p>the story</p></article></div></main>',
    ],
)
def test_names_do_not_cut_off_the_article(html):
    assert main_text(html, []) == "the story"


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {(r.page_id, r.url): r.text for r in extract_text(pages).collect()}


FRAME = "<html><body><div>Our great site since 1999</div><div>%s</div><div>All rights stay here</div></body></html>"


def test_copies_are_no_evidence_for_a_template(spark):
    story = FRAME % "<h1>Rare heading</h1><p>every word stands here once only</p>"
    rows = [(i, "http://mirror.example/%d" % i, story) for i in range(12)]
    rows += [(20 + i, "http://mirror.example/%d" % i, FRAME % f"<p>other{i} tale{i}</p>") for i in range(4)]
    got = texts(spark, rows)
    assert all(got[i, "http://mirror.example/%d" % i] == "Rare heading\n\nevery word stands here once only" for i in range(12))
    assert got[21, "http://mirror.example/1"] == "other1 tale1"
    alone = texts(spark, rows[:12])
    assert set(alone.values()) == {"Our great site since 1999\n\nRare heading\n\nevery word stands here once only\n\nAll rights stay here"}


def test_a_doubled_table_gives_the_same_texts(spark):
    rows = []
    for i in range(12):
        extra = "<p>read more of this here</p>" * (i % 3)
        rows.append((None if i % 2 else i, "http://host.example/" + str(i) * (i % 2), FRAME % f"<p>story{i} tells of{i * 7}</p>{extra}"))
    once = texts(spark, rows)
    assert texts(spark, rows + rows) == once
    assert all(t.startswith("story") and "rights" not in t for t in once.values())


def test_template_text_inside_the_article_is_dropped(spark):
    page = "<html><body><article><h1>title%d</h1><p>Share this story with friends</p><p>tale%d about the %d</p><p>Subscribe to our letter today</p></article></body></html>"
    got = texts(spark, [(i, "http://host.example/%d" % i, page % (i, i, i * 7)) for i in range(12)])
    assert all(got[i, "http://host.example/%d" % i] == f"title{i}\n\ntale{i} about the {i * 7}" for i in range(12))


def test_classes_are_nested():
    outer, inner = ["a", "b", "c", "d"], ["x", "y", "z"]
    assert valid_tokens("a x y z b x y z c d".split(), [inner, outer]) == {*outer}  # in two gaps of the outer class
    assert valid_tokens("a b x 1 y z x 2 y z c d".split(), [inner, outer]) == {*outer, *inner}
    assert valid_tokens("a x b y z c d".split(), [inner, outer]) == {*outer, *inner}  # broken up
    assert valid_tokens("a x z y b c d".split(), [inner, outer]) == {*outer}


def test_links_in_a_crowded_region_are_found(spark):
    rng = random.Random(8)
    middle = [rng.gauss(0, 1) for _ in range(16)]
    near = lambda v, s: [x + rng.gauss(0, s) for x in v]
    rows = [(i, near(middle, 0.65)) for i in range(400)]
    rows += [(1000 + i, near(rows[i][1], 0.3)) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup(vectors, passes=1, window=2).collect())
    assert got == plain_links(rows)


def plain_templates(rows):
    """Occurrence vectors kept as such, and their classes by host: what ``templates`` must find in signatures."""
    hosts = {}
    for host, html in rows:
        hosts.setdefault(host, {}).setdefault(main_text(html, []), []).append(html_text.parse(html))
    found = {}
    for host, articles in hosts.items():
        pages = [min(copies, key=lambda p: p.digest()).tokens().tolist() for copies in articles.values()]
        counts = [Counter(p) for p in pages]
        classes = {}
        for token in {t for c in counts for t in c}:
            vector = tuple(c[token] for c in counts)
            if sum(map(bool, vector)) >= max(html_text.MIN_PAGES, html_text.MIN_SHARE * len(pages)):
                places = [[*dict.fromkeys(p)].index(token) for p in pages if token in p]
                classes.setdefault(vector, []).append((sum(places) / len(places), token))
        found[host] = {tuple(t for _, t in sorted(c)) for c in classes.values() if len(c) >= html_text.MIN_SIZE}
    return {h: c for h, c in found.items() if c}


@pytest.mark.parametrize("chunk", [8, 512])
def test_templates_match_whole_occurrence_vectors(spark, monkeypatch, chunk):
    rng = random.Random(chunk)
    monkeypatch.setattr(html_text, "CHUNK", chunk)  # hosts over several groups, which are smaller than SURE
    rows = []
    for host, n in (("a", 3), ("b", 5), ("c", 40), ("d", 23)):
        for i in range(n):
            aside = "<div>also read this now</div>" * rng.choice((0, 1, 2))
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 30)))
            rows.append((host, FRAME % f"<h1>Head{i}</h1><p>{text}</p>{aside}<ul><li>one</li><li>two</li></ul>"))
    rows += rows[10:20] + [("e", ""), ("e", None), ("e", "<p>x")]
    pages = spark.createDataFrame(rows, "host string, _html string").repartition(3)
    got = {r.host: {tuple(c) for c in r.template} for r in html_text.templates(pages, Scratch(spark, "t")).collect()}
    assert got == plain_templates([(h, t or "") for h, t in rows])


def test_what_is_nested_in_skipped_elements_is_skipped():
    skipped = "<noscript><p>no</p></noscript><template><div>no</div></template><button><p>no</p></button><span class='comments'><p>no</p><p>no</p></span>"
    assert main_text(f"<article><p>one</p>{skipped}<p>two</p></article>", []) == "one\n\ntwo"
    assert main_text("<div><span class='ad'>no</div><p>after one left open</p>", []) == "after one left open"
    assert main_text("<p>a <label>no<p>b", []) == "a\n\nb"


def test_deep_and_long_pages():
    deep = 100_000
    assert main_text("<div>" * deep + "x" + "</div>" * deep + "<p>y", []) == "x\n\ny"
    assert main_text("<div class='ad'>" * deep + "x" + "</div>" * deep + "<p>y", []) == "y"
    assert main_text("<p>" + "</b>" * deep + "x" + "</i>" * deep, []) == "x"
    assert len(main_text("<p>" + "word " * 500_000, [])) == 5 * 500_000 - 1


def test_suffix_array_and_common_prefixes(spark):
    rows = made_documents(3) + [(200 + i, "\n".join(["a b"] * (3 + i) + ["c d"])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    table = line_dedup_module.repeated_stretches(docs, "doc_id", "text", 1, scratch)
    lines = {}
    for r in sorted(table.collect(), key=lambda r: r.p):
        lines.setdefault((r._a, r._b, r._seg), []).append((r.r0, r._id, r.p))
    suffixes = sorted((tuple(x[0] for x in held[i:]), held[i][1], a, b, held[i][2]) for (a, b, _), held in lines.items() for i in range(len(held)))
    found = sorted(line_dedup_module.suffix_array(*line_dedup_module.doubled(table, scratch), scratch).collect(), key=lambda r: r._at)
    assert [(r._id, r._a, r._b, r.p) for r in found] == [s[1:] for s in suffixes]
    for k in range(1, len(suffixes)):
        x, y = suffixes[k - 1][0], suffixes[k][0]
        same = next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert found[k].lcp == same
    assert found[0].lcp == 0 and max(r.lcp for r in found) > 4
