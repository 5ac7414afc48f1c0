"""Deduplication in rounds against the folds that define it."""

import random
import re

from pagemill.operators import merge

SCHEMA = "doc_id long, ord long, text string, quote string"


def fold_two_keys(rows):
    kept, texts, quotes = set(), {}, {}
    for d, o, text, quote in sorted(rows, key=lambda r: (r[0], r[1])):
        if not (text or "").strip():
            continue
        t, q = re.sub(r"[^\w]+", "", text.strip().lower()), (quote or "").strip().lower()
        if t in texts.setdefault(d, set()) or (q and q in quotes.setdefault(d, set())):
            continue
        kept.add((d, o))
        texts[d].add(t)
        if q:
            quotes.setdefault(d, set()).add(q)
    return kept


def fold_fuzzy(rows, least=10, share=0.6):
    kept, seen = set(), {}
    for d, o, text, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        if text is None or len(text) < least:
            continue
        words = frozenset(text.lower().split())
        if any(min(len(words), len(s)) and len(words & s) / min(len(words), len(s)) > share for s in seen.setdefault(d, [])):
            continue
        kept.add((d, o))
        seen[d].append(words)
    return kept


def kept(df):
    return {(r.doc_id, r.ord) for r in df.select("doc_id", "ord").collect()}


def made(seed, docs, lines, bases, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["the", "of", "and"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 14))] for _ in range(bases)]
    rows = []
    for d in range(docs):
        for o in range(lines):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rows.append((d, o, " ".join(line) if rng.random() < 0.97 else rng.choice([None, "", " " * 12, "short"]), rng.choice(["", None, f"q{rng.randrange(bases)}", " Q1 "])))
    rng.shuffle(rows)
    return rows


def test_rounds_equal_the_folds(spark):
    for seed, docs, lines, bases, words in ((1, 6, 60, 20, 40), (2, 3, 120, 200, 12), (3, 20, 8, 5, 5)):
        rows = made(seed, docs, lines, bases, words)
        items = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert kept(merge.dedup_two_keys(items)) == fold_two_keys(rows)
        for share in (0.6, 0.3):
            assert kept(merge.dedup_fuzzy(items, share=share)) == fold_fuzzy(rows, share=share)


def test_a_long_document(spark):
    rows = made(4, 1, 10_000, 250, 4000)
    items = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert kept(merge.dedup_two_keys(items)) == fold_two_keys(rows)
    assert kept(merge.dedup_fuzzy(items)) == fold_fuzzy(rows)


def test_chains(spark):
    """Each item goes or stays because of the one before it, so one is decided after the other."""
    rows = [(1, i, f"text number {(i + 1) // 2}", f"quote {i // 2}") for i in range(9)]
    assert kept(merge.dedup_two_keys(spark.createDataFrame(rows, SCHEMA))) == fold_two_keys(rows)
    near = [(1, i, " ".join(f"w{k}" for k in range(4 * i, 4 * i + 10)), None) for i in range(12)]
    assert kept(merge.dedup_fuzzy(spark.createDataFrame(near, SCHEMA), share=0.5)) == fold_fuzzy(near, share=0.5)


def test_empty_tables(spark):
    for rows in ([], [(1, 0, None, None)], [(1, 0, " " * 20, "q")]):
        items = spark.createDataFrame(rows, SCHEMA)
        assert kept(merge.dedup_two_keys(items)) == fold_two_keys(rows) and kept(merge.dedup_fuzzy(items)) == fold_fuzzy(rows)


def test_pairs_come_from_rare_words_only(spark):
    """Sets that share only a word common to all are never put side by side."""
    rows = [(1, i, ["the", f"a{i}", f"b{i}", f"c{i}"]) for i in range(400)]
    sets = spark.createDataFrame(rows, "doc_id long, ord long, words array<string>")
    found = merge.overlapping(sets, 0.6)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_short_documents_are_folded_in_their_row(spark, monkeypatch):
    """Below and above FEW items the same texts stay; without a long document no pairs are listed."""
    rows = []
    for k, lines in enumerate((merge.FEW - 1, merge.FEW, merge.FEW + 1)):
        rows += [(k, o, text, q) for _, o, text, q in made(10 + k, 1, lines, 15, 30)] + [(k, 1000, " " * 12, None), (k, 1001, "\t" * 12, None)]
    want = fold_fuzzy(rows)
    assert kept(merge.dedup_fuzzy(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want
    monkeypatch.setattr(merge, "overlapping", None)
    short = [r for r in rows if r[0] == 0][: merge.FEW]
    assert kept(merge.dedup_fuzzy(spark.createDataFrame(short, SCHEMA))) == fold_fuzzy(short)
