"""Windows against a plain dynamic program, and pieces against the library's ids."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import window_packing as wp

LEVEL = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def level():
    tokenizer = wp.Encoder(LEVEL)
    return tokenizer, wp.Sentences(tokenizer.level)


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def least(places, costs, capacity):
    """(padding and costs, windows) of the best cuts, by trying every window."""
    best = [(0, 0)]
    for j in range(1, len(places)):
        best.append(min((best[i][0] + padding(places[j] - places[i], capacity) + costs[j], best[i][1] + 1) for i in range(j) if places[j] - places[i] <= capacity))
    return best[-1]


def paid(ends, cost_of, capacity):
    return sum(padding(b - a, capacity) + cost_of[b] for a, b in zip([0, *ends], ends)), len(ends)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=12), min_size=1, max_size=12), st.sampled_from([9, 16, 24]))
def test_windows_are_the_optimum(parts, capacity):
    windows, ends, at, places, costs = wp.Windows(capacity), [], 0, [0], [0]
    for part in parts:
        steps, cost = np.array([s for s, _ in part]), np.array([*(c for _, c in part[:-1]), 0])
        here = at + np.cumsum(steps)
        places += here.tolist()
        costs += cost.tolist()
        at = int(here[-1])
        ends += windows.add(here, cost)
    ends += windows.close()
    assert ends[-1] == at and all(b - a <= capacity for a, b in zip([0, *ends], ends))
    assert paid(ends, dict(zip(places, costs)), capacity) == least(places, costs, capacity)


def test_settled_windows_are_forgotten():
    windows, rng, at, out = wp.Windows(64), random.Random(2), 0, []
    for _ in range(200):
        here = at + np.cumsum([rng.randrange(1, 20) for _ in range(50)])
        at = int(here[-1])
        out += windows.add(here, np.array([rng.choice([3, 8]) for _ in range(49)] + [0]))
        assert len(windows.place) < 400
    assert out == sorted(out) and out[-1] > at - 4000


def test_a_cut_is_forced_where_no_way_is_common():
    # documents of one length: every phase stays open
    windows = wp.Windows(7, limit=50)
    out = [x for k in range(100) for x in windows.add(np.array([3 * k + 3]), np.array([0]))] + windows.close()
    assert out[-1] == 300 and len(windows.place) == 1 and all(b - a <= 7 for a, b in zip([0, *out], out))


def test_encoder_equals_the_library(level):
    library = Tokenizer.from_file(LEVEL)
    assert level[0].fast
    parts = ["a", "b", "A", " ", "  ", "\n", "\r\n", "\t", "-", "...", "é", "日本", "🙂", "12", "\x1c", "\x85", "\u3000", "'s", "__", "word", "Wörter,", "<|endoftext|>", "internationalisation", "\x00", "ethron", "ndestt"]

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.sampled_from(parts), max_size=30).map("".join) | st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("abcdeilnorst", max_size=60))
    def check(text):
        assert level[0].encode(text) == struct.pack(f"<{len(ids)}I", *ids) if (ids := library.encode(text, add_special_tokens=False).ids) else level[0].encode(text) == b""

    check()
    for text in ("a" * 50_000, "word " * 3000, "- " * 900 + "x" * 3000, " " * 5000, "日本" * 2000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert level[0].encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_sentences(level):
    tokenizer, sentences = level
    text = 'One two. Three 3.5 four? "Five!" Six\nSeven e.g. x 日本語。次の文'
    ids = np.frombuffer(tokenizer.encode(text), "<u4")
    ends = sentences.ends(ids)
    cuts = [tokenizer.level.whole.decode(ids[a:b].tolist()) for a, b in zip([0, *ends], [*ends, len(ids)])]
    assert "".join(cuts) == text and cuts == ["One two.", " Three 3.5 four?", ' "Five!"', " Six\n", "Seven e.g.", " x 日本語。", "次の文"]


TEXTS = [None, "", " ", "One two. Three four.\nFive six? Seven.", "a" * 4000, "word " * 5000, "Sentence one is here. " * 400, "<|endoftext|> x", "é 日本語。次。"]


@pytest.mark.parametrize(("capacity", "block", "limit"), [(2048, 1 << 18, 1 << 23), (64, 500, 1 << 23), (48, 300, 600)])
def test_pieces(spark, capacity, block, limit):
    library = Tokenizer.from_file(LEVEL)
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["the", "cat", "sat.", "on", "Mat?", "x\n"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i, t, 0, "c") for i, t in enumerate(texts)] + [(None, "no id", 0, "c"), (3, texts[3], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, _id string").repartition(3)
    got = wp.pack_windows(docs, LEVEL, capacity, block=block, limit=limit).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in rows}
    held = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length > 0 and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        held[r.doc_id] += range(r.start, r.start + r.length)
    assert all(sorted(held[i]) == sorted([*range(len(x))] * (2 if i == 3 else 1)) for i, x in ids.items())
    places = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert places[r.sequence_id] == r.offset
        places[r.sequence_id] += r.length
    assert max(places.values()) <= capacity
    total = sum(places.values())
    assert sum(padding(x, capacity) for x in places.values()) < 0.05 * total
    assert wp.pack_windows(docs.limit(0), LEVEL).count() == 0


def test_streams_equal_one_solution(level):
    """Blocks change nothing: the same cuts' cost as of one plain solution over the whole stream."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "cat", "sat.", "on", "Mat?"]) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    for block in (100, 1 << 20):
        stream, rows = wp.Stream(*level, 0, 64, block, 1 << 23), []
        for k, t in enumerate(texts):
            rows += stream.add(k, t)
        rows += stream.close()
        ends, at = [], Counter()
        for r in rows:
            at[r[5]] += r[2]
        for s in sorted(at):
            ends.append((ends[-1] if ends else 0) + at[s])
        places, costs, start = [0], [0], 0
        raws = [np.frombuffer(level[0].encode(t), "<u4") for t in texts]
        total = sum(len(r) + 1 for r in raws)
        for ids in raws:
            n = len(ids) + 1
            cost = {k: wp.INSIDE for k in range(1, n) if k % wp.STRIDE == 0 or start + k >= total - 128}
            cost |= {int(k): wp.SENTENCE for k in level[1].ends(np.append(ids, wp.END))} | {n: 0}
            places += [start + k for k in sorted(cost)]
            costs += [cost[k] for k in sorted(cost)]
            start += n
        assert paid(ends, dict(zip(places, costs)), 64) == least(places, costs, 64)


def test_little_padding(spark):
    rows = wp.op12_window_packing(spark, "/root/testdata/sf0.001").collect()
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert sum(padding(x, 2048) for x in size.values()) < 0.01 * sum(size.values())
