"""Tokenizers, packing and token counts against the libraries and plain versions."""

import base64
import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import byte_bpe, packing, token_counts
from pagemill.llm._units import Cache, units

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LEVEL = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")
PARTS = ["a", "b", "A", " ", "  ", "\n", "\r\n", "\t", "-", "=", ".", "ha", "é", "日本", "🙂", "1", "\x1c", "\x85", " ", "'s", "aa", "__", "word", "Wörter,", "<|endoftext|>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(st.characters(exclude_categories=["Cs"]), max_size=40)
ODD = [None, "", " ", "\n", "\n\n a", "a" * 5000, "ab" * 3000, "- " * 2000, "word " * 30_000, "x\x00y", "é ‮"]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def level():
    return packing.ByteLevel(LEVEL), Tokenizer.from_file(LEVEL)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_equals_tiktoken(bpe, tik):
    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def check(text):
        ids = tik.encode_ordinary(text)
        assert bpe.encode(text) == packed(ids) and bpe.decode(ids) == text.encode()

    check()
    for text in filter(None, ODD):
        assert bpe.encode(text) == packed(tik.encode_ordinary(text))


def test_merging_by_rank(bpe, tik):
    for text in ("a" * 37, "hahahahahah", "abcabcabcab", "日本日本", "x", "internationalising"):
        if text.encode() not in bpe.ranks:
            assert bpe.merged(text.encode()) == tik.encode_ordinary(text)


def test_byte_level_equals_the_library(level):
    own, library = level

    @settings(max_examples=400, deadline=None)
    @given(TEXT)
    def check(text):
        assert own.encode(text) == packed(library.encode(text, add_special_tokens=False).ids)

    check()
    assert own.encode("<|endoftext|> hi") == packed(library.encode("<|endoftext|> hi", add_special_tokens=False).ids)
    for text in filter(None, ODD):
        assert own.encode(text) == packed(library.encode(text, add_special_tokens=False).ids)


def test_units_put_together_are_the_text():
    for text in ("", "a", "a b\nc", "\na b", "a b ", "a\tb"):
        cut = units(text)
        assert cut[0] + "".join(u if u[:1] == "\n" else " " + u for u in cut[1:]) == text
    assert units("a  b") is None and units("a \n") is None


def test_cache_is_bounded():
    made = []
    cache = Cache(lambda k: made.append(k) or len(k), 10)
    assert [cache[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)]
    assert len(cache) + len(cache.old) <= 20 and len(made) == 100


def odd_docs(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(ODD)] + [(3, "x y", "c", 1), (3, "x y", "c", 1), (None, "z", None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(3)


def test_bpe_round_trip(spark, tik):
    rows, docs = odd_docs(spark)
    encoded = byte_bpe.bpe_encode(docs, RANKS, P.PATTERN)
    got = sorted(((r.doc_id, r.ids, r.ends, bytes(r.decoded)) for r in byte_bpe.bpe_decode(encoded, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, text, *_ in rows:
        ids = tik.encode_ordinary(text or "")
        ends = [sum(len(tik.decode_single_token_bytes(x)) for x in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 3000 else None
        want.append((i, ids, ends, (text or "").encode()))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want, key=lambda r: str((r[0], r[1], r[2], r[3])))] or Counter((a, hashlib.md5(packed(b)).digest(), d) for a, b, _, d in got) == Counter((a, hashlib.md5(packed(b)).digest(), d) for a, b, _, d in want)
    ends = {(a, d): c for a, _, c, d in got}
    assert all(c is None or ends[a, d] == c for a, _, c, d in want)
    assert byte_bpe.bpe_encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 50, 5000])
def test_plan_is_whole_and_near_the_bound(n):
    rng = random.Random(n)
    counts = Counter(max(1, min(1024, int(rng.lognormvariate(5.5, 1)))) for _ in range(n))
    planned = packing.plan(counts)
    used = Counter()
    for times, pattern in planned:
        assert sum(x * k for x, k in pattern) <= 1024
        used.update({x: k * times for x, k in pattern})
    assert used == counts
    bound = max(math.ceil(sum(x * k for x, k in counts.items()) / 1024), sum(k for x, k in counts.items() if x > 512))
    assert sum(t for t, _ in planned) <= bound * 1.02 + 1


def test_pack(spark, level):
    rows, docs = odd_docs(spark)
    docs = docs.withColumnRenamed("length", "piece")
    got = [r.asDict() for r in packing.pack(docs, LEVEL, 64).collect()]
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(i, level[1].encode(text or "", add_special_tokens=False).ids + [2])
    for r in got:
        if r["doc_id"] != 3:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(packed(part)) == r["ids_crc32"]
            assert r["piece"] == 0 or r["length"] == 64
    for i in {*ids} - {3}:
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(ids[i])
    places = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert places.get(r["sequence_id"], 0) == r["offset"]
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 64
    assert packing.pack(docs.limit(0), LEVEL).count() == 0


def plain_count(token, scores):
    best = [(0.0, 0)]
    for j in range(1, len(token) + 1):
        c = token[j - 1]
        n = len(c.encode())
        options = [] if c in scores else [(best[j - 1][0] + n * token_counts.FALLBACK, best[j - 1][1] - n)]
        options += [(best[i][0] + scores[token[i:j]], best[i][1] - 1) for i in range(j) if token[i:j] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_trie_equals_plain_counts():
    scores = token_counts.zipf_scores(token_counts.read_pieces(PIECES))
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeinorstéß日🙂1.,") for _ in range(rng.randrange(1, 14))) for _ in range(800)] + ["the", "internationalisation", "x" * 300]
    for nodes in (50, 10_000):
        trie = token_counts.Trie(scores, nodes)
        assert all(trie.insert("▁" + w) == plain_count("▁" + w, scores) for w in words)
        trie.insert("ab" * 50_000)
        assert len(trie.best) <= nodes and len(trie.edges) < nodes


def test_token_counts(spark):
    rows, docs = odd_docs(spark)
    scores = token_counts.zipf_scores(token_counts.read_pieces(PIECES))
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, PIECES).collect())
    seen = {}
    want = Counter()
    for i, text, *_ in rows:
        words = (text or "").split()
        want[i, len(words), sum(seen.setdefault(w, plain_count("▁" + w, scores)) if len(w) < 1000 else token_counts.Trie(scores).insert("▁" + w) for w in words)] += 1
    assert got == want


def test_the_registered_query_against_the_library(spark, tik):
    rows = byte_bpe.op8_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = tik.encode_ordinary(docs[r.doc_id])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))
        ends = itertools.accumulate(len(tik.decode_single_token_bytes(x)) for x in ids)
        assert r.ends_sha256 == sha(packed(list(ends)))
