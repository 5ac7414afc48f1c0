"""Aligned tokens against the libraries' own encodings and plain loops over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import alignment
from pagemill.llm._units import byte_characters, units

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "b", "A", " ", "  ", "   ", "\n", "\r\n", "\t", "-", ".", "é", "日本", "🙂", "1", "\x1c", "\x85", " ", "　", "'s", "__", "word", "Wörter,", "<|endoftext|>", "<s>", "<0x0A>", "▁", "internationalisation", "\x00"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(st.characters(exclude_categories=["Cs"]), max_size=40)
ODD = [None, "", " ", "\n", "\n\n a", " x", "x ", "a" * 5000, "ab" * 300, "- " * 2000, "word " * 3000, "x\x00y", "é ‮", "a▁b", "a \nb", "tab\there", "<|endoftext|> and </s>"]


@pytest.fixture(scope="module")
def plain():
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    byte = {c: b for b, c in byte_characters().items()}

    def of(text):
        """Ids of A and B with their byte ranges, or nothing."""
        if not text:
            return [], []
        a = [(i, bytes(byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text))]
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            return [], []
        out = []
        for tokens in (a, b):
            at, ranges = 0, []
            for i, raw in tokens:
                ranges.append((i, at, at + len(raw)))
                at += len(raw)
            out.append(ranges)
        return tuple(out)

    return of


def expected(texts, plain):
    """What the operator must return for each text."""
    docs, held = [], Counter()
    for text in texts:
        a, b = plain(text)
        linked, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            k = j
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    linked.append((i, b[k][0]))
                k += 1
            j = max(0, k - 1)
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, x, y = [], 0, 0
        for end in both:
            p, q = x, y
            while p < len(a) and a[p][2] <= end:
                p += 1
            while q < len(b) and b[q][2] <= end:
                q += 1
            groups.append(",".join(str(t[0]) for t in a[x:p]) + "|" + ",".join(str(t[0]) for t in b[y:q]))
            x, y = p, q
        held.update(set(linked))
        docs.append((len(a), len(b), groups, linked))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [
        (n_a, n_b, len(g), len(ls), sum(held[x] == best[x[0]] for x in ls), sum(held[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, ls in docs
    ]


def test_encodings_equal_the_libraries(plain):
    both = alignment.Both(A, B)

    @settings(max_examples=500, deadline=None)
    @given(TEXT)
    def check(text):
        a, b, _ = both.encode(text)
        want = plain(text)
        assert a.tolist() == [i for i, *_ in want[0]] and b.tolist() == [i for i, *_ in want[1]]

    check()
    for text in ODD:
        assert both.encode(text)[0].tolist() == [i for i, *_ in plain(text)[0]]
        if text:
            assert both.b.encode(text, (units(" " + text) or [None])[1:] or None if units(" " + text) else None) == alignment.pack_ids(both.b.model.encode(text))


@pytest.mark.parametrize("heavy", [1 << 18, 30, 0])
def test_alignment_equals_plain_loops(spark, plain, heavy, monkeypatch):
    texts = ODD + ["The internationalisation of naïve tokenizers.", "Der Wörterbuchverlag druckt Wörter,", "the the the", "the word"] * 3
    rows = [(i if i % 7 else None, t, "c", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_best int, _row int").repartition(3)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align(docs, A, B, heavy=heavy).collect())
    assert got == Counter((r[0], *e) for r, e in zip(rows, expected(texts, plain)))


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema), A, B).count() == 0
    rows = alignment.align(spark.createDataFrame([(1, None), (2, "")], schema), A, B).collect()
    assert {tuple(r) for r in rows} == {(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")}


def test_the_query_against_plain_loops(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: e for d, e in zip(docs, expected([d.text for d in docs], plain))}
