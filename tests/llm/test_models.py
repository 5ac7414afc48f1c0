"""The two classifiers: the forward algorithm against all segmentations, gradients, held-out accuracy, odd rows."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P

from pagemill.llm import language_id as li
from pagemill.llm import toxicity as tox

PATH = P.path("piece_bpe_32k.model")


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    table = li.PieceTable(pieces)
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces), 2)) / 4
    for words in (["▁abab", "▁bbaa", "▁abxa"], ["▁"], ["▁aba"]):
        got = np.exp(li.log_scores(words, table, li.with_fallback(p)))
        assert np.allclose(got, np.exp(li.long_scores(words, table, li.with_fallback(p))))
        for word, row in zip(words, got):
            total = np.zeros(2)
            for parts in segmentations(word):
                if all(x in pieces or len(x) == 1 for x in parts):
                    total += np.prod([p[pieces.index(x)] if x in pieces else np.full(2, li.NO_PIECE) for x in parts], axis=0)
            assert np.allclose(row, total)


def plain_score(word, table_pieces, p):
    """By plain dynamic programming over all segmentations, in logarithms."""
    at = [np.zeros(p.shape[1])]
    for j in range(1, len(word) + 1):
        found = [at[j - s] + np.log(p[table_pieces[word[j - s : j]]]) for s in range(1, min(j, 20) + 1) if word[j - s : j] in table_pieces]
        if word[j - 1] not in table_pieces:
            found.append(at[j - 1] + np.log(li.NO_PIECE))
        at.append(np.logaddexp.reduce(found, axis=0))
    return at[-1]


def test_long_words_have_all_segmentations_summed():
    pieces = ["a", "b", "ab", "ba", "abab", "b" * 20, "日", "日本", "▁"]
    table, rng = li.PieceTable(pieces), np.random.default_rng(4)
    p = li.with_fallback(rng.random((len(pieces), 3)) / 8)
    places = {x: i for i, x in enumerate(pieces)}
    words = ["▁" + "".join(rng.choice(list("abab日本c"), n)) for n in (1, 31, 32, 33, 255, 256, 500, 500, 9000)]
    assert np.allclose(li.log_scores(words, table, p), [plain_score(w, places, p) for w in words])
    assert np.allclose(li.log_scores(["a" * 28], table, p * 1e-12), plain_score("a" * 28, places, p * 1e-12))  # falls below TINY


def test_texts_without_letters_are_unknown(spark):
    model = li.learn([(k, " ".join(v)) for k, v in SPOKEN.items()], PATH)
    odd = spark.createDataFrame([(1, "½"), (2, "² ①"), (3, "12 _"), (4, "½ der"), (5, "日本")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in li.identify_language(odd, model, PATH).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == ("de", True) and got[5][0] != "und"


def test_language_against_plain_scores(spark):
    rows, docs = documents(spark)
    languages, p = model = li.fit(docs, PATH)
    pieces = {x: i for i, x in enumerate(x for x in dict.fromkeys(li.read_pieces(PATH)) if x)}
    got = {r.doc_id: r for r in li.identify_language(docs, model, PATH).collect()}
    for i, text, *_ in rows[:40]:
        totals = sum(plain_score(li.WORD + w, pieces, li.with_fallback(p)) for w in text.lower().split())
        post = np.exp(totals - np.logaddexp.reduce(totals))
        assert got[i].lang_pred == languages[post.argmax()] and abs(got[i].score - post.max()) < 1e-9


def test_expected_counts_add_up():
    table = li.PieceTable(["a", "b", "ab", "▁"])
    p = li.with_fallback(np.full((4, 1), 0.2))
    lattice = li.Lattices(["▁abab"], table)
    n = lattice.expected(p, np.array([[3.0]]))
    assert np.isclose(n[3, 0], 3) and np.isclose(n[0, 0] + n[2, 0], 6) and np.isclose(n[1, 0] + n[2, 0], 6)


SPOKEN = {"en": "the of and to in is that it was for on are with as his they at be this from".split(), "de": "der die und das von zu den mit ist des im dem nicht ein auf auch für sich".split()}


def written(rng, lang, n=30):
    return " ".join(rng.choice(SPOKEN[lang]) for _ in range(n))


def documents(spark, n=120):
    rng = random.Random(3)
    rows = [(i, written(rng, "de" if i % 3 else "en") + (" idioten" if i % 4 == 0 else ""), "de" if i % 3 else "en", "x", 0.5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)


def test_language(spark):
    rows, docs = documents(spark)
    model = li.fit(docs, PATH)
    got = {r.doc_id: r for r in li.identify_language(docs, model, PATH).collect()}
    assert all(got[r[0]].lang_pred == r[2] and 0.5 <= got[r[0]].score <= 1 for r in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "123 ..."), (3, "der " * 60_000), (4, "x" * 3000), (4, "x" * 3000)], "doc_id long, text string")
    rows = li.identify_language(odd, model, PATH).collect()
    assert sorted(r.lang_pred for r in rows)[-3:] == ["und"] * 3 and len(rows) == 6
    assert li.identify_language(odd.limit(0), model, PATH).count() == 0
    assert {r.lang_pred for r in li.identify_language(odd, li.fit(docs.limit(0), PATH), PATH).collect()} == {"und"}


def test_word_table_forgets_and_agrees(monkeypatch):
    model = li.learn([(k, " ".join(v)) for k, v in SPOKEN.items()], PATH)
    texts = ["der die das " * 5, "the of and", "long" * 50 + " der", ""]
    want = li.WordScores(PATH, model[1]).totals(texts)
    monkeypatch.setattr(li, "KNOWN", 3)
    assert np.allclose(li.WordScores(PATH, model[1]).totals(texts), want)


def test_gradients():
    rng = np.random.default_rng(1)
    model = tox.Model(rng.normal(size=(50, tox.DIM)), rng.normal(size=(tox.DIM, tox.SHARES)), rng.normal(size=24), rng.normal(size=24), 0.1, np.zeros((50, 1)))
    model.embed[0] = 0
    docs = [rng.integers(1, 50, (n, 3)) for n in (1, 4, 9)]
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        words, starts = tox.laid_out(docs)
        z = model.logit(np.maximum.reduceat(model.convolved(model.embed[words].sum(1) @ model.filters), starts))
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))) + 0.5e-4 * ((model.filters**2).sum() + (model.dense**2).sum()))

    (g_embed, g_filters, g_bias, g_dense), touched, g_offset = tox.gradients(model, docs, y, w)
    for array, grad, places in ((model.embed[None], g_embed, None), (model.filters, g_filters, (2, 5)), (model.bias, g_bias, (3,)), (model.dense, g_dense, (7,))):
        if places is None:
            array, at, grad = model.embed, (touched[1], 1), g_embed[1, 1]
        else:
            at, grad = places, grad[places]
        base = array[at]
        array[at] = base + 1e-6
        up = loss()
        array[at] = base - 1e-6
        down = loss()
        array[at] = base
        assert abs((up - down) / 2e-6 - grad) < 1e-4


def test_toxicity(spark):
    rows, docs = documents(spark, 400)
    labels = spark.createDataFrame([(r[0], int("idiot" in r[1])) for r in rows], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    got = {r.doc_id: r for r in tox.toxicity(docs, model).collect()}
    assert np.mean([got[r[0]].predicted == ("idiot" in r[1]) for r in rows if got[r[0]].held_out]) >= 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "der " * 120_000 + "Idiotisch!"), (3, "x" * 5000), (3, "x" * 5000)], "doc_id long, text string")
    found = tox.toxicity(odd, model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found) and [r.predicted for r in found if r.doc_id == 2] == [1]
    assert tox.toxicity(odd.limit(0), model).count() == 0
    none = tox.toxicity(odd, tox.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.0}


def test_long_texts_are_scored_as_one():
    rng = np.random.default_rng(2)
    words = ["w%d" % i for i in range(40)]
    docs = [(int(i % 2), "en", np.array([tox.features(w) for w in rng.choice(words[: 39 + i % 2], 30)])) for i in range(60)]
    scorer = tox.Scorer(tox.train(docs))
    text = " ".join(rng.choice(words, 120_000))
    model = scorer.model
    whole, _ = tox.measured(model, [np.array([tox.features(w) for w in text.split()])])
    assert abs(scorer.score(text) - 1 / (1 + np.exp(-(whole[0] - model.thresholds[0])))) < 1e-4


def test_what_a_worker_holds_is_bounded(monkeypatch):
    """What an earlier operator built goes before scoring, and words are forgotten without a change of scores."""
    import pyarrow as pa

    from pagemill.llm import _units

    model = tox.train([(i % 2, "en", np.array([tox.features(w) for w in ("good", "bad")[i % 2 :]])) for i in range(60)])
    texts = [f"bad good w{i} " + " ".join(f"w{k}" for k in range(i, i + 200)) for i in range(300)]
    made = []
    monkeypatch.setattr(tox, "Scorer", lambda m, make=tox.Scorer: made.append(make(m)) or made[-1])
    _units.once("earlier", lambda: "table")
    usual = [x for c in tox._score(iter([pa.array(texts)]), model) for x in c.to_pylist()]
    assert not _units._KEPT and len(made[0].table) <= 50_000
    monkeypatch.setattr(tox, "KNOWN", 400)
    few = [x for c in tox._score(iter([pa.array(texts)]), model) for x in c.to_pylist()]
    assert np.allclose(usual, few, atol=1e-6) and len(made[1].rows) <= 501


def test_every_row_is_learned_from_once_an_epoch(monkeypatch):
    docs = [(i % 2, "en", np.array([tox.features(f"w{i}")])) for i in range(400)]
    plain, batches = tox.gradients, []
    monkeypatch.setattr(tox, "gradients", lambda model, rows, y, w: batches.append([id(r) for r in rows]) or plain(model, rows, y, w))
    tox.train(docs)
    an_epoch = 320 // tox.BATCH  # a fifth calibrates
    epochs = [sum(batches[i : i + an_epoch], []) for i in range(0, len(batches), an_epoch)]
    assert len(epochs[0]) == 320 and all(sorted(e) == sorted({*epochs[0]}) for e in epochs)
