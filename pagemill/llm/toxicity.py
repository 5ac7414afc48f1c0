"""Toxicity by a convolutional text classifier trained in numpy.

A word is lower-cased, stripped of punctuation and embedded as the sum of hashed embeddings of itself and of its
beginnings of four and five characters, so inflected words share what was learned. Filters of width 1, 2 and 3
slide over the words, max pooling keeps each filter's strongest answer in the whole text, and a dense layer gives a
logit. Since filters are linear before pooling, a worker computes a distinct word's share in every filter once.

Training is on a bounded sample of labelled rows (SAMPLE a label, whole texts, each distinct text once). The first
dimension of the embeddings starts at the smoothed log-odds of the feature between the labels; then all
parameters are trained by Adam on the logistic loss. Part of the sample calibrates a threshold for each language: the language is
guessed from the text by hashed unigrams learned from the same sample, the threshold separates the labels best there,
and the score is the logistic function of the logit above the threshold, so 0.5 is the cut in every language.

Defined results: null texts are scored as empty; with no labelled rows, or of one label only, every score is the
share of label 1 (0 without rows); null ids are held out; repeated rows come out repeatedly and an empty table gives no rows.
Whole texts are scored, whatever their length. Columns other than the text are not looked at in a score, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._fit import held_out, sample_by_class
from pagemill.llm._spark import short_batches
from pagemill.llm._units import forget, trim

#: Labelled documents to learn from, of each label, at most in expectation.
SAMPLE = 2500
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, BATCH, STEP = 6, 64, 0.01
#: Words that a worker remembers, and texts that are taken apart at once: they bound its memory and change no score.
KNOWN, TEXTS = 50_000, 128
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’‘…¡¿–—"
SHARES = sum(WIDTHS) * FILTERS


def features(word: str) -> tuple[int, int, int]:
    """Buckets of a word and of its beginnings; bucket 0 is no feature."""
    word = word.lower().strip(EDGE)
    return tuple(zlib.crc32(f"{k}{x}".encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 if len(x) > k else 0 for k, x in enumerate((word, word[:4], word[:5])))


@dataclass
class Model:
    embed: np.ndarray
    filters: np.ndarray  # DIM x SHARES: for each width and place in it, FILTERS columns
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    languages: np.ndarray  # buckets x languages, log-probabilities
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    constant: float | None = None

    def shares(self, feats: np.ndarray) -> np.ndarray:
        """What each word adds to the filters, by width and place, and to the languages."""
        return np.hstack([self.embed[feats].sum(1) @ self.filters, self.languages[feats].mean(1)]).astype(np.float32)

    def convolved(self, shares: np.ndarray) -> np.ndarray:
        """Place x filter; ``shares`` must end with as many zero rows as the widest filter reaches."""
        out, at = [], 0
        for width in WIDTHS:
            total = shares[:, at : at + FILTERS].copy()
            for o in range(1, width):
                total[:-o] += shares[o:, at + o * FILTERS : at + (o + 1) * FILTERS]
            out.append(total)
            at += width * FILTERS
        return np.hstack(out)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.offset

    def score(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[languages], -60, 60)))


def unlearned(share: float) -> Model:
    return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, SHARES), np.float32), np.zeros(len(WIDTHS) * FILTERS), np.zeros(len(WIDTHS) * FILTERS), 0.0, np.zeros((BUCKETS, 1), np.float32), constant=share)


def train(texts: list[tuple[int, str, np.ndarray]], seed: int = 7) -> Model:
    """A model from (label, language, word x feature) triples; both labels must occur."""
    rng = np.random.default_rng(seed)
    y = np.array([t[0] for t in texts], float)
    names = sorted({t[1] for t in texts})
    lang = np.array([names.index(t[1]) for t in texts])
    docs = [t[2] for t in texts]

    seen = np.zeros((BUCKETS, 2))
    spoken = np.zeros((BUCKETS, len(names)))
    for label, k, d in zip(y.astype(int), lang, docs):
        seen[np.unique(d), label] += 1
        np.add.at(spoken[:, k], d[:, 0], 1)
        np.add.at(spoken[:, k], d[:, 1], 1)
    sizes = np.array([(y == 0).sum(), (y == 1).sum()], float)
    seen *= sizes.min() / sizes
    odds = np.log((seen[:, 1] + 1) / (seen[:, 0] + 1))
    odds[0] = 0
    spoken[0] = 0
    languages = np.log((spoken + 0.5) / (spoken.sum(0) + 0.5 * BUCKETS))
    languages -= languages.mean(1, keepdims=True)

    model = Model(
        rng.normal(0, 0.02, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, SHARES)),
        np.full(len(WIDTHS) * FILTERS, -0.5), rng.normal(0, 0.1, len(WIDTHS) * FILTERS), 0.0, languages,
    )
    model.embed[:, 0] = odds
    model.embed[0] = 0
    at = 0
    for w, width in enumerate(WIDTHS):  # half of the filters of each width begin as detectors of odds
        for o in range(width):
            model.filters[0, at + o * FILTERS : at + o * FILTERS + FILTERS // 2] = 0.5 / width
        model.dense[w * FILTERS : w * FILTERS + FILTERS // 2] = 0.4
        at += width * FILTERS

    order = rng.permutation(len(docs))
    check = np.zeros(len(docs), bool)
    check[order[: len(docs) // 5]] = True
    if len({*y[~check]}) < 2 or len({*y[check]}) < 2:
        check[:] = False
    learn = np.flatnonzero(~check)
    weight = np.where(y == 1, len(learn) / max(1, 2 * (y[learn] == 1).sum()), len(learn) / max(1, 2 * (y[learn] == 0).sum()))
    params = [model.embed, model.filters, model.bias, model.dense]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    offset_moment = [0.0, 0.0]
    t = 0
    epochs = max(EPOCHS, min(40, 6000 // max(1, len(learn))))
    for _ in range(epochs):
        rng.shuffle(learn)  # every row once an epoch, in a new order
        for i in range(0, len(learn), BATCH):
            t += 1
            part = learn[i : i + BATCH]
            grads, touched, g_offset = gradients(model, [docs[k] for k in part], y[part], weight[part])
            scale = STEP * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            for k, (p, g, (m, v)) in enumerate(zip(params, grads, moments)):
                rows = touched if k == 0 else slice(None)
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.999 * v[rows] + 0.001 * g * g
                p[rows] -= scale * (0.2 if k == 0 else 1) * m[rows] / (np.sqrt(v[rows]) + 1e-8)
            model.embed[0] = 0
            offset_moment = [0.9 * offset_moment[0] + 0.1 * g_offset, 0.999 * offset_moment[1] + 0.001 * g_offset**2]
            model.offset -= scale * offset_moment[0] / (offset_moment[1] ** 0.5 + 1e-8)

    model.embed, model.languages = model.embed.astype(np.float32), model.languages.astype(np.float32)
    model.thresholds = np.zeros(len(names))
    used = np.flatnonzero(check) if check.any() else learn
    logits, guessed = measured(model, [docs[k] for k in used])
    overall = best_threshold(logits, y[used], 0.0)
    for k in range(len(names)):
        model.thresholds[k] = best_threshold(logits[guessed == k], y[used][guessed == k], overall)
    return model


def best_threshold(logits: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the gap with the greatest balanced accuracy; the default where one label has under five cases."""
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return default
    order = np.argsort(logits)
    x, z = logits[order], y[order]
    above = np.concatenate([[z.sum()], z.sum() - np.cumsum(z)]) / z.sum()
    below = np.concatenate([[0], np.cumsum(1 - z)]) / (1 - z).sum()
    gain = above + below
    top = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    width = np.concatenate([[0], x[1:] - x[:-1], [0]])
    return float(edges[top[width[top].argmax()]])


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one behind the other with empty words between them, and where each begins."""
    gap = np.zeros((max(WIDTHS) - 1, 3), np.int64)
    parts = [x for d in docs for x in (d if len(d) else gap[:1], gap)]
    return np.concatenate(parts), np.cumsum([0, *(max(1, len(d)) + len(gap) for d in docs[:-1])])


def measured(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    logits, langs = [], []
    for i in range(0, len(docs), BATCH):
        words, starts = laid_out(docs[i : i + BATCH])
        shares = model.shares(words)
        logits.append(model.logit(np.maximum.reduceat(model.convolved(shares[:, :SHARES]), starts)))
        langs.append(np.add.reduceat(shares[:, SHARES:], starts).argmax(1))
    return np.concatenate(logits), np.concatenate(langs)


def gradients(model: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted logistic loss; those of the embeddings only for the buckets that pooling chose."""
    words, starts = laid_out(docs)
    kinds, back = np.unique(words, axis=0, return_inverse=True)
    vectors = model.embed[kinds].sum(1)
    shares = (vectors @ model.filters)[back.reshape(-1)]
    conv = model.convolved(shares)
    ends = [*starts[1:], len(conv)]
    best = np.array([a + conv[a:b].argmax(0) for a, b in zip(starts, ends)])
    pooled = np.take_along_axis(conv, best, 0) + model.bias
    active = np.maximum(pooled, 0)
    z = active @ model.dense + model.offset
    d = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(docs)
    back_pool = d[:, None] * model.dense * (pooled > 0)
    g_filters = np.zeros_like(model.filters)
    rows, grads = [], []
    at = 0
    for w, width in enumerate(WIDTHS):
        cols = slice(w * FILTERS, (w + 1) * FILTERS)
        for o in range(width):
            which = back.reshape(-1)[np.minimum(best[:, cols] + o, len(words) - 1)]
            place = slice(at + o * FILTERS, at + (o + 1) * FILTERS)
            g = back_pool[:, cols]
            g_filters[:, place] = np.einsum("bf,bfd->df", g, vectors[which])
            rows.append(which.reshape(-1))
            grads.append((g[:, :, None] * model.filters[:, place].T).reshape(-1, DIM))
        at += width * FILTERS
    rows, grads = kinds[np.concatenate(rows)], np.concatenate(grads)
    touched, inverse = np.unique(rows, return_inverse=True)
    g_embed = np.zeros((len(touched), DIM))
    for k in range(rows.shape[1]):
        np.add.at(g_embed, inverse.reshape(rows.shape)[:, k], grads)
    return [g_embed, g_filters + 1e-4 * model.filters, back_pool.sum(0), active.T @ d + 1e-4 * model.dense], touched, d.sum()


class Scorer:
    """A worker's table of word shares; a bounded number of words is remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.table = np.zeros((KNOWN, SHARES + self.model.languages.shape[1]), np.float32)

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > len(self.table):
            self.clear()
            new = list(words)
            if len(new) + 1 > len(self.table):
                self.table = np.zeros((len(new) + 1, self.table.shape[1]), np.float32)
        for i in range(0, len(new), 8192):
            part, at = new[i : i + 8192], len(self.rows)
            self.table[at : at + len(part)] = self.model.shares(np.array([features(w) for w in part], np.int64))
            self.rows.update(zip(part, range(at, at + len(part))))

    def index(self, words: list[str]) -> list[int]:
        return [*map(self.rows.__getitem__, words)]

    def score(self, text: str) -> float:
        """Stretch by stretch for very long texts, each reaching into the next as far as the filters do."""
        model, reach = self.model, max(WIDTHS) - 1
        words = text.split()
        pooled, spoken = np.full(len(WIDTHS) * FILTERS, -np.inf), 0.0
        for i in range(0, max(1, len(words)), 50_000):
            part = words[i : i + 50_000 + reach]
            try:
                rows = self.index(part)
            except KeyError:
                self.add(set(part))
                rows = self.index(part)
            own = min(len(part), 50_000)
            shares = self.table[[*rows, *[0] * (reach + (not rows))]]
            pooled = np.maximum(pooled, model.convolved(shares[:, :SHARES])[: max(1, own)].max(0))
            spoken = spoken + shares[:own, SHARES:].sum(0)
        return float(model.score(model.logit(pooled), int(spoken.argmax())))


def _score(texts: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    forget()
    scorer = Scorer(model)
    for column in texts:
        scores = []
        for i in range(0, len(column), TEXTS):
            part = [t or "" for t in column.slice(i, TEXTS).to_pylist()]
            if sum(map(len, part)) < 4_000_000:
                scorer.add({w for t in part for w in t.split()})
            scores += [scorer.score(t) for t in part]
        yield pa.array(scores, pa.float64())
    del scorer
    trim()


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats = [np.array([features(w) for w in (t or "").split()], np.int32).reshape(-1).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.binary())], ["label", "lang", "feats"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of ``docs(doc_id, text, lang)`` that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label"))
    # the labels of the sample alone, at most about two times `sample` rows, meet the documents
    chosen = sample_by_class(known, "label", sample)
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").alias("_text")).join(F.broadcast(chosen), "_id")
    found = sorted({(r.label, r.lang, bytes(r.feats)) for r in rows.select("label", "lang", "_text").mapInArrow(_featurise, "label int, lang string, feats binary").collect()})
    if len({r[0] for r in found}) < 2:
        return unlearned(float(found[0][0]) if found else 0.0)
    return train([(label, lang, np.frombuffer(feats, np.int32).reshape(-1, 3).astype(np.int64)) for label, lang, feats in found])


def score_of(text: Column, model: Model) -> Column:
    """The score of a column of texts; only the texts go to Python."""
    if model.constant is not None:
        return F.lit(model.constant)

    @F.arrow_udf("double")
    def toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _score(texts, model)

    return toxic(text)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, score and predicted."""
    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
