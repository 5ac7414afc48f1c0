"""Language identification by unigrams over pieces, with the segmentation summed out.

Each language has a probability for each piece of a fixed public vocabulary. A word (a run of non-space characters,
lower-cased, behind the mark of a word's beginning) has, in a language, the sum over all its segmentations into pieces of
the products of their probabilities; the forward algorithm gives it without listing them. A text's score is the
sum of the logarithms over its words, and the posterior of the best language under equal priors is the result's score.

The piece probabilities come from expectation-maximisation over the same lattices, on a bounded sample of the labelled
rows (SAMPLE documents a language, whole texts). Scoring covers every text from beginning to end. The forward algorithm rescales
long words at each place, so words of any length have all their segmentations summed. Learning takes long words in stretches.

Defined results: ``und`` with score 0 for null texts and texts without a letter (``str.isalpha``), and for all texts if nothing could be
learned, as from an empty table; null ids are held out; repeated rows come out repeatedly and an empty table gives no rows. The columns
other than the text are not looked at in a prediction, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._fit import held_out, sample_by_class
from pagemill.llm._spark import short_batches
from pagemill.llm._units import forget, trim
from pagemill.llm.token_counts import WORD, read_pieces

UNKNOWN = "und"
#: Documents a language to learn from, at most in expectation; EM steps; smoothing of the piece counts.
SAMPLE, STEPS, SMOOTHING = 300, 3, 0.1
#: Probability of a character that is no piece, in every language.
NO_PIECE = 1e-7
#: Distinct words that a worker remembers the scores of.
KNOWN = 150_000
#: Words of up to LONG characters are scored by plain products, all of one length at once, unless a product falls to TINY; others are rescaled.
LONG, TINY = 32, 1e-290


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PieceTable:
    """The vocabulary as a hash table over numpy arrays: rolling hashes of all stretches of many words meet it at once."""

    BASE, SLOTS = np.uint64(0x9E3779B97F4A7C15), 1 << 20

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        self.keys, self.values = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int64)
        hashes = np.zeros(self.size, np.uint64)
        for places in by_length(pieces):
            codes = code_points("".join(pieces[i] for i in places)).reshape(len(places), -1)
            for k in range(codes.shape[1]):
                hashes[places] = hashes[places] * self.BASE + codes[:, k]
        taken: set[int] = set()
        for i, slot in enumerate(self.slot(hashes).tolist()):
            while slot in taken:
                slot = (slot + 1) % self.SLOTS
            taken.add(slot)
            self.keys[slot], self.values[slot] = hashes[i], i

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids of the pieces with these hashes, -1 where there is none."""
        slot = self.slot(h)
        found = np.where(self.keys[slot] == h, self.values[slot], -1)
        open_ = np.flatnonzero((found < 0) & (self.values[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.SLOTS
            at = slot[open_]
            hit = self.keys[at] == h[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] >= 0)]
        return found


class Lattices:
    """The pieces of words of one length: by place and size, the words that have one ending there, and which."""

    def __init__(self, words: list[str], table: PieceTable):
        self.n, self.length = len(words), len(words[0])
        codes = code_points("".join(words)).reshape(self.n, self.length)
        self.arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.length + 1)]
        h = np.zeros((self.n, self.length + 1), np.uint64)
        for size in range(1, min(self.length, table.longest) + 1):
            h = h[:, :-1] * table.BASE + codes[:, size - 1 :]
            ids = table.find(h.T.reshape(-1)).reshape(h.shape[1], self.n)
            if size == 1:
                ids = np.where(ids < 0, table.size, ids)  # a character that is no piece
            for k in range(h.shape[1]):
                rows = np.flatnonzero(ids[k] >= 0)
                if len(rows):
                    self.arcs[k + size].append((size, rows, ids[k, rows]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Probability of each prefix: place x word x language."""
        alpha = np.zeros((self.length + 1, self.n, p.shape[1]))
        alpha[0] = 1
        for j in range(1, self.length + 1):
            for size, rows, ids in self.arcs[j]:
                alpha[j, rows] += alpha[j - size, rows] * p[ids]
        return alpha

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, given how often each word occurs in each language."""
        alpha, n = self.forward(p), np.zeros_like(p)
        beta = np.zeros_like(alpha)
        beta[-1] = times / np.maximum(alpha[-1], TINY)
        for j in range(self.length, 0, -1):
            for size, rows, ids in self.arcs[j]:
                flow = p[ids] * beta[j, rows]
                uses = alpha[j - size, rows] * flow
                for k in range(p.shape[1]):
                    n[:, k] += np.bincount(ids, uses[:, k], len(n))
                beta[j - size, rows] += flow
        return n


def long_scores(words: list[str], table: PieceTable, p: np.ndarray) -> np.ndarray:
    """Log-probabilities of words of any length: rescaled at each place, and of a word as many places held as the longest piece has."""
    reach, out = table.longest, np.zeros((len(words), p.shape[1]))
    p = np.vstack([p, np.zeros((1, p.shape[1]))])  # for places where no piece ends
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    while order:
        most = len(words[order[0]])
        mine, order = order[: max(1, min(128, 2_000_000 // most))], order[max(1, min(128, 2_000_000 // most)) :]
        lengths = np.array([len(words[i]) for i in mine])
        codes = np.zeros((len(mine), most), np.uint64)
        for row, i in zip(codes, mine):
            row[: len(words[i])] = code_points(words[i])
        total, recent = np.zeros((len(mine), p.shape[1])), np.zeros((reach, len(mine), p.shape[1]))
        recent[0] = 1  # recent[s - 1]: the probability s places back over that of the place before
        for at in range(0, most, 256):
            lead, n = min(at, reach - 1), int((lengths > at).sum())
            part = codes[:n, at - lead : at + 256]
            ids = np.full((part.shape[1] - lead, reach, n), -1)  # the piece of each size that ends at each place
            h = np.zeros((n, part.shape[1] + 1), np.uint64)
            for size in range(1, min(reach, part.shape[1]) + 1):
                h = h[:, :-1] * table.BASE + part[:, size - 1 :]  # of the stretch that begins at each place
                first = max(0, lead + 1 - size)
                ids[first + size - 1 - lead :, size - 1] = table.find(np.ascontiguousarray(h[:, first:]).reshape(-1)).reshape(n, -1).T
            ids[:, 0][ids[:, 0] < 0] = table.size  # a character that is no piece
            for k, pieces in enumerate(ids):
                n = int((lengths > at + k).sum())
                now = (recent[:, :n] * p[pieces[:, :n]]).sum(0)
                total[:n] += np.log(now)
                recent[1:, :n] = recent[:-1, :n] / now
                recent[0, :n] = 1
        out[mine] = total
    return out


def by_length(words: list[str], most: int = 4096) -> Iterator[np.ndarray]:
    """Places of words of one length each, a bounded number at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for places in np.split(order, cuts) if len(words) else ():
        for i in range(0, len(places), most):
            yield places[i : i + most]


def log_scores(words: list[str], table: PieceTable, p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), p.shape[1]))
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for places in by_length([words[i] for i in short]):
        places = [short[i] for i in places]
        found = Lattices([words[i] for i in places], table).forward(p)[-1]
        out[places] = np.log(np.maximum(found, TINY))
        long += [places[k] for k in np.flatnonzero((found <= TINY).any(1))]
    if long:
        out[long] = long_scores([words[i] for i in long], table, p)
    return out


def with_fallback(p: np.ndarray) -> np.ndarray:
    """Probabilities with one more row, for a character that is no piece."""
    return np.vstack([p, np.full((1, p.shape[1]), NO_PIECE)])


def vocabulary(path: str) -> PieceTable:
    return PieceTable([p for p in dict.fromkeys(read_pieces(path)) if p])


def learn(texts: list[tuple[str, str]], path: str, steps: int = STEPS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """The languages of (language, text) pairs, and piece x language probabilities."""
    languages = sorted({lang for lang, _ in texts})
    table = vocabulary(path)
    counts = {lang: Counter() for lang in languages}
    for lang, text in texts:
        counts[lang].update(text.lower().split())
    times: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        for word, n in counts[lang].items():
            for i in range(0, len(word) + 1, LONG):
                times.setdefault((WORD + word)[i : i + LONG], np.zeros(len(languages)))[k] += n
    words = sorted(times)
    lattices = [(Lattices([words[i] for i in places], table), np.array([times[words[i]] for i in places])) for places in by_length(words)]
    p = np.full((table.size, len(languages)), 1 / table.size)
    for _ in range(steps):
        n = sum(lattice.expected(with_fallback(p), uses) for lattice, uses in lattices)[:-1] + smoothing if lattices else p
        p = n / n.sum(0)
    return languages, p


class WordScores:
    """Rows of a table of log-probabilities by word; a bounded number of words is remembered."""

    def __init__(self, path: str, p: np.ndarray):
        self.pieces, self.p = vocabulary(path), with_fallback(p)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((KNOWN, self.p.shape[1]))

    def add(self, words: set[str]) -> None:
        new = [*words.difference(self.rows)]
        if len(self.rows) + len(new) > len(self.table):
            self.clear()
            new = [*words]
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.p.shape[1]))
        at = len(self.rows)
        self.table[at : at + len(new)] = log_scores([WORD + w for w in new], self.pieces, self.p)
        self.rows.update(zip(new, range(at, at + len(new))))

    def totals(self, texts: list[str]) -> np.ndarray:
        """Text x language. Words meet the table a bounded number at a time."""
        out = np.zeros((len(texts), self.p.shape[1]))
        held: list[tuple[int, list[str]]] = []
        count = 0
        for i, text in enumerate(texts):
            words = text.lower().split()
            for k in range(0, len(words), 100_000):
                held.append((i, words[k : k + 100_000]))
                count += len(held[-1][1])
                if count > 100_000:
                    self._flush(held, out)
                    held, count = [], 0
        self._flush(held, out)
        return out

    def _flush(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        self.add(set().union(*(words for _, words in held)))
        for i, words in held:
            out[i] += self.table[[*map(self.rows.__getitem__, words)]].sum(0)


def _predict(texts: Iterator[pa.Array], path: str, languages: list[str], p: np.ndarray) -> Iterator[pa.Array]:
    forget()
    scorer = WordScores(path, p)
    for column in texts:
        langs, scores = [], []
        for i in range(0, len(column), 512):
            part = [t or "" for t in column.slice(i, 512).to_pylist()]
            totals = scorer.totals(part)
            post = np.exp(totals - totals.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            for t, best, row in zip(part, post.argmax(1).tolist(), post):
                found = t.isalpha() or any(map(str.isalpha, t))
                langs.append(languages[best] if found else UNKNOWN)
                scores.append(float(row[best]) if found else 0.0)
        yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
    del scorer
    trim()


def fit(docs: DataFrame, path: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Piece probabilities from the rows of ``docs(doc_id, text, lang)`` that are not held out and have a language."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), "lang", "text")
    return learn(sorted((r.lang, r.text) for r in sample_by_class(rows, "lang", sample).select("lang", "text").collect()), path)


def language_of(text: Column, model: tuple[list[str], np.ndarray], path: str) -> Column:
    """A struct of the predicted language (lang) and its score for a column of texts; only the texts go to Python."""
    languages, p = model
    if not languages:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))

    @F.arrow_udf("lang string, score double")
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _predict(texts, path, languages, p)

    return language(text)


def identify_language(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, lang_pred and score."""
    short_batches(docs.sparkSession)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_of(F.col("text"), model, path).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify_language(docs, fit(docs, path), path)
