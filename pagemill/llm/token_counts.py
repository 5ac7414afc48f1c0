"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a run of non-space characters behind the mark of a word's beginning. Its tokens are those of its
segmentation into vocabulary pieces with the highest sum of scores; at equal sums the one with fewer tokens. The
score of a piece is the logarithm of a Zipf probability by its place in the vocabulary, ln 1 / ((id + 1) H), H being the
harmonic number of the vocabulary's size. A character that is no piece falls back to one token for each of its bytes,
each at FALLBACK.

The best score of a prefix does not depend on what follows, so it sits at the prefix's trie node and is computed once,
however many pre-tokens share it; the node where a pre-token ends stores its count. Each worker has a trie of a
bounded number of nodes, which begins anew when it is full: that changes speed, not counts.

Defined results: null and empty texts and texts of white space have no tokens; null ids stay null, repeated rows come out repeatedly
and an empty table gives no rows; a token of any length takes memory for the piece of it that is looked at. Columns other than id
and text are not looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._spark import short_batches
from pagemill.llm._units import Cache, once

WORD = "▁"
FALLBACK = -30.0
NODES = 500_000


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    import math

    total = sum(1 / (i + 1) for i in range(len(pieces)))
    return {p: -math.log((i + 1) * total) for i, p in enumerate(pieces) if p}


def read_pieces(path: str) -> list[str]:
    """The pieces by id; control, unknown and byte pieces come out empty, as they match no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return ["" if special(i) else m.id_to_piece(i) for i in range(m.get_piece_size())]


class Trie:
    """Forward scores and counts by prefix. A node is an entry of the lists; edges are one dict from (node, character).

    ``nodes`` bounds the trie: what a token needs beyond it is computed and not stored, so one long token cannot make it grow.
    """

    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.scores, self.nodes = scores, nodes
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, token: str) -> int:
        """The number of tokens of ``token``; only prefixes that are new are computed."""
        if len(self.best) >= self.nodes:
            self.clear()
        # score and count of the last prefixes, as many as a piece can reach back over, the latest at the end
        recent: deque[tuple[float, int]] = deque([(0.0, 0)], self.longest)
        edges, best, count, scores, node = self.edges, self.best, self.count, self.scores, 0
        for d, c in enumerate(token, 1):
            edge = -1 if node is None else node << 21 | ord(c)
            found = edges.get(edge)
            if found is not None:
                node = found
                recent.append((best[node], count[node]))
                continue
            n = len(c.encode("utf-8", "surrogatepass"))
            s, k = recent[-1]
            top = (s + n * FALLBACK, -k - n) if c not in scores else (-1e300, 0)
            for size in range(1, len(recent) + 1):
                score = scores.get(token[d - size : d])
                if score is not None:
                    s, k = recent[-size]
                    top = max(top, (s + score, -k - 1))
            recent.append((top[0], -top[1]))
            if node is None or len(best) >= self.nodes:
                node = None  # full: the rest of this token is not stored
                continue
            node = edges[edge] = len(best)
            best.append(top[0])
            count.append(-top[1])
        return recent[-1][1]


class Counts:
    """A worker's trie, and the counts of words looked up in it."""

    def __init__(self, path: str):
        trie = Trie(zipf_scores(read_pieces(path)))
        self.of = Cache(lambda word: trie.insert(WORD + word)).__getitem__


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counts = once(("counts", path), lambda: Counts(path))
    for batch in batches:
        words, tokens = [], []
        for text in batch.column(1).to_pylist():
            split = (text or "").split()
            words.append(len(split))
            tokens.append(sum(map(counts.of, split)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row with n_words (its pre-tokens) and n_tokens."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(partial(_count, path=path), f"_id {kind}, n_words long, n_tokens long").withColumnRenamed("_id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("piece_bpe_32k.model"))
