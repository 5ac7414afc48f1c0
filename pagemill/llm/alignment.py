"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

A space and the text are encoded by a byte-level vocabulary (A), the text alone by a vocabulary of pieces that puts the
space before it itself (B). Each byte has an owner in either: np.repeat of token numbers over token lengths makes two arrays of owners,
of many documents at once. Where the pair of owners changes, a link begins: tokens whose bytes overlap. Where both owners change at once
is a cut, and between cuts lie the groups. No pair of tokens is looked at that does not overlap.

How many documents hold a pair of ids linked is counted over the whole corpus, from each document's distinct pairs, with partial sums.
The counts come back in two ways, by one rule at every size. The most frequent pairs, whole classes of frequency and HEAVY pairs at
most, go to every task as sorted arrays; the other pairs are joined by a shuffle. No pair among these is frequent, so the shuffle has no
hot key. The highest count of each A id is a row for each entry of A's vocabulary at most.

Both encodings are put together from units that are remembered, as no token of either reaches over a unit's end. Texts with two
white-space characters in a row go to A's library whole, and are cut at single spaces with all that come before a word for B.

Defined results: a text that is null or empty, or that the tokens of A or B don't spell out with the space before it (one that holds
U+2581 itself), has no tokens: all numbers are 0 and groups_sha256 is ''. Strings of special tokens are plain text. Null ids stay null and
repeated rows come out repeatedly, each counting as a document; an empty table gives no rows. A very long text is aligned in one task, with
some 40 bytes of memory for each of its own. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch, short_batches
from pagemill.llm._units import Cache, once, pack_ids, units
from pagemill.llm.packing import ByteLevel

#: Bytes of text that are aligned together; a longer text is aligned alone.
BYTES = 1 << 20
#: Units that a worker remembers the pieces of in each of two generations.
UNITS = 200_000
#: Pairs of ids at most that every task gets the counts of: 12 bytes each.
HEAVY = 1 << 18
#: Classes of frequency to a doubling of it.
CLASSES = 8

FACTS = ["n_a", "n_b", "n_groups", "n_links"]


class Pieces:
    """Ids of a sentencepiece model with a space put before the text, as 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # without such pieces nothing is merged over the end of a word
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces) and not any("\n" in p for p in pieces)
        self.space = pack_ids([m.piece_to_id("▁")])
        self.known = Cache(self._unit, UNITS)

    def _behind_space(self, unit: str) -> bytes:
        return pack_ids(self.model.encode(unit)) if unit else self.space

    def _unit(self, unit: str) -> bytes:
        """A unit that begins with a newline follows no space, so the one that the model puts before it goes."""
        return pack_ids(self.model.encode(unit)[1:]) if unit[:1] == "\n" else self._behind_space(unit)

    def encode(self, text: str, cut: list[str] | None) -> bytes:
        """``cut``: the units of the text behind its space, if it has them."""
        if not self.by_word:
            return pack_ids(self.model.encode(text))
        if cut is not None:
            return b"".join(map(self.known.__getitem__, cut))
        words = [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        return b"".join([self._behind_space(w) if w[:1] == "\n" else self.known[w] for w in words])


class Both:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.a.special, self.a.whole.encode_special_tokens = [], True
        vocab = self.a.whole.get_vocab()
        byte = {c: b for b, c in self.a.char.items()}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            # an added token's string is not spelled in bytes; encoding never gives it
            self.bytes_a[i] = bytes(byte[c] for c in token) if set(token) <= byte.keys() else token.encode()
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int32) for t in (self.bytes_a, self.b.bytes))
        # a token's decimal id with what follows it: another of its side, the other side, the next group
        a, b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.b.bytes))
        self.names = [*(x + "," for x in a), *(x + "|" for x in a), *(x + "," for x in b), *(x + ";" for x in b)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of A and B and the number of bytes they cover; none where either does not spell the text."""
        if text:
            spaced = " " + text
            cut = units(spaced)
            if cut is None:
                a = self.a.encode(spaced)
            else:
                cut = cut[1:]
                a = b"".join(map(self.a.known.__getitem__, cut))
            a, b = np.frombuffer(a, "<u4"), np.frombuffer(self.b.encode(text, cut), "<u4")
            whole = spaced.encode()
            if whole == b"".join(map(self.bytes_a.__getitem__, a.tolist())) == b"".join(map(self.b.bytes.__getitem__, b.tolist())):
                return a, b, len(whole)
        none = np.zeros(0, "<u4")
        return none, none, 0


def links(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of A and of B for each link, in order, and the number of its group. Sizes are in bytes, with equal sums."""
    owner_a = np.repeat(np.arange(len(size_a), dtype=np.int32), size_a)
    owner_b = np.repeat(np.arange(len(size_b), dtype=np.int32), size_b)
    if not len(owner_a):
        return owner_a, owner_b, owner_a
    changes = (owner_a[1:] != owner_a[:-1]) | (owner_b[1:] != owner_b[:-1])
    starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
    a, b = owner_a[starts], owner_b[starts]
    cuts = (a[1:] != a[:-1]) & (b[1:] != b[:-1])
    return a, b, np.concatenate([[0], np.cumsum(cuts)])


def groups_text(both: Both, ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> list[str]:
    """Each token's id with what follows it, in the order of groups, A's before B's. ``of_a``, ``of_b``: group numbers of tokens."""
    n_a, n_b, n = len(both.bytes_a), len(both.b.bytes), (int(of_a[-1]) + 1 if len(of_a) else 0)
    ends_a, starts_b = np.searchsorted(of_a, np.arange(n), side="right"), np.searchsorted(of_b, np.arange(n))
    out = np.empty(len(ids_a) + len(ids_b), np.int64)
    last = lambda of: np.append(of[1:] != of[:-1], True)[: len(of)]
    out[np.arange(len(ids_a)) + starts_b[of_a]] = ids_a + n_a * last(of_a)
    out[np.arange(len(ids_b)) + ends_a[of_b]] = 2 * n_a + ids_b + n_b * last(of_b)
    return list(map(both.names.__getitem__, out.tolist()))


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, wide: bool) -> Iterator[pa.RecordBatch]:
    """Each row with its numbers, the digest of its groups, its distinct pairs and how often each is linked."""
    from pyspark import TaskContext

    both = once(("both", path_a, path_b), lambda: Both(path_a, path_b))
    row, code = TaskContext.get().partitionId() << 40, np.int64 if wide else np.int32
    n_b = len(both.b.bytes)

    def together(part: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        nonlocal row
        docs = np.arange(len(found))
        a, b = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
        len_a, len_b = (np.array([len(f[k]) for f in found]) for k in (0, 1))
        link_a, link_b, group = links(both.size_a[a], both.size_b[b])
        first = lambda x: np.flatnonzero(np.diff(x, prepend=-1))
        doc = np.repeat(docs, len_a)[link_a]  # texts end with a cut
        items = groups_text(both, a, b, group[first(link_a)], group[first(link_b)])
        ends = np.cumsum(len_a + len_b).tolist()
        digests = [hashlib.sha256("".join(items[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip([0, *ends], ends)]
        pairs, times = np.unique(doc * (len(both.bytes_a) * n_b) + a[link_a] * n_b + b[link_b], return_counts=True)
        of, pairs = np.divmod(pairs, len(both.bytes_a) * n_b)
        cuts = pa.array(np.searchsorted(of, np.arange(len(found) + 1)), pa.int32())
        count = lambda x: pa.array(np.bincount(x, minlength=len(found)).astype(np.int64))
        row += len(found)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(row - len(found) + docs), pa.array(len_a), pa.array(len_b), count(doc[first(group)]), count(doc), pa.array(digests, pa.string())]
            + [pa.ListArray.from_arrays(cuts, pa.array(pairs.astype(code))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))],
            ["_id", "_row", *FACTS, "groups_sha256", "pairs", "times"],
        )

    for batch in batches:
        start, held, size = 0, [], 0
        for at, text in enumerate(batch.column(1)):
            held.append(both.encode(text.as_py()))
            size += held[-1][2]
            if size >= BYTES or at == batch.num_rows - 1:
                yield together(batch.slice(start, len(held)), held)
                start, held, size = at + 1, [], 0


def _weighed(batches: Iterator[pa.RecordBatch], heavy: Broadcast, best: Broadcast, n_b: int) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs in ``heavy``; the other pairs stay in lists."""
    codes, counts = heavy.value
    top = best.value
    is_best = counts == top[codes // n_b]
    for batch in batches:
        pairs, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times"))
        code, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
        place = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
        found = codes[place] == code if len(codes) else np.zeros(len(code), bool)
        gain = lambda x: np.concatenate([[0], np.cumsum(x)])[cuts]
        weight = np.where(found, counts[place], 0) * n if len(codes) else 0 * n
        hit = np.where(found, is_best[place], False) * n if len(codes) else 0 * n
        left = pa.array(gain(~found), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:7], pa.array(np.diff(gain(hit))), pa.array(np.diff(gain(weight))), pa.ListArray.from_arrays(left, pa.array(code[~found])), pa.ListArray.from_arrays(left, pa.array(n[~found].astype(np.int32)))],
            ["_id", "_row", *FACTS, "groups_sha256", "n_best", "count_sum", "pairs", "times"],
        )


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The id of each row with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    import sentencepiece
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "alignment")
    n_a, n_b = max(Tokenizer.from_file(path_a).get_vocab().values()) + 1, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    code = "long" if n_a * n_b >= 1 << 31 else "int"
    facts = f"_id {docs.schema[id_col].dataType.simpleString()}, _row long, {', '.join(f'{c} long' for c in FACTS)}, groups_sha256 string"
    lists = f"pairs array<{code}>, times array<int>"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    aligned = scratch.save(rows.mapInArrow(partial(_aligned, path_a=path_a, path_b=path_b, wide=code == "long"), f"{facts}, {lists}"))

    kind = F.floor(F.log2("n") * CLASSES).cast("int")
    counts = scratch.save(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    top = np.zeros(n_a, np.int64)
    # a row for each entry of A's vocabulary at most
    for r in counts.groupBy(F.floor(F.col("pair") / n_b).cast("int").alias("a")).agg(F.max("n").alias("n")).collect():
        top[r["a"]] = r["n"]
    least, held = None, 0
    # some hundreds of classes at most; those from ``least`` on hold ``heavy`` pairs at most
    for r in sorted(counts.groupBy(kind.alias("kind")).count().collect(), reverse=True):
        held += r["count"]
        if held > heavy:
            break
        least = r["kind"]
    is_heavy = F.lit(False) if least is None else kind >= least
    known = counts.where(is_heavy).toArrow().sort_by("pair")
    sent = [spark.sparkContext.broadcast(x) for x in ((known.column("pair").to_numpy(), known.column("n").to_numpy()), top)]
    weighed = scratch.save(aligned.mapInArrow(partial(_weighed, heavy=sent[0], best=sent[1], n_b=n_b), f"{facts}, n_best long, count_sum long, {lists}"))
    scratch.drop(aligned)

    tops = spark.createDataFrame(pa.table({"_a": np.flatnonzero(top).astype(np.int32), "_top": top[top > 0]}))
    light = counts.where(~is_heavy).join(F.broadcast(tops), F.floor(F.col("pair") / n_b) == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_top")).cast("long").alias("_best"))
    left = weighed.where(F.size("pairs") > 0).select("_row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    more = left.join(light, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("_best")).alias("_more_best"), F.sum(F.col("times") * F.col("n")).alias("_more_sum"))
    plus = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return weighed.join(more, "_row", "left").select(F.col("_id").alias(id_col), *FACTS, plus("n_best", "_more_best"), plus("count_sum", "_more_sum"), "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
