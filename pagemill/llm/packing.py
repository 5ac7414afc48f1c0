"""Packing documents into sequences of a fixed number of tokens.

The plan is made on the histogram of piece lengths alone, which has ``capacity`` entries at most, whatever the corpus:

1. The linear program over configurations (multisets of lengths that fit a sequence): as few sequences as possible, each
   length covered. Multiplicative weights solve it: each round the knapsack dynamic program finds the configuration of greatest
   weight, a share of the sequences takes it, and the weights of lengths fall with their coverage.
2. Rounding: each configuration is used a whole number of times, as far as pieces remain; what remains is solved again
   while that places pieces, and the rest goes best-fit decreasing, on the histogram too.

Pieces then find their places by their rank among the pieces of their length: ranks are counts by partition and running
sums over partitions, and the plan, a few thousand runs of ranks, is a broadcast table whose size depends on the capacity only.

A document is its token ids and one closing id; those longer than a sequence are cut into full pieces behind a first
piece that may be shorter. Null texts are empty: a document of the closing id alone; special tokens spelled out in a text are
what the library makes of them. Repeated rows are packed repeatedly and null ids stay null; an empty table gives no rows. A very
long text is encoded in one task and cut into as many pieces as it needs. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch, short_batches
from pagemill.llm._units import Cache, byte_characters, once, pack_ids, shown, spelled, trim, units

CAPACITY = 1024
END = 2
#: Rounds of multiplicative weights in each solution, the rate at which weights fall, and solutions at most.
ROUNDS, RATE, SOLUTIONS = 16, 0.02, 6

#: Units, and words apart from them, that a worker remembers the ids of in each of two generations.
UNITS = 300_000

Pattern = tuple[tuple[int, int], ...]


class ByteLevel:
    """Ids of a byte-level tokenizer file as unsigned 32-bit little-endian bytes, as the library gives them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        # texts that hold one of these strings are left to the library
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.char = byte_characters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.space = self.char[32]
        self.ends = {c: self._match(c) for c in ".,"}
        self.find = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
        self.known, self.words = Cache(self._unit, UNITS), Cache(self._word, UNITS)

    def _word(self, word: str) -> bytes:
        """Of a word of letters behind a space."""
        text = self.space + word if word.isascii() else shown(" " + word, self.char)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(text)])

    def _match(self, match: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(shown(match, self.char))])

    def _unit(self, unit: str) -> bytes:
        """Of a unit other than the first; one word, or one word and a full stop or comma, is the usual case."""
        if unit.isalpha():  # the pattern's class of letters
            return self._word(unit)
        tail = self.ends.get(unit[-1:])
        if tail and unit[:-1].isalpha():
            word = unit[:-1]
            return (self.known.get(word) or self.words[word]) + tail
        return b"".join(map(self._match, self.find(spelled(unit))))

    def encode(self, text: str) -> bytes:
        cut = None if any(x in text for x in self.special) else units(text)
        if cut is None:
            return pack_ids(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join([*map(self._match, self.find(cut[0])), *map(self.known.__getitem__, cut[1:])])


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each document, numbered by length within this partition."""
    from pyspark import TaskContext

    tokenizer = once(("byte level", path), lambda: ByteLevel(path))
    here, ranks, end = TaskContext.get().partitionId(), Counter(), END.to_bytes(4, "little")
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = tokenizer.encode(text or "") + end
            total = len(ids) // 4
            first = (total - 1) % capacity + 1
            for piece, start in enumerate([0, *range(first, total, capacity)]):
                stop = first if piece == 0 else start + capacity
                rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), here, ranks[stop - start]))
                ranks[stop - start] += 1
        kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], ["_id", "piece", "start", "length", "ids_crc32", "_part", "_local"])
    trim()


class Knapsack:
    """For every room the multiset of lengths of greatest total weight that fits it."""

    def __init__(self, lengths, weights, capacity: int):
        import numpy as np

        self.lengths = lengths
        best, self.taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        reach = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            if k := reach[c]:
                values = best[c - lengths[:k]] + weights[:k]
                i = int(values.argmax())
                if values[i] > best[c]:
                    best[c], self.taken[c] = values[i], i

    def fill(self, room: int) -> Counter[int]:
        used: Counter[int] = Counter()
        while room > 0:
            i = self.taken[room]
            if i < 0:
                room -= 1
            else:
                used[int(self.lengths[i])] += 1
                room -= int(self.lengths[i])
        return used


def configurations(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[Pattern, float]:
    """A fractional solution of the configuration program: how often each configuration is used.

    The weight of a length is its size, as in the volume bound's dual, times a factor that falls as the length runs ahead of
    the round's target. One knapsack table prices all configurations of a round: for each length that is behind, longest
    first, the best configuration around it is used until the target is met.
    """
    import numpy as np

    lengths = np.array(sorted(counts))
    weights = lengths.astype(float)
    covered: Counter[int] = Counter()
    used: dict[Pattern, float] = defaultdict(float)
    for t in range(1, rounds + 1):
        table = Knapsack(lengths, weights, capacity)
        for x in lengths[::-1].tolist():
            if (behind := counts[x] * t / rounds - covered[x]) > 0:
                pattern = table.fill(capacity - x)
                pattern[x] += 1
                times = behind / pattern[x]
                used[tuple(sorted(pattern.items(), reverse=True))] += times
                for y, n in pattern.items():
                    covered[y] += n * times
        ahead = np.array([covered[x] / counts[x] for x in lengths.tolist()]) - t / rounds
        weights = weights * np.exp(-rate * np.clip(ahead, -1, 1))
        weights = np.maximum(weights, lengths * 1e-3)
    return used


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing on a histogram: sequences with the same content are placed together."""
    open_: dict[int, Counter[Pattern]] = defaultdict(Counter)  # by room
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_ if r >= length and open_[r]), default=None)
            if room is None:
                q = capacity // length
                full, rest = divmod(n, q)
                if full:
                    open_[capacity - q * length][((length, q),)] += full
                if rest:
                    open_[capacity - rest * length][((length, rest),)] += 1
                break
            pattern, there = open_[room].popitem()
            q = min(room // length, n)
            m = min(there, n // q)
            open_[room - q * length][(*pattern, (length, q))] += m
            if there > m:
                open_[room][pattern] += there - m
            n -= m * q
    return [(m, pattern) for group in open_.values() for pattern, m in group.items() if m]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, Pattern]]:
    """(number of sequences, ((length, copies), ...)) so that each length is placed as often as it is counted."""
    left = Counter({x: n for x, n in counts.items() if n})
    out = []
    if full := left.pop(capacity, 0):
        out.append((full, ((capacity, 1),)))
    for _ in range(SOLUTIONS):
        if sum(left.values()) < rounds:
            break
        placed = 0
        for pattern, times in sorted(configurations(left, capacity, rounds).items(), key=lambda x: -x[1]):
            m = min(int(times), *(left[x] // n for x, n in pattern))
            if m:
                out.append((m, pattern))
                placed += m
                left.subtract({x: n * m for x, n in pattern})
        left = +left
        if not placed:
            break
    return out + best_fit(left, capacity)


def runs(planned: list[tuple[int, Pattern]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, first sequence, copies in a sequence, offset of the first copy)."""
    ranks: Counter[int] = Counter()
    sequence, out = 0, []
    for times, pattern in planned:
        offset = 0
        for length, copies in pattern:
            out.append((length, ranks[length], ranks[length] + times * copies, sequence, copies, offset))
            ranks[length] += times * copies
            offset += length * copies
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: the id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = scratch.save(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .mapInArrow(partial(_cut, path=path, capacity=capacity), f"_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _local long")
    )
    by_part = scratch.save(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")))
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = spark.createDataFrame(runs(plan(counts, capacity)), "_length long, _from long, _to long, _sequence long, _copies long, _offset long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = pieces.join(scratch.save(shifts), ["_part", "length"]).withColumn("_rank", F.col("_shift") + F.col("_local"))
    step = F.col("_rank") - F.col("_from")
    # the runs: some thousands, by the capacity and the rounds, whatever the number of pieces
    return ranked.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select(
        F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(step / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + step % F.col("_copies") * F.col("length")).alias("offset"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"))
