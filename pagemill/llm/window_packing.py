"""Packing documents in their order into sequences of at most ``capacity`` tokens: where to cut the stream of a partition's documents.

A document is its token ids and one closing id; null texts are empty. The documents of a partition, in their order, are one stream of
tokens, which is cut into windows of at most ``capacity``. A window is padded to ``capacity``, unless its length is a power of two: then
it is not padded at all. A cut costs nothing at a document's end, SENTENCE at a sentence's end and INSIDE within a sentence, where every
STRIDE-th token of a document may be one (so that a long run of text without sentences is cut too), and in the last two windows of a
partition every token. The dynamic program finds the cuts of least padding and cost, and of these the fewest windows:

    best(p) = cost(p) + min over window starts q of best(q) + padding(p - q)

Padding is linear in q, so the least best(q) + q of the last ``capacity`` tokens stands at the head of a monotone queue; powers of two are
looked up, at most 12 a place. The stream is solved in blocks: what all optimal ways to the last ``capacity`` places have in common
is settled, goes out and is forgotten, so the result is the optimum of the whole partition. Only if over ``limit`` tokens have no common
way is the stream cut at the document's end there.

Partitions don't depend on each other, nothing is shuffled or sent to the driver, and a partition loses less than two windows of padding
against a stream of all documents. A sequence's number is its partition's and its place there.

A sentence ends behind a token that ends in . ! or ? (quotation marks and brackets may follow) where white space begins the next, behind
a full-width . ! or ?, and at line breaks. Special tokens spelled out in a text are what the library makes of them. Null ids stay null and repeated rows are packed
repeatedly; an empty table gives no rows. A very long text is encoded whole, in one task, and cut like any other. Columns other than id
and text are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._spark import short_batches
from pagemill.llm._units import once, pack_ids
from pagemill.llm.packing import ByteLevel

CAPACITY = 2048
END = 1
#: Costs of cuts in tokens of padding, and the distance of places within sentences that may be cut.
SENTENCE, INSIDE, STRIDE = 8, 32, 128
#: Tokens solved together, and tokens held before a cut is forced.
BLOCK, LIMIT = 1 << 18, 1 << 23
#: Costs are counted in this many parts of a token, of which each window costs one.
PARTS = 1 << 20


class Encoder:
    """The library's ids of a tokenizer file, as bytes.

    Where merges are in the order of the ids they make, tiktoken gives the same ids from the same vocabulary in 0.6 of the time; texts that
    hold the string of a special token, or 1,000 characters without a space, are left to the library.
    """

    def __init__(self, path: str):
        self.level = ByteLevel(path)
        byte = {c: b for b, c in self.level.char.items()}
        special = set(self.level.special)
        self.ranks = {bytes(byte[c] for c in token): i for token, i in self.level.whole.get_vocab().items() if token not in special}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        self.fast = None
        if plain and made == sorted(made) and self.level.whole.normalizer is None:
            self.fast = tiktoken.Encoding("same", pat_str=self.level.find.__self__.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.level.special) or any(text.find(" ", i, i + 1000) < 0 for i in range(0, len(text) - 999, 1000)):
            return self.level.encode(text)
        return pack_ids(self.fast(text))


class Sentences:
    """Where sentences end, by token ids."""

    STOP, WIDE, BREAK, SPACE = 1, 2, 4, 8

    def __init__(self, level: ByteLevel):
        byte = {c: b for b, c in level.char.items()}
        vocab = level.whole.get_vocab()
        self.kinds = np.zeros(max([END, *vocab.values()]) + 1, np.uint8)
        for token, i in vocab.items():
            text = bytes(byte[c] for c in token).decode("utf-8", "replace") if set(token) <= byte.keys() else token
            bare = text.rstrip("\"'”’»)]")
            self.kinds[i] = self.STOP * bare.endswith((".", "!", "?")) + self.WIDE * bare.endswith(("。", "！", "？")) + self.BREAK * text.endswith("\n") + self.SPACE * text[:1].isspace()
        # of a token and the next one: whether a sentence ends between them
        before, after = np.arange(16)[:, None], np.arange(16)
        self.between = (before & self.WIDE > 0) | np.where(after & self.SPACE, before & self.STOP, before & self.BREAK) > 0

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of tokens behind which a sentence ends, within the document."""
        kinds = self.kinds[ids]
        likely = np.flatnonzero(kinds[:-1] & 7)
        return likely[self.between[kinds[likely], kinds[likely + 1]]] + 1


class Windows:
    """The dynamic program over one stream. Places are numbers of tokens before them; ``add`` and ``close`` give settled windows."""

    def __init__(self, capacity: int, limit: int = LIMIT):
        self.capacity, self.limit = capacity, limit
        self.powers = [1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity]
        self.place, self.best, self.back, self.keys = [0], [0], [-1], [0]
        self.queue: deque[int] = deque([0])

    def add(self, places: np.ndarray, costs: np.ndarray) -> list[int]:
        """The ends of the windows that are settled once the stream has these further places, of which the last is a document's end."""
        place, best, back, queue, capacity = self.place, self.best, self.back, self.queue, self.capacity
        known, base = len(place), place[0]
        place += places.tolist()
        number = np.full(place[-1] - base + 1, -1, np.int32)
        number[np.array(place) - base] = np.arange(len(place))
        rows, starts = [], []
        for power in self.powers:
            q = places - base - power
            fit = np.flatnonzero(q >= 0)
            i = number[q[fit]]
            rows.append(fit[i >= 0])
            starts.append(i[i >= 0])
        row, start = np.concatenate(rows), np.concatenate(starts)
        order = np.argsort(row, kind="stable")
        start = start[order].tolist()
        until = np.searchsorted(row[order], np.arange(len(places)), side="right").tolist()
        costs = (costs * PARTS + 1).tolist()
        padding, shift = ((capacity - places) * PARTS).tolist(), (places * PARTS).tolist()
        keys, head, at = self.keys, queue[0], 0
        for k, (p, cost, pad, end) in enumerate(zip(place[known:], costs, padding, until), known):
            while place[head] < p - capacity:
                queue.popleft()
                head = queue[0]
            least, source = keys[head] + pad, head
            if at < end:
                for q in start[at:end]:
                    if best[q] < least:
                        least, source = best[q], q
                at = end
            least += cost
            best.append(least)
            back.append(source)
            key = least + shift[k - known]
            keys.append(key)
            while queue and keys[queue[-1]] >= key:
                queue.pop()
            queue.append(k)
            head = queue[0]
        return self._settle()

    def _settle(self) -> list[int]:
        place, back = self.place, self.back
        n = len(place)
        if place[-1] - place[0] > self.limit:
            common = n - 1
        else:
            marked = bytearray(n)
            common = count = 0
            for i in range(n - 1, -1, -1):
                if place[i] >= place[-1] - self.capacity and not marked[i]:
                    marked[i] = 1
                    count += 1
                if marked[i]:
                    if count == 1 and place[i] < place[-1] - self.capacity or back[i] < 0:
                        common = i
                        break
                    count -= marked[back[i]]
                    marked[back[i]] = 1
        return self._out(common)

    def _out(self, common: int) -> list[int]:
        """The ends of the windows up to this place; the program goes on from it."""
        found, i = [], common
        while i > 0:
            found.append(self.place[i])
            i = self.back[i]
        if common:
            floor = self.best[common]
            self.place, self.best, self.keys = self.place[common:], [b - floor for b in self.best[common:]], [k - floor for k in self.keys[common:]]
            self.back = [-1, *(b - common for b in self.back[common + 1 :])]
            self.queue = deque(q - common for q in self.queue if q >= common)
        return found[::-1]

    def close(self) -> list[int]:
        return self._out(len(self.place) - 1)


class Stream:
    """The documents of a partition: held until the windows over them are settled."""

    def __init__(self, tokenizer: Encoder, sentences: Sentences, part: int, capacity: int, block: int, limit: int):
        self.tokenizer, self.sentences, self.block, self.capacity = tokenizer, sentences, block, capacity
        self.stride = min(STRIDE, capacity)
        self.windows = Windows(capacity, limit)
        self.docs: deque[tuple] = deque()  # id, place, ids as bytes; not yet out
        self.new: deque[tuple] = deque()  # those of them that the program has not seen
        self.place = self.seen = self.out = 0
        self.sequence = part << 40

    def add(self, doc, text: str | None) -> list[tuple]:
        raw = self.tokenizer.encode(text or "") + END.to_bytes(4, "little")
        self.docs.append((doc, self.place, raw))
        self.new.append(self.docs[-1])
        self.place += len(raw) // 4
        return self._solve(self.place - 2 * self.capacity) if self.place - self.seen >= self.block + 2 * self.capacity else []

    def _solve(self, until: int) -> list[tuple]:
        """Rows settled by the documents that end at ``until`` or before."""
        places, costs = [], []
        while self.new and self.new[0][1] + len(self.new[0][2]) // 4 <= until:
            _, start, raw = self.new.popleft()
            ids = np.frombuffer(raw, "<u4")
            cost = np.full(len(ids) + 1, -1, np.int64)
            cost[self.stride :: self.stride] = INSIDE
            if until == self.place:  # the end of the stream
                cost[max(1, until - 2 * self.capacity - start) :] = INSIDE
            cost[self.sentences.ends(ids)] = SENTENCE
            cost[-1] = 0
            here = np.flatnonzero(cost >= 0)
            places.append(here + start)
            costs.append(cost[here])
            self.seen = start + len(ids)
        return self._rows(self.windows.add(np.concatenate(places), np.concatenate(costs))) if places else []

    def _rows(self, ends: list[int]) -> list[tuple]:
        rows = []
        for end in ends:
            begin = self.out
            while self.out < end:
                doc, start, raw = self.docs[0]
                stop = min(end, start + len(raw) // 4)
                ids = memoryview(raw)[4 * (self.out - start) : 4 * (stop - start)]
                rows.append((doc, self.out - start, stop - self.out, zlib.crc32(ids), len(raw) // 4, self.sequence, self.out - begin))
                self.out = stop
                if stop == start + len(raw) // 4:
                    self.docs.popleft()
            self.sequence += 1
        return rows

    def close(self) -> list[tuple]:
        return self._solve(self.place) + self._rows(self.windows.close())


COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, block: int, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    def made() -> tuple[Encoder, Sentences]:
        tokenizer = Encoder(path)
        return tokenizer, Sentences(tokenizer.level)

    stream, kind = Stream(*once(("windows", path), made), TaskContext.get().partitionId(), capacity, block, limit), None
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [kind, *[pa.int64()] * 6])], ["_id", *COLUMNS])
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if rows := stream.add(doc, text.as_py()):
                yield table(rows)
    if rows := stream.close():
        yield table(rows)


def pack_windows(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """A row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = ", ".join([f"_id {kind}", *(f"{c} long" for c in COLUMNS)])
    return rows.mapInArrow(partial(_cut, path=path, capacity=capacity, block=block, limit=limit), schema).withColumnRenamed("_id", id_col)


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"))
