"""Byte-level BPE encoding and decoding with the ranks of a rank file.

Encoding: every match of the splitting pattern is mapped byte by byte to characters and tokenized by the tokenizers
library's BPE model, whose merges are derived from the ranks: each way to put a token together from two others, in the
order of the token's rank. Matches that are tokens themselves are taken whole. Where one token could arise
from two overlapping pairs, a list of merges cannot say "the leftmost"; matches in which that can happen
(two copies of the token overlap in them) are merged directly by rank.

Decoding: the characters of the tokens go back through the byte table and are joined before anything is read as UTF-8,
so characters that were split between tokens are whole again.

Defined results: null texts are encoded as empty; an empty text has no ids and an empty table gives no rows; null ids stay null and
repeated rows come out repeatedly; a very long text is encoded whole, in one task; lone surrogates cannot occur in Spark strings.
Columns other than id and text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._spark import short_batches
from pagemill.llm._units import Cache, byte_characters, once, shown, spelled, units

#: Rows whose ids are held at a time; their texts are at hand anyway.
ROWS = 256
#: Units, and words apart from them, that a worker remembers the ids of in each of two generations.
UNITS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from tokenizers.models import BPE

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.char = byte_characters()
        byte = {c: b for b, c in self.char.items()}
        merges, vocab, self.tangled = [], {}, set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            vocab[token.decode("latin-1").translate(self.char)] = rank
            cuts = [i for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [tuple(x.decode("latin-1").translate(self.char) for x in (token[:i], token[i:])) for i in cuts]
            # token = xy = yz with x and y of different lengths: in xyz two merges would overlap
            self.tangled |= {token[:i] + token for i in cuts if len(token) - i in cuts and 2 * i != len(token) and token[i:] == token[: len(token) - i]}
        self.longest = max(map(len, self.tangled), default=0)
        self.starts = {x[:4] for x in self.tangled}
        self.tokenize = BPE(vocab, merges, ignore_merges=True, cache_capacity=0).tokenize  # units are cached here
        self.bytes = {rank: bytes(byte[c] for c in shown) for shown, rank in vocab.items()}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.bytes}
        self.space = self.char[32]
        self.tails = {c: self.encode_match(c) for c in ".,"}
        self.known, self.words = Cache(self._unit, UNITS), Cache(self._word, UNITS)

    def merged(self, raw: bytes) -> list[int]:
        """The ids of a match by definition: join the leftmost pair of least rank until none has a rank."""
        ranks, n = self.ranks, len(raw)
        part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or ranks.get(part[i] + part[j]) != rank:
                continue  # one of the two has changed since
            part[i], part[j], after[i] = part[i] + part[j], None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(part[i] + part[after[j]])) is not None:
                    heappush(heap, (r, i))
            if before[i] >= 0 and (r := ranks.get(part[before[i]] + part[i])) is not None:
                heappush(heap, (r, before[i]))
        return [ranks[p] for p in part if p is not None]

    def overlapping(self, raw: bytes) -> bool:
        """Whether two pairs that make one token can overlap in the match, so that a list of merges may not say which comes first."""
        starts = self.starts
        for i in range(len(raw) - 3):
            if raw[i : i + 4] in starts and any(raw[i:j] in self.tangled for j in range(i + 4, min(i + self.longest, len(raw)) + 1)):
                return True
        return False

    def encode_match(self, match: str) -> bytes:
        """The ids of a match as 32-bit numbers."""
        raw = match.encode()
        rank = self.ranks.get(raw)
        if rank is not None:
            return self.packed[rank]
        ids = self.merged(raw) if self.overlapping(raw) else [t.id for t in self.tokenize(shown(match, self.char))]
        return b"".join(map(self.packed.__getitem__, ids))

    def _word(self, word: str) -> bytes:
        return self.encode_match(" " + word)

    def _unit(self, unit: str) -> bytes:
        """Of a unit other than the first; one word, or one word and a full stop or comma, is the usual case."""
        if unit.isalpha():  # the pattern's class of letters
            return self._word(unit)
        tail = self.tails.get(unit[-1:])
        if tail and unit[:-1].isalpha():
            word = unit[:-1]
            return (self.known.get(word) or self.words[word]) + tail
        return b"".join(map(self.encode_match, self.find(spelled(unit))))

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        cut = units(text)
        if cut is None:
            return b"".join(map(self.encode_match, self.find(text)))
        return b"".join([*map(self.encode_match, self.find(cut[0])), *map(self.known.__getitem__, cut[1:])])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def loaded(path: str, pattern: str) -> ByteBpe:
    return once(("byte bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ends: bool) -> Iterator[pa.RecordBatch]:
    import numpy as np

    bpe = loaded(path, pattern)
    sizes = np.zeros(max(bpe.bytes) + 1, np.int32)
    sizes[list(bpe.bytes)] = [len(b) for b in bpe.bytes.values()]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = [np.frombuffer(bpe.encode(t or ""), np.int32) for t in part.column(1).to_pylist()]
            cuts = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [ids, [np.cumsum(sizes[x], dtype=np.int32) for x in ids]] if ends else [ids]
            columns = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x), pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["_id", "ids", "ends"][: 1 + len(lists)])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path, pattern)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        yield batch.append_column("decoded", pa.array([bpe.decode(r.values.to_numpy(zero_copy_only=False).tolist()) if r.is_valid else None for r in ids], pa.binary()))


def bpe_encode(docs: DataFrame, path: str, pattern: str, ends: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row with ids (array of int) and, if asked for, ends (where each token ends, in bytes of the text)."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {kind}, ids array<int>" + ", ends array<int>" * ends
    return rows.mapInArrow(partial(_encode, path=path, pattern=pattern, ends=ends), schema).withColumnRenamed("_id", id_col)


def bpe_decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` with a column decoded, the bytes that the ids stand for; null ids give null."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded binary"])
    return rows.mapInArrow(partial(_decode, path=path, pattern=pattern), schema)


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Per row, encoded and decoded again: number of ids, digests of ids, of the decoded bytes and of ends."""
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    names = {rank: str(rank) for rank in loaded(path, pattern).bytes}
    for batch in _decode(_encode(batches, path, pattern, True), path, pattern):
        ids = [x.values.to_numpy() for x in batch.column("ids")]
        columns = [
            pa.array(map(len, ids), pa.int64()),
            pa.array([sha(",".join(map(names.__getitem__, x.tolist())).encode()) for x in ids], pa.string()),
            pa.array([sha(x.as_buffer()) for x in batch.column("decoded")], pa.string()),
            pa.array([sha(x.values.to_numpy().tobytes()) for x in batch.column("ends")], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"])


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``bpe_encode`` and ``bpe_decode`` make of each row, as digests: ids in decimal, joined by commas, ends as 32-bit little-endian numbers; ids do not leave the worker."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string"
    return rows.mapInArrow(partial(_digests, path=path, pattern=pattern), schema).withColumnRenamed("_id", id_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
