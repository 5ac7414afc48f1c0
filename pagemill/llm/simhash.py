"""SimHash near-deduplication over an inverted index of byte positions, with count filtering.

Two 64-bit fingerprints that differ in 3 bits at most differ in 3 of their 8 bytes at most, so they share at least
5 (position, byte) tokens: the guaranteed minimum. The first shared token of such a pair is at one of the first 4 positions, so
4 postings of each fingerprint are enough to bring every such pair together. In each posting the tally of a pair's shared
positional bytes is taken; pairs that reach 5 are retained and the bits that differ verify them.

A posting with over ``small`` members is not paired off. It is split by the next shared token, which is exact: the second shared
token of a pair is at one of the first 5 positions behind the first, the third at one of the first 6, and so on, so a member goes to at
most 4 finer postings, and a pair is reported in the one that its first shared tokens name. With n fingerprints postings of one token
hold n / 256 of them, so the index begins with as many tokens as make postings short; splitting does the rest.

Postings of five tokens that are still large are split by half bytes: the 3 bits that differ lie in the other three bytes; of these six
half bytes at least three agree, which gives 20 finer postings of at most 4096 distinct members each. Each of those is joined up
into a spanning forest inside one task, so a dense group costs links in proportion to its members. No posting is capped
and no pair left out. Only distinct fingerprints are indexed; documents that share one are brought back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch, short_batches, sorted_groups
from pagemill.llm._units import trim
from pagemill.llm.components import Forest, components, links_batch

SHINGLE = 3
SEED = 42
BITS = 3
SHARED_BYTES = 8 - BITS
#: A posting with more members is split by another token.
SMALL = 32
#: Members of a posting, on average over all bytes, at which the index begins at most: pairs by chance stay below rows of the index.
LENGTH = 0.25


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number; 0 for a text without words.

    ``bytes.lower`` and ``bytes.split`` act on A-Z and on x20 and x09-x0D alone, as wanted.
    """
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = [0, *ends[:-words].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the memory for the bits of very long texts
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["_id", "_fp"])
    trim()


def _postings(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """(mask of the positions and their bytes in one number, fingerprint) for each posting of so many tokens."""
    import numpy as np

    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        octets = np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8).astype(np.int64)
        keys = []
        # the last of the first shared tokens has at most BITS positions that are not shared before it
        for places in combinations(range(tokens + BITS), tokens):
            key = np.full(len(fps), sum(1 << p for p in places), np.int64)
            for p in range(SHARED_BYTES):
                key = key << 8 | (octets[:, places[p]] if p < tokens else 0)
            keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fps, len(keys)))], ["_key", "_fp"])


def _split(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.RecordBatch]:
    """The postings of one token more of each member of a posting of so many tokens."""
    import numpy as np

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fps = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        octets, masks = fps.view(np.uint8).reshape(-1, 8).astype(np.int64), keys >> 8 * SHARED_BYTES
        out = []
        for p in range(tokens, tokens + BITS + 1):
            own = masks < 1 << p  # whose last token stands before it
            out.append((keys[own] + (1 << 8 * SHARED_BYTES + p) + (octets[own, p] << 8 * (SHARED_BYTES - 1 - tokens)), fps[own]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["_key", "_fp"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 20 finer postings of each member of a large posting."""
    import numpy as np

    for batch in batches:
        for part in range(0, batch.num_rows, 4096):
            keys = batch.column(0).slice(part, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            fps = np.ascontiguousarray(batch.column(1).slice(part, 4096).to_numpy(zero_copy_only=False).astype(np.int64))
            nibbles = np.stack([fps >> 4 * i & 15 for i in range(16)], axis=1)
            free = np.array([[p for p in range(8) if not m >> p & 1] for m in (keys >> 8 * SHARED_BYTES).tolist()]).reshape(-1, 8 - SHARED_BYTES)
            six = np.take_along_axis(nibbles, np.repeat(free * 2, 2, axis=1) + np.tile([0, 1], 8 - SHARED_BYTES), axis=1)
            subs = [j << 12 | six[:, a] << 8 | six[:, b] << 4 | six[:, c] for j, (a, b, c) in enumerate(combinations(range(6), 3))]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(keys, len(subs))), pa.array(np.concatenate(subs)), pa.array(np.tile(fps, len(subs)))], ["_key", "_sub", "_fp"])


def _join_up(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links inside each finer posting (at most 4096 members)."""
    import numpy as np

    found: list[tuple[int, int]] = []
    for _, group in sorted_groups(batches, ["_key", "_sub"]):
        fps = group.column("_fp").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        forest = Forest()
        for i in range(0, len(fps) - 1, 512):
            rows, cols = np.nonzero(np.triu(np.bitwise_count((fps[i : i + 512, None] ^ fps[None, i:]).view(np.uint64)) <= bits, 1))
            for a, b in zip(fps[i + rows].tolist(), fps[i + cols].tolist()):
                forest.join(a, b)
        found += forest.links()
        if len(found) > 50_000:
            yield links_batch(found)
            found = []
    yield links_batch(found)


def first_tokens(count: int) -> int:
    """With how many tokens a posting of an index over ``count`` fingerprints begins."""
    return next((d for d in range(1, SHARED_BYTES) if count <= LENGTH * 256**d), SHARED_BYTES)


def fingerprint_links(distinct: DataFrame, scratch: Scratch, small: int = SMALL, tokens: int | None = None) -> DataFrame:
    """Links (u, v) that connect exactly what fingerprints differing in 3 bits or fewer connect; ``distinct`` has ``_fp``."""
    tokens = tokens or first_tokens(distinct.count())
    postings = distinct.select("_fp").mapInArrow(partial(_postings, tokens=tokens), "_key long, _fp long")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    alike = [F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(255)) == 0 for p in range(8)]
    tally = sum((same.cast("int") for same in alike), F.lit(0))
    mask = sum((F.when(same, 1 << p).otherwise(0) for p, same in enumerate(alike)), F.lit(0)).cast("long")
    named = F.shiftright("_key", 8 * SHARED_BYTES)
    below = named
    for step in (1, 2, 4):
        below = below.bitwiseOR(F.shiftright(below, step))
    # the count filter; then the posting that the pair's first shared tokens name is the one that reports it; then the bits
    links = (tally >= SHARED_BYTES) & (mask.bitwiseAND(below) == named) & (F.bit_count(differ) <= BITS)
    found = []
    while True:
        sizes = scratch.save(postings.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_fp").alias("u"), F.max("_fp").alias("v")).where("_n > 1"))
        found.append(sizes.where("_n = 2").where(links).select("u", "v"))
        members = scratch.save(postings.join(sizes.where("_n > 2").select("_key", "_n"), "_key"))
        few, many = members.where(F.col("_n") <= small), members.where(F.col("_n") > small).select("_key", "_fp")
        pairs = few.select("_key", F.col("_fp").alias("u")).join(few.select(F.col("_key").alias("_k"), F.col("_fp").alias("v")), (F.col("_key") == F.col("_k")) & (F.col("u") < F.col("v")) & links)
        found.append(pairs.select("u", "v"))
        if tokens == SHARED_BYTES or many.isEmpty():
            break
        postings = many.mapInArrow(partial(_split, tokens=tokens), "_key long, _fp long")
        tokens += 1
    if tokens == SHARED_BYTES:
        finer = many.mapInArrow(_finer, "_key long, _sub long, _fp long").repartition("_key", "_sub").sortWithinPartitions("_key", "_sub")
        found.append(finer.mapInArrow(partial(_join_up, bits=BITS), "u long, v long"))
    return reduce(DataFrame.union, found)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, tokens: int | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hex digits) and component_id, the smallest id reachable.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Null ids are
    larger than none: a component of null ids alone has a null component_id. Repeated rows come out repeatedly, an empty table
    gives no rows, and ids are of any type that can be compared. A very long text is hashed stretch by stretch. Columns
    other than id and text are not looked at. ``small`` and ``tokens`` (of the first postings) change the way, not the result.
    """
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.save(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_fingerprints, f"_id {kind}, _fp long"))
    distinct = scratch.save(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    labels = scratch.save(components(fingerprint_links(distinct, scratch, small, tokens), scratch))
    named = scratch.save(distinct.join(labels.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", F.coalesce("label", "_fp").alias("_label"), "_least"))
    least = scratch.save(named.groupBy("_label").agg(F.min("_least").alias("_component")))
    classes = scratch.save(named.join(least, "_label").select("_fp", "_component"))
    return rows.join(classes, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
