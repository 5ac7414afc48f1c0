"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector a string of bits, one for the side of each of KEY_BITS random hyperplanes, and sorts all vectors
by it. Similar vectors share long beginnings of these strings in some pass, so each is compared, by the true cosine, with its
WINDOW successors; pairs at the threshold or above are links, and passes are united by connected components. Positions
come from one range-partitioned sort of all passes, so windows reach across partitions: each stretch of BLOCK places is
compared together with the WINDOW places behind it.

One round of PASSES passes finds few of the links in a crowded region, whose vectors share beginnings with very many others. So
rounds go on, of MORE passes each with other hyperplanes and windows of WIDEST places, until a round unites no two
components; there is one more round at least. A link that a round would find with probability p escapes the last one with 1 - p: what is left is a few
links, whatever the number of vectors, unless p is small. If one window holds all vectors, the first round is exact and the last.

The windows bound the comparisons, not the partners. Equal vectors are folded into one before the passes and counted by their
number. Within each component every pair is then compared in blocks, of which only counts are kept, so n_links is exact for all
pairs inside a component however dense it is. That stage is no search: it counts what the passes have connected. It copies each vector
once for each block of its component, of MEMBERS vectors: a component of 10^6 vectors makes 245 blocks and as many copies. A pair is
missed only if no pass of any round brings together any chain of links between its two components.

Cosines are in double precision. Vectors that are null or zero, or hold null or non-finite components, link with nothing; so do
vectors of different lengths with each other. Null ids are larger than none; repeated rows come out repeatedly and count as links of
each other; an empty table gives no rows. Columns other than id and vector are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch, short_batches, sorted_groups
from pagemill.llm.components import Forest, components, links_batch

THRESHOLD = 0.9
#: Passes, bits of a pass's key, successors compared, places of a stretch, members of a block.
PASSES, KEY_BITS, WINDOW, BLOCK, MEMBERS = 20, 62, 64, 2048, 4096
#: Passes and successors compared of each later round.
MORE, WIDEST = 10, 1024


def planes(dim: int, passes: int, seed: int = 11, turn: int = 0) -> np.ndarray:
    return np.random.default_rng([seed, dim, turn] if turn else [seed, dim]).normal(size=(dim, passes * KEY_BITS))


def _valid(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """A digest and the bytes of each vector that can have links; nulls for the others. ``kind``: of the components."""
    for batch in batches:
        keys, raws = [], []
        for v in batch.column(1):
            key = raw = None
            if v.is_valid and not v.values.null_count and len(v.values):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    raw = (x + 0.0).tobytes()  # -0 becomes 0
                    key = hashlib.blake2b(raw, digest_size=16).digest()
            keys.append(key)
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["_id", "_key", "_raw"])


def unit(raws: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of norm 1, in double precision; scaled first, so the norm neither overflows nor vanishes."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(batches: Iterator[pa.RecordBatch], kind: str, passes: int, turn: int) -> Iterator[pa.RecordBatch]:
    """A row per pass and vector: the pass, the vector's length, the bits as a number, and the vector."""
    weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        nodes, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for dim in sorted({len(r) // np.dtype(kind).itemsize for r in raws}):
            mine = [i for i, r in enumerate(raws) if len(r) // np.dtype(kind).itemsize == dim]
            hyper = planes(dim, passes, turn=turn)
            for at in range(0, len(mine), 1024):
                part = mine[at : at + 1024]
                bits = (unit([raws[i] for i in part], kind) @ hyper > 0).reshape(len(part), passes, KEY_BITS)
                numbers = bits @ weights
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), p, np.int32)), pa.array(np.full(len(part), dim, np.int32)), pa.array(numbers[:, p]), pa.array(nodes[part]), pa.array([raws[i] for i in part], pa.binary())],
                        ["_pass", "_dim", "_bits", "_node", "_raw"],
                    )


def _windows(batches: Iterator[pa.RecordBatch], kind: str, window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each stretch."""
    for _, group in sorted_groups(batches, ["_stretch"]):
        group = group.sort_by("_place")
        passes, dims, nodes = (group.column(c).to_numpy() for c in ("_pass", "_dim", "_node"))
        own = group.column("_own").to_pylist()
        raws = group.column("_raw").to_pylist()
        forest = Forest()
        cuts = [0, *(np.flatnonzero((passes[1:] != passes[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), len(raws)]
        for a, b in zip(cuts, cuts[1:]):
            x = unit(raws[a:b], kind)
            for i in range(0, len(x), 256):
                if not own[a + i]:
                    break
                near = x[i : i + 256] @ x[i : i + 256 + window].T
                k, j = np.nonzero(near >= threshold)
                fit = (j > k) & (j - k <= window)
                for u, v in zip(nodes[a + i + k[fit]].tolist(), nodes[a + i + j[fit]].tolist()):
                    forest.join(u, v)
        yield links_batch(forest.links())


def _counts(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks of a component: how many vectors of the other block each vector links with."""
    found: Counter[int] = Counter()
    for (_, first, second), group in sorted_groups(batches, ["_label", "_first", "_second"]):
        block, nodes, copies = (group.column(c).to_numpy() for c in ("_block", "_node", "_copies"))
        raws = group.column("_raw").to_pylist()
        for dim in {len(r) for r in raws}:
            mine = np.array([len(r) == dim for r in raws])
            left, right = np.flatnonzero(mine & (block == first)), np.flatnonzero(mine & (block == second))
            if not len(left) or not len(right):
                continue
            x, y = unit([raws[i] for i in left], kind), unit([raws[i] for i in right], kind)
            for i in range(0, len(x), 512):
                near = x[i : i + 512] @ y.T >= threshold
                if first == second:
                    near[nodes[left[i : i + 512]][:, None] == nodes[right][None, :]] = False
                for node, n in zip(nodes[left[i : i + 512]].tolist(), (near @ copies[right]).tolist()):
                    found[node] += n
                if first != second:
                    for node, n in zip(nodes[right].tolist(), (copies[left[i : i + 512]] @ near).tolist()):
                        found[node] += n
        if len(found) > 100_000:
            yield links_batch([*found.items()])
            found = Counter()
    yield links_batch([*found.items()])


def _round(distinct: DataFrame, scratch: Scratch, kind: str, threshold: float, passes: int, window: int, block: int, turn: int) -> DataFrame:
    """The links (u, v) that one round of passes finds, as spanning forests of its stretches."""
    keyed = distinct.select("_node", "_raw").mapInArrow(partial(_keys, kind=kind, passes=passes, turn=turn), "_pass int, _dim int, _bits long, _node long, _raw binary")
    ordered = scratch.save(keyed.orderBy("_pass", "_dim", "_bits", "_node").withColumn("_at", F.monotonically_increasing_id()))
    # places without gaps: a partition's number is in the upper bits, and there is a row per partition
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    placed = ordered.join(F.broadcast(shifts), part == F.col("_part")).withColumn("_place", F.col("_shift") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_shift")
    stretch = F.floor(F.col("_place") / block)
    reach = F.col("_place") % block < window
    placed = placed.withColumn("_stretch", F.explode(F.when(reach & (stretch > 0), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))))
    placed = placed.withColumn("_own", F.col("_stretch") == stretch)
    links = scratch.save(placed.repartition("_stretch").sortWithinPartitions("_stretch").mapInArrow(partial(_windows, kind=kind, window=window, threshold=threshold), "u long, v long"))
    scratch.drop(ordered)
    return links


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """Per row of ``vectors``: the id, n_links, component_id (the smallest id reachable) and kept (whether it is the id)."""
    short_batches(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "vectors")
    id_kind = vectors.schema[id_col].dataType.simpleString()
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = scratch.save(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).mapInArrow(partial(_valid, kind=kind), f"_id {id_kind}, _key binary, _raw binary"))
    distinct = scratch.save(
        rows.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"), F.first("_raw").alias("_raw"))
        .withColumn("_node", F.monotonically_increasing_id())
    )
    count = distinct.count()
    labels, joined, turn = None, -1, 0
    while True:
        links = _round(distinct, scratch, kind, threshold, passes if turn == 0 else MORE, window, max(block, 4 * window), turn)
        labels, old = scratch.save(components(links if labels is None else links.union(labels.toDF("u", "v")), scratch)), labels
        scratch.drop(links, old)
        now = labels.where("node <> label").count()  # as many as links that a spanning forest has
        if now == joined or count <= window:
            break
        joined, turn, window = now, turn + 1, max(window, WIDEST)

    sizes = scratch.save(labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n")))
    blocked = labels.join(sizes, "label").withColumn("_blocks", F.ceil(F.col("_n") / members)).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    blocked = blocked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pairs = blocked.select(F.col("node").alias("_node"), F.col("label").alias("_label"), "_block", F.least("_block", "_other").alias("_first"), F.greatest("_block", "_other").alias("_second"))
    pairs = pairs.join(distinct.select("_node", "_raw", "_copies"), "_node")
    order = ["_label", "_first", "_second"]
    counted = pairs.repartition(*order).sortWithinPartitions(*order).mapInArrow(partial(_counts, kind=kind, threshold=threshold), "u long, v long")
    counted = scratch.save(counted.groupBy(F.col("u").alias("_node")).agg(F.sum("v").alias("_links")))
    named = scratch.save(distinct.select("_key", "_node", "_least", "_copies").join(labels.withColumnRenamed("node", "_node"), "_node", "left").withColumn("label", F.coalesce("label", "_node")))
    least = scratch.save(named.groupBy("label").agg(F.min("_least").alias("_component")))
    classes = scratch.save(named.join(least, "label").join(counted, "_node", "left").select("_key", "_component", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links")))
    linked = rows.where("_key is not null").select("_id", "_key").join(classes, "_key").select("_id", "_links", "_component")
    alone = rows.where("_key is null").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    return linked.union(alone).select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.coalesce(F.col("_id") == F.col("_component"), F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), least AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
), counts AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.v, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.v, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id
"""
