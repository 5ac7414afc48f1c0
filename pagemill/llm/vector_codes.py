"""Vector code compression: a codebook for each part of the vectors, by Lloyd's rounds with Elkan's bounds.

A vector's components become integers, floor(1024 x), and it is cut into PARTS equal parts. Each part has a codebook of up to
ENTRIES entries, at first that part of the vectors with the smallest ids. A round assigns every part to the nearest entry of its
codebook (ties to the lower index) and moves each entry to the floor of the mean of its parts; unused entries stay.

What a vector knows is kept in its row from round to round: for each part the entry it belongs to, an upper bound of the
distance to it, and for each entry a lower bound of the distance to that. When entries have moved, upper bounds grow and lower bounds
shrink by the way moved. An entry is passed over if its lower bound, or half the distance between it and the part's own entry, is
strictly above the upper bound; every other one is measured in integers, so ties are settled by the numbers themselves. Bounds are
integers, rounded to the safe side; a lower bound is stored in 16 bits, and stands at the largest of these if it is larger.

Only codebooks and their sums, PARTS x ENTRIES rows of a part's length, come to the driver; sums are made by partition first.
Each round's rows are written once and those of the round before removed.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are vectors without components or of
another length than the one with the smallest id, which no codebook fits. The length must be a multiple of PARTS, and no component may
be beyond 2**26 / 1024, so that sums of squares stay exact: either raises an error. Null ids come after all others; rows with the same
id are ordered by vector. Repeated rows come out repeatedly; fewer vectors than ENTRIES make that many entries; an empty table gives
no rows. Equal labels share label_error, null labels together. Columns other than id, vector and label are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm._spark import Scratch, short_batches

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components in integers are below this, so that a squared distance and the sum of many fit 64 bits.
LARGEST = 1 << 26
#: Rows that are worked on together.
ROWS = 256
FAR = np.int64(1 << 40)

Books = np.ndarray  # [part, entry, position], integers


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, label and the components as 32-bit integers."""
    for batch in batches:
        vectors = batch.column(2)
        x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        if x.size and np.abs(x).max() >= LARGEST:
            raise ValueError(f"a component is beyond {LARGEST // SCALE}")
        rows = x.astype("<i4").reshape(len(vectors), -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["_id", "_label", "_x"])


def floor_root(square: np.ndarray) -> np.ndarray:
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


def ceil_root(square: np.ndarray) -> np.ndarray:
    root = floor_root(square)
    return root + (root * root < square)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


class Bounds:
    """One codebook, and what moving to it does to bounds."""

    def __init__(self, book: np.ndarray, before: np.ndarray):
        self.book = book
        self.moved = ceil_root(squares(book, before))
        self.between = floor_root(squares(book[:, None], book[None]))
        self.norms = squares(book, np.zeros_like(book))

    def all_squares(self, x: np.ndarray) -> np.ndarray | None:
        """Every row against every entry by one product of matrices; None where doubles might not hold the integers."""
        size = max(np.abs(x).max(initial=0), np.abs(self.book).max(initial=0)) if x.size else 0
        if int(size) ** 2 * 4 * x.shape[1] >= 1 << 53:
            return None
        product = x.astype(np.float64) @ self.book.T.astype(np.float64)
        return (squares(x, np.zeros_like(x))[:, None] + self.norms - 2 * product).astype(np.int64)

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The new entry and upper bound of each row, and how many distances were measured; ``lower`` is brought up to date in place."""
        own = np.arange(len(x))
        np.maximum(lower - self.moved, 0, out=lower)
        upper = upper + self.moved[at]

        def near(rows: np.ndarray) -> np.ndarray:
            u = upper[rows, None]
            found = (lower[rows] <= u) & (self.between[at[rows]] <= 2 * u)
            found[np.arange(len(rows)), at[rows]] = False
            return found

        rows = own[near(own).any(1)]
        # first the distance to the part's own entry, which may settle it
        square = squares(x[rows], self.book[at[rows]])
        upper[rows], lower[rows, at[rows]] = ceil_root(square), floor_root(square)
        open_ = near(rows)
        if 4 * open_.sum() > open_.size and (all_ := self.all_squares(x[rows])) is not None:  # most are open: at the beginning
            lower[rows] = floor_root(all_)
            at = at.copy()
            at[rows] = all_.argmin(1)
            upper[rows] = ceil_root(all_[np.arange(len(rows)), at[rows]])
            return at, upper, all_.size
        k, entry = np.nonzero(open_)
        others = squares(x[rows[k]], self.book[entry])
        lower[rows[k], entry] = floor_root(others)
        row = np.concatenate([np.arange(len(rows)), k])
        entries, measured = np.concatenate([at[rows], entry]), np.concatenate([square, others])
        order = np.lexsort((entries, measured, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        at, upper = at.copy(), upper.copy()
        at[rows], upper[rows] = entries[first], ceil_root(measured[first])
        return at, upper, len(measured)


def _assign(batches: Iterator[pa.RecordBatch], books: Books, before: Books, fresh: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their new entries and bounds; the last time with code and error instead. ``fresh``: nothing is known of a row yet."""
    parts, entries, length = books.shape
    bounds = [Bounds(b, a) for b, a in zip(books, before)]
    read = lambda column, kind, shape: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).astype(np.int64)
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            n = batch.num_rows
            x = read(batch.column(2), "<i4", (parts, length))
            if fresh:
                at, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), FAR), np.zeros((n, parts, entries), np.int64)
            else:
                at, upper, lower = read(batch.column(3), np.uint8, (parts,)), read(batch.column(4), "<i8", (parts,)), read(batch.column(5), "<u2", (parts, entries))
            for p, bound in enumerate(bounds):
                at[:, p], upper[:, p], _ = bound.assign(x[:, p], at[:, p], upper[:, p], lower[:, p])
            if last:
                error = squares(x, books[np.arange(parts), at]).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes().hex() for r in at.astype(np.uint8)], pa.string()), pa.array(error)], ["_id", "_label", "code", "error"])
            else:
                kept = [at.astype(np.uint8), upper.astype("<i8"), np.minimum(lower, 65535).astype("<u2")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r.tobytes() for r in c], pa.binary()) for c in kept)], ["_id", "_label", "_x", "_at", "_upper", "_lower"])


def _sums(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Of this partition, for each entry and position: number of parts and sum of components."""
    parts, _, length = shape
    counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(batch.num_rows, parts, length)
        at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, parts)
        for p in range(parts):
            np.add.at(counts[p], at[:, p], 1)
            np.add.at(sums[p], at[:, p], x[:, p])
    part, entry = np.nonzero(counts)
    each = lambda a: pa.array(np.repeat(a, length).astype(np.int64))
    yield pa.RecordBatch.from_arrays([each(part), each(entry), pa.array(np.tile(np.arange(length), len(part))), each(counts[part, entry]), pa.array(sums[part, entry].ravel())], ["part", "entry", "place", "n", "total"])


def moved(books: Books, state: DataFrame) -> Books:
    """Each entry at the floor of the mean of its parts; of PARTS x ENTRIES x length rows at most."""
    sums = state.select("_x", "_at").mapInArrow(partial(_sums, shape=books.shape), "part long, entry long, place long, n long, total long")
    new = books.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        new[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return new


def first_books(kept: DataFrame, parts: int, entries: int) -> Books | None:
    """The parts of the vectors with the smallest ids; None if there is no vector."""
    least = kept.select("_id", "_vector").orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries)
    dim = [len(r[0]) for r in least.select("_vector").limit(1).collect()]
    if not dim:
        return None
    if dim[0] % parts:
        raise ValueError(f"vectors of {dim[0]} components have no {parts} equal parts")
    rows = kept.where(F.size("_vector") == dim[0]).orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    x = np.floor(np.array([r[0] for r in rows], np.float64) * SCALE)
    if np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return x.astype(np.int64).reshape(len(rows), parts, -1).swapaxes(0, 1).copy()


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, Books | None]:
    """A row per kept vector: id, code, error, label_error and codebooks_sha256; and the final codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    spark = vectors.sparkSession
    short_batches(spark)
    scratch = Scratch(spark, "codes")
    types = {"_id": vectors.schema[id_col].dataType.simpleString(), "_label": vectors.schema[label_col].dataType.simpleString()}
    kinds = ", ".join(f"{c} {t}" for c, t in types.items())
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("_vector").isNotNull() & (F.size("_vector") > 0) & finite)
    books = first_books(kept, parts, entries)
    if books is None:
        return spark.createDataFrame([], f"`{id_col}` {types['_id']}, code string, error long, label_error long, codebooks_sha256 string"), None
    dim = books.shape[0] * books.shape[2]
    state = kept.where(F.size("_vector") == dim).mapInArrow(_integers, f"{kinds}, _x binary")
    before, held = books, None
    for turn in range(rounds):
        new = scratch.save(state.mapInArrow(partial(_assign, books=books, before=before, fresh=turn == 0, last=False), f"{kinds}, _x binary, _at binary, _upper binary, _lower binary"))
        scratch.drop(held)
        state = held = new
        before, books = books, moved(books, state)
    coded = scratch.save(state.mapInArrow(partial(_assign, books=books, before=before, fresh=rounds == 0, last=True), f"{kinds}, code string, error long"))
    scratch.drop(held)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    # a label may hold any share of the rows: its sum is one row, and a join on written rows can be split
    out = coded.join(labels, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql() -> str:
    """Plain Lloyd: every part against every entry, in exact double precision."""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p))",
        "b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""d{k} AS MATERIALIZED (SELECT vec_id, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN b{k} USING (p)),
a{k} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM d{k} GROUP BY vec_id, p)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""u{k} AS (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k} JOIN parts USING (vec_id, p), range(1, 17) t(i) GROUP BY p, e, i),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM u{k} GROUP BY p, e) n USING (p, e))"""
            )
    steps.append(
        f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} JOIN kept USING (vec_id) GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS})"""
    )
    return f"WITH {', '.join(steps)}\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, book"


OP13_SQL = _sql()
