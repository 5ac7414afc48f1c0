"""Vector codes against plain Lloyd rounds, bounds against distances, and the query against its SQL."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from pagemill.llm import vector_codes as vc


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label_error) of the kept rows and the final entries; rows: (id, label, vector)."""
    kept = [(i, label, [int(np.floor(1024 * float(x))) for x in v]) for i, label, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(kept[0][2]) // parts
    cut = [[v[p * length : (p + 1) * length] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (d(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        groups = defaultdict(list)
        for c, at in zip(cut, assign()):
            for p in range(parts):
                groups[p, at[p]].append(c[p])
        for (p, e), members in groups.items():
            books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    at = assign()
    errors = [sum(d(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at)]
    by = defaultdict(int)
    for (_, label, _), e in zip(kept, errors):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in a), e, by[label], digest) for (i, label, _), a, e in zip(kept, at, errors)), key=str)


def made(n, dim=8, seed=3):
    rng = random.Random(seed)
    rows = [(7 * i % 1009, rng.choice([None, 0, 1, 1, 1]), [rng.choice([rng.gauss(0, 1), rng.randrange(-2, 3) / 4]) for _ in range(dim)]) for i in range(n)]
    rows += [(5000 + i, 1, rows[i % 9][2]) for i in range(n // 3)]  # copies
    return rows


ODD = [(90001, 1, None), (90002, 1, [1.0] * 7 + [None]), (90003, None, [float("nan")] * 8), (90004, 2, [float("inf")] + [0.0] * 7), (90005, 2, [0.0] * 8), (90005, 2, [0.0] * 8), (None, None, [0.25] * 8), (90006, 3, [])]


@pytest.mark.parametrize("entries", [1, 16, 200])
def test_codes_equal_plain_rounds(spark, entries):
    rows = made(240) + ODD
    vectors = spark.createDataFrame([(i, v, label, "c", b"d") for i, label, v in rows], "vec_id long, embedding array<double>, label int, _x string, code binary").repartition(5)
    out, books = vc.vector_codes(vectors, entries=entries)
    assert books.shape[1] == entries
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows, entries=entries)


def test_ties_go_to_the_lower_index(spark):
    rows = [(0, 0, [0.0] * 4), (1, 0, [2.0] * 4), (2, 0, [0.0] * 4), (3, 0, [1.0] * 4)]
    out, _ = vc.vector_codes(spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<float>, label int"), entries=3, rounds=0)
    assert {r.vec_id: r.code for r in out.collect()} == {0: "00000000", 1: "01010101", 2: "00000000", 3: "00000000"}


def test_empty_and_unfit_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    for rows in ([], [(1, None, 1)], [(1, [], None)]):
        out, books = vc.vector_codes(spark.createDataFrame(rows, schema))
        assert books is None and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    # the length of the first vector decides
    out, _ = vc.vector_codes(spark.createDataFrame([(2, [0.0] * 8, 1), (1, [0.0] * 4, 1)], schema))
    assert [r.vec_id for r in out.collect()] == [1]
    with pytest.raises(ValueError, match="equal parts"):
        vc.vector_codes(spark.createDataFrame([(1, [0.0] * 6, 1)], schema))
    with pytest.raises(ValueError, match="beyond"):
        vc.vector_codes(spark.createDataFrame([(1, [1e9] * 8, 1)], schema))


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (40, 16))
    x = centres[rng.integers(0, 40, 600)] + rng.integers(-300, 300, (600, 16))
    book = before = x[:64]
    at, upper, lower = np.zeros(600, np.int64), np.full(600, vc.FAR), np.zeros((600, 64), np.int64)
    work = []
    for _ in range(5):
        bound = vc.Bounds(book, before)
        at, upper, measured = bound.assign(x, at, upper, lower)
        true = vc.squares(x[:, None], book[None])
        assert (at == true.argmin(1)).all()
        assert (lower * lower <= true).all() and (upper * upper >= true[np.arange(600), at]).all()
        work.append(measured)
        lower = np.minimum(lower, 65535)
        before, book = book, np.array([x[at == e].sum(0) // max(1, (at == e).sum()) if (at == e).any() else book[e] for e in range(64)])
    assert work[0] <= 600 * 64 and max(work[2:]) < 600 * 64 / 4


def test_roots_are_exact():
    n = np.array([0, 1, 2, 3, 4, 15, 16, 17, (1 << 29) ** 2 - 1, (1 << 29) ** 2, (1 << 29) ** 2 + 1])
    floor, ceil = vc.floor_root(n), vc.ceil_root(n)
    assert (floor**2 <= n).all() and ((floor + 1) ** 2 > n).all() and (ceil**2 >= n).all() and ((ceil == 0) | ((ceil - 1) ** 2 < n)).all()


def test_the_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(map(tuple, vc.op13_vector_codes(spark, "/root/testdata/sf0.001").collect())) == sorted(con.execute(vc.OP13_SQL).fetchall())
