"""Exact dedup and SimHash near-dedup against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import Row

from pagemill.llm.components import components
from pagemill.llm.exact_dedup import exact_dedup, misra_gries
from pagemill.llm.simhash import fingerprint, fingerprint_links, simhash_dedup
from pagemill.llm._spark import Scratch

SCHEMA = "doc_id long, text string, keep_id string, _digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_misra_gries_keeps_every_frequent_item():
    rng = random.Random(1)
    items = [b"hot"] * 400 + [b"warm"] * 250 + [str(i).encode() for i in range(350)]
    rng.shuffle(items)
    for k in (1, 3, 10):
        held = misra_gries(iter(items), k)
        assert len(held) <= k
        assert all(x in held for x, n in Counter(items).items() if n > len(items) / (k + 1))


def test_exact_dedup_matches_a_plain_version(spark):
    rng = random.Random(2)
    texts = [None, "", "A", "a", "É", "é", "x y", "X Y", "hot line", "long " * 30_000]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(100 + i, "HOT line") for i in range(60)] + [(None, "a"), (7, "seven"), (7, "seven")]
    for counters in (1, 1000):
        got = exact_dedup(frame(spark, rows), counters=counters).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[lower(t)].append(i)
        assert len(got) == len(rows)
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and set(kept) == set(by_hash)
        for r in got:
            ids = by_hash[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
            assert not r.kept or r.doc_id == r.keep_id


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 80)] + [(200, i) for i in range(201, 260)] + [(500, 500)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    rng.shuffle(links)
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for x in sorted(near):
        stack = [] if x in want else [x]
        while stack:
            y = stack.pop()
            if y not in want:
                want[y] = x
                stack += near[y]
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    assert {r.node: r.label for r in components(df, Scratch(spark, "t")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    least = {}
    for i, lab in zip(ids, label):
        least[lab] = min(least.get(lab, i), i)
    return [least[lab] for lab in label]


def test_fingerprint():
    for t in (None, "", " \t\n\x0b\x0c\r ", "One", "one TWO", "a b c", "a b c d a b c", "É é x y z", "w " * 70_000 + "x y z"):
        assert fingerprint(t) == plain_fingerprint(t)


def test_simhash_matches_a_plain_version(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice((2, 40, 300)))] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(100, 260):  # near copies of few texts, many of one
        copy = list(base[rng.choice((0, 0, 0, 1, 2, 3))])
        copy[rng.randrange(len(copy))] = "other%d" % rng.randrange(50)
        rows.append((i, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "  "), (903, rows[5][1]), (903, rows[5][1])]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip((i for i, _ in rows), ("%016x" % f for f in fps), plain_components([i for i, _ in rows], fps)))
    for small, tokens in ((2, 1), (2, 4), (32, None), (8, 3), (32, 5)):
        got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup(frame(spark, rows), small=small, tokens=tokens).collect())
        assert got == want
    named = [(f"k{i:03}", t) for i, t in rows[:50]]
    got = simhash_dedup(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert sorted(r.component_id for r in got) == sorted(f"k{i:03}" for i in plain_components([i for i, _ in rows[:50]], fps[:50]))


def test_index_finds_every_pair_of_fingerprints(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(600)}
    for x in list(fps)[:200]:
        fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4)))))
    hub = rng.getrandbits(64)
    fps |= {hub ^ sum(1 << b for b in rng.sample(range(24), rng.choice((1, 2, 3)))) for _ in range(300)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    pairs = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    distinct = spark.createDataFrame([(x,) for x in fps], "_fp long").repartition(3)
    for small, tokens in ((1000, 1), (1000, 2), (1000, 5)):
        got = Counter((min(r.u, r.v), max(r.u, r.v)) for r in fingerprint_links(distinct, Scratch(spark, "t"), small, tokens).collect())
        assert set(got) == pairs and set(got.values()) == {1}  # each pair is reported once


def test_simhash_of_nothing(spark):
    assert simhash_dedup(frame(spark, [])).count() == 0
