"""The pipeline on a small table, stage by stage, and the query as a whole."""

import random

import pytest

import corpus_pipeline
from pagemill.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(root / str(k)))
        docs = spark.read.parquet(str(root / str(k)))
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.dtypes == before.dtypes and 0 < after.count() <= before.count()


def test_stages_take_effect(stages, spark):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[5] == ids[4]
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic - ids[1]) >= 0.8 * len(toxic) and len(clean & ids[1]) >= 0.9 * len(clean)
    assert len(ids[2]) >= 0.98 * len(ids[1])


def test_packing_holds_every_document_once(stages):
    rows = stages[5].toPandas()
    assert not rows.duplicated(["doc_id", "piece"]).any()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.values == [0, *g.length.cumsum()[:-1]]).all() and g.length.sum() <= 1024


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, DATA).select(columns).collect()) == sorted(stages[5].select(columns).collect())


def test_queries_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.queries())
    assert numbers == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_odd_tables(spark):
    rng = random.Random(1)
    clashing = ["score", "_text", "_toxicity", "_language", "_kept", "_row", "_group", "_id", "_ld_a", "_ld_b", "_ld_gone", "found", "doc id.x"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashing)
    none, more = (None,) * len(clashing), ("a",) * len(clashing)
    rows = [(None, None, None, None, None, *none), (1, "", "en", "s", 0, *more), (2, "word " * 40_000, "en", "s", 1, *more), (2, "word " * 40_000, "en", "s", 1, *more)]
    rows += [(10 + i, " ".join(rng.choice("der die und das sein".split() if i % 2 else "the and of to is".split()) for _ in range(60)), "de" if i % 2 else "en", "s", 1, *none) for i in range(40)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()


def test_one_row_of_each_group_of_near_copies_stays(spark):
    text = " ".join(f"word{i}" for i in range(400))
    near = text + " more"
    rows = [(None, text)] * 5 + [(7, text)] * 3 + [(3, near), (3, text)] + [(None, "quite another text")] * 4 + [(9, "a third text stands here alone"), (9, "and a fourth one is not like it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()
    assert sorted((str(r.doc_id) for r in got)) == ["3", "9", "9", "None"]
    assert {r.text for r in got} >= {"quite another text", "a third text stands here alone", "and a fourth one is not like it"}
