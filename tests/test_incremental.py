"""Runs that go on where the last one stopped."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import flows, generate, incremental

SCHEMA = "doc_id long, text string"
LISTER = flows.Lister("license")
TYPES = lambda docs: docs.select("doc_id", F.lit("OTHER").alias("doc_type"))
STEP = lambda docs: incremental.extracted(docs, TYPES, LISTER, {"OTHER": "{text}\n"})


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        folder = str(tmp_path / "cache")

        def put(self, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def run(self, step=STEP, version="1"):
            return incremental.run(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), self.folder, step, version)

        def rows(self):
            return {r.doc_id: (r.total, r.verified, r.batch) for r in incremental.latest(incremental.cached(spark, self.folder)).collect()}

    return Place()


def test_only_what_is_new_or_changed_is_worked_on(place):
    place.put([(1, "a license line of this text\nand another"), (2, "nothing of note"), (3, None), (4, "x license of it\n" + "y " * 300)])
    assert place.run() == 4
    first = place.rows()
    assert {k: v[:2] for k, v in first.items()} == {1: (1, 1), 2: (0, 0), 3: (0, 0), 4: (1, 1)}
    assert place.run() == 0 and place.rows() == first
    place.put([(1, "a license line of this text\nand another"), (2, "now with its license in a line"), (5, "")])
    assert place.run() == 2
    assert place.rows() == first | {2: (1, 1, 1), 5: (0, 0, 1)}


def test_a_run_that_broke_off_ends_in_the_same_table(place, spark):
    place.put([(1, "first license line here"), (2, "second license line here")])

    def broken(docs):
        out = STEP(docs)
        return out.withColumn("error", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("executor lost")).cast("string")).otherwise(F.col("error")))

    with pytest.raises(Exception, match="executor lost"):
        place.run(broken)
    assert place.rows() == {}
    assert place.run() == 2 and {k: v[:2] for k, v in place.rows().items()} == {1: (1, 1), 2: (1, 1)}

    # a batch that was written whole before the run broke off replaces itself
    place.put([(3, "third license line here")])
    calls = []

    def late(docs):
        if not calls:
            calls.append(1)
            STEP(docs).withColumn("version", F.lit("1")).select(*(c.split()[0] for c in incremental.CACHE.split(", "))).write.mode("overwrite").parquet(f"{place.folder}/results/batch=1")
            raise RuntimeError("driver lost")
        return STEP(docs)

    with pytest.raises(Exception, match="driver lost"):
        place.run(late)
    assert place.run(late) == 1
    assert incremental.cached(spark, place.folder).groupBy("doc_id").count().where("count > 1").count() == 0 and place.rows()[3] == (1, 1, 1)


def test_replies_that_fail_are_rows(place, spark):
    place.put([(1, "a license here"), (2, "poison")])
    step = lambda docs: incremental.extracted(docs, TYPES, generate.Echo(poison="poison"), {"OTHER": "{text}\n"})
    assert place.run(step) == 2
    rows = {r.doc_id: r for r in incremental.cached(spark, place.folder).collect()}
    assert (rows[2].failed, rows[2].error) == (1, "ValueError: refused: poison") and (rows[1].failed, rows[1].error, rows[1].total) == (1, "no JSON", 0)


def test_a_model_is_asked_once_about_a_window(place, tmp_path):
    place.put([(1, "a license line\n" + "y " * 300), (2, "license here"), (3, "none")])
    asked = tmp_path / "asked"

    class Noted(flows.Lister):  # notes every call in a file; a local class, which workers get by value
        def reply(self, prompt, max_tokens):
            with open(self.path, "a") as f:
                f.write("x")
            return super().reply(prompt, max_tokens)

    noted = Noted("license")
    noted.path = str(asked)
    assert place.run(lambda docs: incremental.extracted(docs, TYPES, noted, {"OTHER": "{text}\n"})) == 3
    assert len(asked.read_text()) == 3
