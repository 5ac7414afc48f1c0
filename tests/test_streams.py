"""Machines and silences on streams, stopped and started again, against the same over a batch table."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.streaming import states

SCHEMA = "client long, event_id long, at double, ok boolean, latency double"


def made(n=240):
    rng, at, rows = random.Random(3), 0.0, []
    for i in range(n):
        at += 0.01 if i < 70 else rng.choice([0.01, 0.2, 5.0, 40.0, 900.0])
        rows.append((rng.randrange(4), i, round(at, 3), rng.random() < 0.6, rng.choice([1.0, 20.0, 60.0, 100.0])))
    return rows


class Runs:
    """A folder of files in order of time, and a stream over it that ends when it has read what is there; each call goes on from the checkpoint."""

    def __init__(self, spark, root, build):
        self.spark, self.root, self.build = spark, root, build

    def put(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self):
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in").withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "1 second")
        query = self.build(source).writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/ck").trigger(availableNow=True).start()
        query.awaitTermination()

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.root}/out").collect()))


@pytest.mark.parametrize("machine", [states.Breaker, states.Alerts, states.Tasks, states.RateLimiter, states.Backpressure])
def test_machines_restart_from_their_state(spark, tmp_path, machine):
    rows = made()
    want = sorted(map(tuple, states.fold(spark.createDataFrame(rows, SCHEMA), machine).collect()))
    assert len({o for *_, o in want}) > 1 or machine is states.Backpressure
    runs = Runs(spark, tmp_path, lambda calls: states.fold_stream(calls, machine))
    for k in range(3):
        runs.put(rows[80 * k : 80 * k + 80])
        runs.run()
    assert runs.rows() == want


def test_silent_clients_lose_their_state(spark, tmp_path):
    """What has failed is forgotten after an hour without a call, and not before; and it is gone from the store when the watermark has passed."""
    rows = [(1, 1, 1.0, False, 5.0), (2, 2, 1.0, False, 5.0), (2, 3, 3000.0, True, 50.0), (3, 4, 5000.0, True, 50.0), (1, 5, 5001.0, True, 50.0), (2, 6, 5001.0, True, 50.0), (3, 7, 20_000.0, True, 50.0), (3, 8, 20_001.0, True, 50.0)]
    want = [(1, 1, "failed"), (1, 5, "processing"), (2, 2, "failed"), (2, 3, "failed"), (2, 6, "failed"), (3, 4, "processing"), (3, 7, "processing"), (3, 8, "processing")]
    assert sorted((r[0], r[1], r[3]) for r in states.fold(spark.createDataFrame(rows, SCHEMA), states.Tasks, 3600.0).collect()) == want
    runs = Runs(spark, tmp_path, lambda calls: states.fold_stream(calls, states.Tasks, idle=3600.0))
    for row in rows:
        runs.put([row])
        runs.run()
    assert [(r[0], r[1], r[3]) for r in runs.rows()] == want
    held = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "kept").load()
    assert {r.key[0] for r in held.collect()} == {3}


def test_silences_equal_the_batch(spark, tmp_path):
    rows = [(c, i, at * 1.0, ok, x) for c, i, at, ok, x in made(160)]
    idle = 1500.0
    want = sorted(map(tuple, states.idle_clients(spark.createDataFrame(rows, SCHEMA), idle).collect()))
    runs = Runs(spark, tmp_path, lambda calls: states.idle_clients_stream(calls, idle))
    for k in range(2):
        runs.put(rows[80 * k : 80 * k + 80])
        runs.run()
    end = rows[-1][2] + 10 * idle
    for k in range(2):  # two more calls, so that a batch begins behind the last silence
        runs.put([(99, 1000 + k, end + k, True, 1.0)])
        runs.run()
    assert [r for r in runs.rows() if r[0] != 99] == want and len(want) > 6
