"""Shared plumbing: tables in the cluster's shared folder, and walking sorted Arrow streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs on one machine, as in tests, is a temporary folder made, once a session.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, so that a batch of long texts stays small in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


class Scratch:
    """Intermediate tables, written once as Parquet in the shared folder.

    A written table cuts the lineage and outlives lost executors, so what is read twice is written first.
    ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and hasattr(df, "_scratch_path"):
                jvm = self.spark._jvm
                path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) for each run of equal keys of a stream that is sorted by them.

    Holds one group and one batch at a time; callers bound the size of a group.
    """
    import numpy as np

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for k in keys:
            column = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            part = table.slice(a, b - a)
            yield tuple(part.column(k)[0].as_py() for k in keys), part
        held = table.slice(cuts[-2])
    if held is not None:
        yield tuple(held.column(k)[0].as_py() for k in keys), held
