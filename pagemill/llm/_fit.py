"""What the two classifiers share: the fold of a document, and bounded samples of labelled rows to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out of learning: crc32 of the id as text leaves no remainder; so is a row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample_by_class(rows: DataFrame, class_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each class, all where there are fewer: those with the smallest hash of ``_id``.

    The share to take follows from the counts of the classes, so one more pass over the rows takes them.
    """
    counts = rows.groupBy(class_col).count().collect()  # a row per class
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(class_col) == F.lit(r[class_col]), min(1.0, per_class / r["count"])).otherwise(share)
    unit = F.shiftrightunsigned(F.xxhash64("_id"), 11).cast("double") / float(1 << 53)
    return rows.where(unit < share)
