"""Held-out folds and bounded training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BINS = 1 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def bounded_sample(
    df: DataFrame, id_col: str, class_col: str, rows: int, seed: int = 0
) -> tuple[DataFrame, dict]:
    """About ``rows`` rows of each class at most, chosen by a hash of the id; and all classes' counts.

    A class with fewer rows is taken whole.  The classes are few; their counts
    are one small aggregate.
    """
    counts = df.groupBy(class_col).count().collect()
    share = F.lit(0)
    for c in counts:
        if c[0] is not None:
            share = F.when(
                F.col(class_col) == F.lit(c[0]), F.lit(int(_BINS * min(1.0, rows / c["count"])))
            ).otherwise(share)
    chosen = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(_BINS)) < share)
    return chosen, {c[0]: c["count"] for c in counts}


def bounded_labels(labels: DataFrame, id_col: str, class_col: str, rows: int) -> tuple[DataFrame, dict]:
    """At most ``rows`` ids of class 0 and of class 1, the first by a hash; and both classes' counts.

    The result holds ``2 * rows`` small rows at most, so it may be broadcast.
    """
    known = labels.select(id_col, F.col(class_col).cast("int").alias(class_col)).where(
        F.col(class_col).isin(0, 1)
    )
    counts = {c[0]: c["count"] for c in known.groupBy(class_col).count().collect()}
    first = [
        known.where(F.col(class_col) == k).orderBy(F.xxhash64(id_col), id_col).limit(rows)
        for k in (0, 1)
    ]
    return first[0].unionByName(first[1]), counts
