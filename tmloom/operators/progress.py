"""Resume logic of the line chain: what is done, what is pending, what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions.text import strip


def latest_progress(progress: DataFrame) -> DataFrame:
    """(src, tgt): the last log row of each source wins."""
    return progress.groupBy("src").agg(F.max_by("tgt", "seq").alias("tgt"))


def pending(lines: DataFrame, progress: DataFrame, mark: str = fv.FAILURE_MARK) -> DataFrame:
    """Lines without a log row, or whose last one is the failure mark.

    Duplicate lines are all kept.
    """
    done = latest_progress(progress).where(~F.col("tgt").eqNullSafe(mark)).select("src")
    return lines.join(done, "src", "left_anti").select(*lines.columns)


def valid_history(progress: DataFrame, mark: str = fv.FAILURE_MARK) -> DataFrame:
    """Every log row with a real translation, not only the latest."""
    return progress.where((F.col("tgt") != mark) & (strip("tgt") != ""))


def extend_history(history: DataFrame, new: DataFrame, mark: str = fv.FAILURE_MARK) -> DataFrame:
    """History followed by the successful new rows; ``new.seq`` lies above history."""
    return history.select("seq", "src", "tgt").unionByName(
        new.where(F.col("tgt") != mark).select("seq", "src", "tgt")
    )


def restore_order(
    lines: DataFrame, latest: DataFrame, mark: str = fv.FAILURE_MARK
) -> DataFrame:
    """(row_id, src, tgt): each line with its latest target, or the mark.

    Rows carry ``row_id``; the ordered sink sorts once by it.
    """
    joined = lines.join(latest, "src", "left")
    return joined.select("row_id", "src", F.coalesce("tgt", F.lit(mark)).alias("tgt"))


def line_failures(df: DataFrame, mark: str = fv.FAILURE_MARK) -> DataFrame:
    return df.where(F.col("tgt") == mark)


def block_failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") != "ok")


def count_failed(df: DataFrame, mark: str = fv.FAILURE_MARK) -> DataFrame:
    """(total, failed) over restored lines."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("tgt") == mark).alias("failed")
    )


def count_pending(lines: DataFrame, progress: DataFrame, mark: str = fv.FAILURE_MARK) -> DataFrame:
    """(total, pending) at the start of a run."""
    done = latest_progress(progress).where(~F.col("tgt").eqNullSafe(mark))
    flagged = lines.join(done.select("src", F.lit(True).alias("_done")), "src", "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_done").isNull()).alias("pending")
    )


def exit_status(results: DataFrame) -> int:
    """0 when every block is ok, else 2; looks no further than the first failure."""
    return 0 if block_failures(results).isEmpty() else 2
