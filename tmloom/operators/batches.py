"""Ordered batch packing and positional alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions.text import strip
from tmloom.operators.scale import global_rank


def assign_batches(
    df: DataFrame,
    size: int = fv.LINE_BATCH_SIZE,
    id_col: str = "row_id",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add (batch, pos): consecutive rows in ``id_col`` order, ``size`` per batch."""
    ranked = global_rank(df, id_col, "_rank", ties)
    return ranked.withColumns(
        {
            "batch": F.floor(F.col("_rank") / size).cast("long"),
            "pos": (F.col("_rank") % size).cast("int"),
        }
    ).drop("_rank")


def _packed(batched: DataFrame, *cols: str) -> DataFrame:
    """One row per batch with its rows in order; a batch is at most one request."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *cols)))
    return batched.groupBy("batch").agg(rows.alias("_rows"))


def batch_requests(batched: DataFrame) -> DataFrame:
    """(batch, row_ids, sources, expected_lines, input_text)."""
    return _packed(batched, "row_id", "src").select(
        "batch",
        F.col("_rows.row_id").alias("row_ids"),
        F.col("_rows.src").alias("sources"),
        F.size("_rows").alias("expected_lines"),
        F.array_join("_rows.src", "\n").alias("input_text"),
    )


def score_requests(batched: DataFrame) -> DataFrame:
    """(batch, row_ids, sources, targets, expected_lines, input_text) for scoring."""

    def line(r: Column) -> Column:
        return F.concat(strip(r["source"]), F.lit(", "), strip(r["target"]), F.lit("\n"))

    return _packed(batched, "row_id", "source", "target").select(
        "batch",
        F.col("_rows.row_id").alias("row_ids"),
        F.col("_rows.source").alias("sources"),
        F.col("_rows.target").alias("targets"),
        F.size("_rows").alias("expected_lines"),
        F.array_join(F.transform("_rows", line), "").alias("input_text"),
    )


def align_lines(batches: DataFrame, lines: str = "lines") -> DataFrame:
    """(batch, pos, row_id, src, tgt): the i-th output line belongs to the i-th input."""
    zipped = F.arrays_zip("row_ids", "sources", F.col(lines).alias("lines"))
    return batches.select("batch", F.posexplode(zipped).alias("pos", "_z")).select(
        "batch",
        "pos",
        F.col("_z.row_ids").alias("row_id"),
        F.col("_z.sources").alias("src"),
        F.col("_z.lines").alias("tgt"),
    )


def batch_audit(requests: DataFrame, size: int = fv.LINE_BATCH_SIZE) -> DataFrame:
    """(batch_index, tm_count, tm_content, input_text): what each batch was sent."""
    return requests.select(
        (F.col("batch") * size).alias("batch_index"),
        F.size("tm_list").alias("tm_count"),
        F.to_json("tm_list").alias("tm_content"),
        "input_text",
    )
