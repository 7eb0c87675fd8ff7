"""Scoring chain: pairs to batched prompts to one score per pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions.responses import parameter_score
from tmloom.operators import attempts as a
from tmloom.operators import batches as b
from tmloom.operators.prompts import score_prompts


@dataclass(frozen=True)
class ScoreRun:
    requests: DataFrame
    attempts: DataFrame
    scored: DataFrame  # row_id, source, target, score_raw, score, parameter_score


def plan_requests(pairs: DataFrame, size: int = fv.SCORE_BATCH_SIZE) -> DataFrame:
    packed = b.score_requests(b.assign_batches(pairs, size))
    return score_prompts(packed).withColumns(
        {"request_id": F.col("batch"), "payload": F.col("user_text")}
    )


def attach_scores(filled: DataFrame) -> DataFrame:
    """(row_id, source, target, score_raw, score, parameter_score) per pair."""
    zipped = F.arrays_zip("row_ids", "sources", "targets", "scores")
    return filled.select(F.explode(zipped).alias("_z")).select(
        F.col("_z.row_ids").alias("row_id"),
        F.col("_z.sources").alias("source"),
        F.col("_z.targets").alias("target"),
        F.col("_z.scores").alias("score_raw"),
        F.col("_z.scores").try_cast("int").alias("score"),
        parameter_score("_z.sources", "_z.targets").alias("parameter_score"),
    )


def score_pairs(
    pairs: DataFrame,
    caller: a.Caller,
    size: int = fv.SCORE_BATCH_SIZE,
    max_attempts: int = fv.SCORE_MAX_ATTEMPTS,
    already_scored: DataFrame | None = None,
    retry_pause: float = fv.SCORE_RETRY_PAUSE_SECONDS,
) -> ScoreRun:
    """Score all pairs; with ``already_scored`` (row_id) only the missing ones."""
    if already_scored is not None:
        pairs = pairs.join(already_scored.select("row_id"), "row_id", "left_anti")
    requests, tried = a.run_waves(
        plan_requests(pairs, size),
        caller,
        a.score_judge,
        max_attempts,
        delay=a.score_delay(retry_pause),
    )
    resolved = a.resolve_attempts(tried, max_attempts, ["scores"])
    return ScoreRun(requests, tried, attach_scores(a.fill_failed_scores(requests, resolved)))
