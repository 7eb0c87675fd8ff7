"""Requests as tables: what is sent to a model, one row per call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.operators.hints import BLOCK_KEY


def block_prompts(
    blocks: DataFrame, hints: DataFrame, system: str = fv.BLOCK_SYSTEM
) -> DataFrame:
    """Blocks with ``system_text`` and ``user_text``; hints only where there are some."""
    lines = F.transform(
        "hints", lambda h: F.concat(F.lit("- "), h["source"], F.lit(" => "), h["target"])
    )
    glossary = F.when(
        F.size("hints") > 0,
        F.concat(F.lit(fv.BLOCK_HINTS_HEAD), F.array_join(lines, "\n"), F.lit(fv.BLOCK_HINTS_TAIL)),
    )
    user = F.concat(
        F.lit(fv.BLOCK_ID_LABEL), "block_id", F.lit("\n"),
        F.lit(fv.BLOCK_PAGE_LABEL), F.col("page").cast("string"), F.lit("\n"),
        F.lit(fv.BLOCK_ASK), "source_text", F.coalesce(glossary, F.lit("")),
    )
    return (
        blocks.join(hints.hint("merge"), BLOCK_KEY, "left")
        .withColumns({"system_text": F.lit(system), "user_text": user})
        .drop("hints")
    )


def line_requests(
    batches: DataFrame,
    tm_lists: DataFrame,
    instruction: str = fv.LINE_INSTRUCTION,
    source_lang: str = fv.SOURCE_LANG,
    target_lang: str = fv.TARGET_LANG,
) -> DataFrame:
    """Batches with their ``tm_list`` and the JSON ``options`` of the call."""
    none = F.array().cast("array<struct<source:string,target:string>>")
    joined = batches.join(tm_lists.hint("merge"), "batch", "left").withColumn(
        "tm_list", F.coalesce("tm_list", none)
    )
    options = F.to_json(
        F.struct(
            F.lit(source_lang).alias("source_lang"),
            F.lit(target_lang).alias("target_lang"),
            "tm_list",
            F.lit(instruction).alias("domains"),
        )
    )
    return joined.withColumn("options", options)


def score_prompts(batches: DataFrame) -> DataFrame:
    """Score batches with ``system_text`` and ``user_text``."""
    return batches.withColumns(
        {
            "system_text": F.lit(fv.SCORE_SYSTEM),
            "user_text": F.concat(
                F.lit(fv.SCORE_RUBRIC_HEAD), "input_text", F.lit(fv.SCORE_RUBRIC_TAIL)
            ),
        }
    )


def verify_prompts(
    pairs: DataFrame, sources: str = "sources", candidates: str = "candidates"
) -> DataFrame:
    """Add ``user_text`` asking whether two lists of equal length correspond;
    lists of different lengths need no question and are left out."""
    question = F.concat(
        F.lit(fv.VERIFY_HEAD),
        F.lit(fv.VERIFY_SOURCE_LABEL), F.array_join(sources, "\n"), F.lit("\n\n"),
        F.lit(fv.VERIFY_TARGET_LABEL), F.array_join(candidates, "\n"),
    )
    return pairs.where(F.size(sources) == F.size(candidates)).withColumn("user_text", question)
