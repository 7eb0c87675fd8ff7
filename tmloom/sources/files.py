"""File sources: line files, append logs, scored pairs, memory logs.

Every reader returns a unique, order-carrying id, because row order is part of
the data model and a DataFrame has none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERM_PAIRS = "array<struct<source:string,target:string>>"
RESULT_SCHEMA = (
    "struct<page:int,block_id:string,source_text:string,translation:string,"
    f"term_pairs:{TERM_PAIRS},attempts:int,elapsed_seconds:double,status:string,"
    "error_message:string,cache_hit:boolean>"
)
MEMORY_SCHEMA = f"source_hash string, result {RESULT_SCHEMA}"
MEMORY_BUCKETS = 64  # folders of one run of a memory log

_FILE_BITS = 40  # bytes and rows of one file
_MOST_FILES = 1 << (63 - _FILE_BITS)


def natural_rank(paths: list[str]) -> dict[str, int]:
    """Place of each path when runs of digits in it compare as numbers."""

    def parts(path: str) -> list:
        return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", path)]

    return {path: n for n, path in enumerate(sorted(paths, key=parts))}


def with_file_order(df: DataFrame, out: str) -> DataFrame:
    """Add ``out``: a unique long that follows (file, position in file).

    Files rank by the listing that planning made, part 10 after part 9; no
    second scan.  Inside a file, a row's place is the byte at which its split
    starts plus its number in the task.  That number counts the rows before it,
    each at least a byte long, so it stays below the start of the next split;
    a task with several splits holds last or whole files only.  Reading more
    files, or larger ones, than the id has room for raises.
    """
    ranks = natural_rank(df.inputFiles())
    if len(ranks) > _MOST_FILES:
        raise ValueError(f"{len(ranks)} files are more than {_MOST_FILES}; read them in parts")
    spark = df.sparkSession
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/")  # noqa: E731  written either way
    ranked = spark.createDataFrame(list(ranks.items()), "_path string, _rank long").withColumn(
        "_path", plain(F.col("_path"))
    )
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = df.withColumns(
        {
            "_path": plain(F.col("_metadata.file_path")),
            "_place": F.col("_metadata.file_block_start") + in_task,
        }
    )
    place = F.when(F.col("_place") < (1 << _FILE_BITS), F.col("_place")).otherwise(
        F.raise_error(F.concat(F.lit("too large a file for row ids: "), "_path"))
    )
    return tagged.join(ranked, "_path").select(
        F.shiftleft("_rank", _FILE_BITS).bitwiseOR(place).alias(out), *df.columns
    )


def _csv(spark: SparkSession, path: str, schema: str, multi_line: bool, **options) -> DataFrame:
    reader = spark.read.schema(schema).options(
        header=False, escape='"', enforceSchema=True, multiLine=multi_line, **options
    )
    return reader.csv(path)


def read_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One-column headerless CSV as (row_id, src); unquoted commas stay in the text.

    ``multi_line`` accepts line feeds inside quotes; such files cannot be split
    between tasks.
    """
    raw = _csv(spark, path, "src string", multi_line, sep="\u0001")
    return with_file_order(raw, "row_id")


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    """A log that does not exist yet is empty."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The log of ``append_progress`` as (seq, src, tgt), with the order it was written in."""
    schema = "seq long, src string, tgt string"
    return _or_empty(spark, schema, lambda: spark.read.schema(f"{schema}, run_id string").parquet(path).drop("run_id"))


def read_progress_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A headerless two-column file as (seq, src, tgt), in file order."""
    schema = "src string, tgt string"
    return _or_empty(
        spark, f"seq long, {schema}", lambda: with_file_order(_csv(spark, path, schema, multi_line), "seq")
    )


def read_pairs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Pairs to score as (row_id, source, target); a missing target is empty."""
    raw = _csv(spark, path, "source string, target string", multi_line)
    return with_file_order(raw, "row_id").withColumn(
        "target", F.coalesce("target", F.lit(""))
    )


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored pairs with their header row, as (row_id, source, target, score_raw, score)."""
    raw = spark.read.schema("Source string, Target string, Score string").options(
        header=True, escape='"', enforceSchema=True
    ).csv(path)
    return with_file_order(raw, "row_id").select(
        "row_id",
        F.col("Source").alias("source"),
        F.col("Target").alias("target"),
        F.col("Score").alias("score_raw"),
        F.col("Score").try_cast("int").alias("score"),
    )


def read_texts(spark: SparkSession, path: str, doc_keys: Sequence[str] | None = None) -> DataFrame:
    """(doc_key, place, value) of what ``write_document`` or ``write_review`` left; ``place`` orders a text's rows.

    With ``doc_keys`` the index tells the files that hold them, and only these
    are read.
    """
    rows = spark.read.parquet(f"{path}/rows")
    if doc_keys is not None:
        index = spark.read.parquet(f"{path}/index").where(F.col("doc_key").isin(list(doc_keys)))
        names = sorted(r[0] for r in index.select("file").distinct().collect())
        if names:
            rows = spark.read.parquet(*[f"{path}/rows/{n}" for n in names])
        rows = rows.where(F.col("doc_key").isin(list(doc_keys)))
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select("doc_key", place.alias("place"), "value")


def memory_defaults(df: DataFrame) -> DataFrame:
    """Fill the optional fields of a memory entry."""
    r = F.col("result")
    return df.withColumn(
        "result",
        F.struct(
            r["page"].alias("page"),
            r["block_id"].alias("block_id"),
            r["source_text"].alias("source_text"),
            r["translation"].alias("translation"),
            F.coalesce(r["term_pairs"], F.array().cast(TERM_PAIRS)).alias("term_pairs"),
            F.coalesce(r["attempts"], F.lit(0)).alias("attempts"),
            F.coalesce(r["elapsed_seconds"], F.lit(0.0)).alias("elapsed_seconds"),
            F.coalesce(r["status"], F.lit("ok")).alias("status"),
            F.coalesce(r["error_message"], F.lit("")).alias("error_message"),
            F.coalesce(r["cache_hit"], F.lit(False)).alias("cache_hit"),
        ),
    )


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines memory as (seq, doc_key, source_hash, result), in file order; bad JSON fails."""
    schema = f"doc_key string, {MEMORY_SCHEMA}"
    return _or_empty(
        spark, f"seq long, {schema}",
        lambda: memory_defaults(
            with_file_order(spark.read.schema(schema).option("mode", "FAILFAST").json(path), "seq")
        ),
    )


def read_memory_log(spark: SparkSession, path: str, doc_key: str | None = None, buckets: int = MEMORY_BUCKETS) -> DataFrame:
    """The log of ``append_memory`` as (seq, doc_key, source_hash, result).

    ``seq`` is (run, position), so entries of later runs come later.  Asking for
    one ``doc_key`` reads that document's bucket only.
    """
    schema = f"seq long, doc_key string, {MEMORY_SCHEMA}, run_id string, bucket int"

    def read() -> DataFrame:
        log = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        if doc_key is not None:
            bucket = F.pmod(F.xxhash64(F.lit(doc_key)), F.lit(buckets)).cast("int")
            log = log.where((F.col("bucket") == bucket) & (F.col("doc_key") == doc_key))
        order = F.struct(F.col("run_id").alias("run"), F.col("seq").alias("position"))
        return memory_defaults(log.select(order.alias("seq"), "doc_key", "source_hash", "result"))

    empty = f"seq struct<run:string,position:long>, doc_key string, {MEMORY_SCHEMA}"
    return _or_empty(spark, empty, read)
