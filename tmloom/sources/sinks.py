"""Sinks.  Appends carry the id of their run; ordered output goes to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.sources.files import MEMORY_BUCKETS

TEXT_FILES = 64  # of one run's documents, and of its reviews
_QUOTED = {"escape": '"', "emptyValue": ""}


def append_progress(df: DataFrame, path: str, run_id: str) -> None:
    """Append finished rows (failed ones too) so that a rerun can resume.

    ``read_progress`` reads them back with their ``seq``.  Each run writes its
    own ``run_id`` folder, so a run that is repeated after a failure replaces
    its rows instead of doubling them.
    """
    df.select("seq", "src", "tgt").write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def write_ordered(df: DataFrame, path: str, order_by: str = "row_id") -> None:
    """Headerless CSV in row order: a range sort, so part files follow each other."""
    rows = df.orderBy(order_by).drop(order_by)
    rows.write.mode("errorifexists").options(header=False, **_QUOTED).csv(path)


def write_scored(df: DataFrame, path: str, run_id: str) -> None:
    """``Source,Target,Score`` rows of one run with a header, in row order.

    Run folders follow each other by name; a repeated run replaces its own.
    """
    rows = df.orderBy("row_id").select("Source", "Target", "Score")
    rows.write.mode("overwrite").options(header=True, **_QUOTED).csv(f"{path}/run_id={run_id}")


def write_tables(
    extracted: DataFrame, bilingual: DataFrame, glossary: DataFrame, path: str, compression: str = "gzip"
) -> dict:
    """Extraction, bilingual and glossary tables as CSV with headers, compressed since they repeat their texts."""
    out = {}
    for name, df in (("extracted", extracted), ("bilingual", bilingual), ("glossary", glossary)):
        out[name] = f"{path}/{name}"
        df.write.mode("errorifexists").options(
            header=True, compression=compression, **_QUOTED
        ).csv(out[name])
    return out


def write_results_json(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """All results with nested term pairs, as JSON lines per document, compressed since names and terms repeat."""
    df.write.mode("errorifexists").options(ignoreNullFields=False, compression=compression).json(path)


def append_memory(
    df: DataFrame, path: str, run_id: str, buckets: int = MEMORY_BUCKETS, split: int = 4
) -> None:
    """Append {seq, doc_key, source_hash, result} JSON lines under the run's folder.

    Run ids must sort in the order of the runs; a repeated run replaces its
    rows.  Documents are hashed to ``buckets`` folders of at most ``split``
    files each, whatever their number, and lie together inside a file; one large
    document is written by ``split`` tasks.
    """
    rows = df.select("doc_key", "seq", "source_hash", "result").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_key"), F.lit(buckets)).cast("int")
    )
    (
        rows.repartition(buckets * split, "bucket", F.pmod(F.xxhash64("source_hash"), F.lit(split)))
        .sortWithinPartitions("bucket", "doc_key", "seq")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .json(f"{path}/run_id={run_id}")
    )


def _write_texts(rows: DataFrame, order: list[str], path: str, files: int) -> None:
    """Rows (``order``, ``value``) of many texts in at most ``files`` files, and an index of where each text lies.

    The files hold ranges of the order, so a short text lies in one file and a
    huge one in several that follow each other.  The index has a row for each
    text and file: ``doc_key``, ``file``, ``first_row`` and ``rows``.
    """
    placed = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    placed.write.mode("errorifexists").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    (
        written.groupBy("doc_key", F.col("_metadata.file_name").alias("file"))
        .agg(F.min("_metadata.row_index").alias("first_row"), F.count(F.lit(1)).alias("rows"))
        .repartitionByRange(max(1, files // 16), "doc_key").sortWithinPartitions("doc_key", "file")
        .write.mode("errorifexists").parquet(f"{path}/index")
    )


def write_document(parts: DataFrame, path: str, files: int = TEXT_FILES) -> None:
    """Assembled documents, paragraphs in order, in ``files`` files whatever their number."""
    order = ["doc_key", "page", "part", "block_no"]
    _write_texts(parts.select(*order, F.col("text").alias("value")), order, path, files)


def write_review(lines: DataFrame, path: str, files: int = TEXT_FILES) -> None:
    """Review reports as Markdown lines, in order, in ``files`` files whatever their number."""
    order = ["doc_key", "section", "page", "block_no"]
    _write_texts(lines.select(*order, F.col("line").alias("value")), order, path, files)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("errorifexists").json(path)
