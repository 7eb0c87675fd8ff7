"""Incremental runs: new files arrive, finished work is skipped, results append.

What a micro-batch reads does not grow with the number of batches before it.
Which sources were seen is keyed state of the stream; open failures, the
postings that hints come from and the memory of documents are tables that each
batch adds to (see ``LevelTable``).  Each micro-batch is written under its own
id, so a batch that is repeated after a failure replaces its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tmloom.functions.text import tokens
from tmloom.operators import fuzzy
from tmloom.operators.attempts import Caller
from tmloom.operators.memory import merged_memory
from tmloom.operators.progress import latest_progress, valid_history
from tmloom.operators.scale import materialize
from tmloom.plans.parameters import DocumentParameters, LineParameters
from tmloom.plans.translate_documents import translate_documents
from tmloom.plans.translate_lines import send_lines
from tmloom.sources.files import MEMORY_SCHEMA, memory_defaults
from tmloom.sources.levels import LevelTable
from tmloom.sources.sinks import append_progress

_LOG_SCHEMA = "seq long, src string, tgt string, run_id string"
_POSTINGS = "token string, seq long, tok_pos int, src string, tgt string"
_OPEN = "place long, src string, tries int, next_seq long"  # and a row without source, which only bears next_seq
_ORDER = "struct<run:long,position:long>"
_MEMORY = f"seq {_ORDER}, first_seq {_ORDER}, doc_key string, {MEMORY_SCHEMA}"
MAX_BATCHES = 5  # micro-batches in which a line is sent before it stays failed
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run_id(batch_id: int) -> str:
    return f"batch-{batch_id:012d}"


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, src, tgt, run_id) of all runs so far."""
    return _read_or_empty(spark, path, _LOG_SCHEMA)


def memory_table(spark: SparkSession, path: str) -> LevelTable:
    """The memory of documents, by document: of each hash the latest entry and when it was first seen."""
    return LevelTable(spark, path, _MEMORY, ["doc_key"], merged_memory)


def memory_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, first_seq, doc_key, source_hash, result) of all runs so far; ``seq`` is (run, position)."""
    return memory_defaults(memory_table(spark, path).read())


def postings_table(spark: SparkSession, path: str, n: int) -> LevelTable:
    """The last ``n`` postings of each token, by token."""
    return LevelTable(spark, path, _POSTINGS, ["token"], lambda rows: fuzzy.last_postings(rows, n))


@dataclass(frozen=True)
class StoredPostings(fuzzy.PostingsIndex):
    """An index over a ``LevelTable`` of postings, as it was before a batch."""

    table: LevelTable | None = None
    before: int = 0

    def of_tokens(self, wanted: DataFrame) -> DataFrame:
        return self.table.read(wanted, self.before)


class FirstArrival(StatefulProcessor):
    """Passes the lines of a source on in the batch in which the source is new, and never again.

    Sources of the log that the stream starts with are known from the beginning.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.known.exists()
        for frame in rows:
            if fresh:
                yield frame
        if fresh:
            self.known.update((True,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((True,))

    def close(self) -> None:
        pass


def _open_at_start(log: DataFrame, mark: str) -> DataFrame:
    """Failures of the log that a stream starts with, tried as often as they were logged since the last success."""
    last = log.groupBy("src").agg(
        F.max_by("tgt", "seq").alias("tgt"), F.min("seq").alias("place"),
        F.max(F.when(F.col("tgt") != mark, F.col("seq"))).alias("good"),
    )
    tried = log.join(last.where(F.col("tgt") == mark).select("src", "place", "good"), "src").where(
        (F.col("tgt") == mark) & (F.col("good").isNull() | (F.col("seq") > F.col("good")))
    )
    return tried.groupBy("place", "src").agg(F.count(F.lit(1)).cast("int").alias("tries"))


def run_incremental(
    lines: DataFrame,
    progress_path: str,
    checkpoint: str,
    caller: Caller,
    verifier: Caller | None = None,
    params: LineParameters = LineParameters(),
    max_batches: int = MAX_BATCHES,
    segment: fuzzy.Segmenter = tokens,
) -> StreamingQuery:
    """Translate the new lines of a stream (row_id, src) and append the outcome.

    A line whose source was seen before, by this stream or in the log it started
    with, is not sent as a new one.  Sources that failed are sent again, before
    new ones and in the order they came, with each micro-batch, whether or not
    they arrive again; after ``max_batches`` micro-batches they stay failed.

    The log itself is read once, when the stream starts: a micro-batch reads the
    state of its own sources, the open failures that the batch before it left,
    and the postings of its own tokens.
    """
    spark = lines.sparkSession
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    mark = params.failure_mark
    n = params.postings_per_token
    index = postings_table(spark, f"{progress_path}/_postings", n)

    def leave(failed: DataFrame, next_seq: int, batch_id: int) -> None:
        """Write what the micro-batch ``batch_id`` will find open."""
        rows = failed.select("place", "src", "tries").unionByName(
            spark.range(1).select(
                F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("src"),
                F.lit(None).cast("int").alias("tries"),
            )
        )
        rows.withColumn("next_seq", F.lit(next_seq).cast("long")).write.mode("overwrite").parquet(
            f"{progress_path}/_open/{_run_id(batch_id)}"
        )

    def start(batch_id: int) -> None:
        """What the first micro-batch finds: failures and postings of the log so far."""
        log = progress_log(spark, progress_path).where(F.col("run_id") != _run_id(batch_id))
        last = log.agg(F.max("seq")).first()[0]
        failed = _open_at_start(log, mark).where(F.col("tries") < max_batches)
        leave(failed, 0 if last is None else last + 1, batch_id)
        posted = fuzzy.last_postings(fuzzy.postings(valid_history(log, mark), segment), n)
        index.append(posted.select(*[c.split()[0] for c in _POSTINGS.split(", ")]), batch_id)

    def step(fresh: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            start(batch_id)
        # the postings of batch k are run k + 1, those of the log run 0
        index.compact(before=batch_id + 1)
        before = spark.read.schema(_OPEN).parquet(f"{progress_path}/_open/{_run_id(batch_id)}")
        next_seq = before.agg(F.max("next_seq")).first()[0]
        waiting = before.where(F.col("src").isNotNull())
        fresh = materialize(fresh.select("row_id", "src"), "fresh")
        first = F.lit(-(1 << 62)) + F.col("place")  # before all new lines
        todo = fresh.unionByName(waiting.select(first.alias("row_id"), "src"))
        _, _, new_rows, after = send_lines(
            todo, StoredPostings((), n, segment, table=index, before=batch_id + 1), next_seq, caller, verifier, params
        )
        new_rows = materialize(new_rows, "new_rows")
        failed = latest_progress(new_rows).where(F.col("tgt") == mark).select("src")
        tried = fresh.groupBy("src").agg(F.lit(0).alias("tries")).withColumn(
            "place", F.lit(next_seq)
        ).unionByName(waiting.select("src", "tries", "place"))
        # new failures follow each other as they were sent
        sent = new_rows.groupBy("src").agg(F.min("seq").alias("sent"))
        still = tried.join(failed, "src").join(sent, "src").select(
            F.when(F.col("tries") == 0, F.col("sent")).otherwise(F.col("place")).alias("place"), "src",
            (F.col("tries") + 1).alias("tries"),
        )
        posted = fuzzy.last_postings(fuzzy.postings(valid_history(new_rows, mark), segment), n)
        index.append(posted.select(*[c.split()[0] for c in _POSTINGS.split(", ")]), batch_id + 1)
        leave(still.where(F.col("tries") < max_batches), after, batch_id + 1)
        append_progress(new_rows, progress_path, _run_id(batch_id))

    # a first batch that is repeated finds its own rows in the log; its sources are still new
    earlier = progress_log(spark, progress_path).where(F.col("run_id") != _run_id(0))
    seen = earlier.select("src").distinct().groupBy("src")
    arrivals = lines.select("row_id", "src").groupBy("src").transformWithStateInPandas(
        FirstArrival(), outputStructType="row_id long, src string", outputMode="Append", timeMode="None",
        initialState=seen,
    )
    return (
        arrivals.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh_memory_per_batch(
    pages: DataFrame,
    memory_path: str,
    results_path: str,
    checkpoint: str,
    caller: Caller,
    params: DocumentParameters = DocumentParameters(),
) -> StreamingQuery:
    """Translate the new pages of a stream; each micro-batch sees the memory left
    by the ones before it and adds its own successful blocks at its end.

    Memory is scoped by document: a micro-batch reads the entries of its own
    documents, out of few runs that are merged as they grow in number.
    """
    table = memory_table(pages.sparkSession, memory_path)

    def step(arrived: DataFrame, batch_id: int) -> None:
        table.compact(before=batch_id)
        seen = materialize(table.read(arrived.select("doc_key"), batch_id), "memory")
        run = translate_documents(arrived, memory_defaults(seen), caller, params)
        # results are written first: they are a stored table, and the new
        # memory entries follow from them and from the memory of earlier runs
        run.results.write.mode("overwrite").parquet(f"{results_path}/run_id={_run_id(batch_id)}")
        order = F.struct(F.lit(batch_id).cast("long").alias("run"), F.col("seq").alias("position"))
        new = run.new_memory.withColumn("seq", order).withColumn("first_seq", F.col("seq"))
        table.append(new.select("seq", "first_seq", "doc_key", "source_hash", "result"), batch_id)

    return (
        pages.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
