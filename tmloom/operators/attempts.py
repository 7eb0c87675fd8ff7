"""Model calls staged as tables: requests, attempts, resolved results.

A model call is slow and not repeatable, so each wave of attempts is written
once and read back.  A lost executor then costs no second call, and acceptance,
retry and resolution stay ordinary DataFrame work on the written attempts.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions import responses as r
from tmloom.operators.journal import Journal, answered, request_key
from tmloom.operators.prompts import verify_prompts
from tmloom.operators.scale import materialize

# model(request) -> {"body": text, "status_code": int, "retry_after": text}
Model = Callable[[dict], dict]
# caller(requests, attempt number) -> attempts
Caller = Callable[[DataFrame, int], DataFrame]
Judge = Callable[[DataFrame], DataFrame]
Delay = Callable[[], Column]  # seconds to wait, over a judged attempt

ATTEMPT_FIELDS = (
    "attempt int, status_code int, retry_after string, body string, "
    "error_message string, elapsed_seconds double"
)


def document_delay(base: float = fv.RETRY_BASE_DELAY, **caps: float) -> Delay:
    """Rate limits back off and heed the answer's wish; other failures wait longer each time."""
    return lambda: r.retry_delay("status_code", "retry_after", "attempt", base, **caps)


def line_delay(pause: float = fv.LINE_RETRY_PAUSE_SECONDS) -> Delay:
    """A failed call waits; an answer with the wrong number of lines is asked again at once."""
    return lambda: F.when(F.col("failed_call"), F.lit(float(pause))).otherwise(0.0)


def score_delay(pause: float = fv.SCORE_RETRY_PAUSE_SECONDS) -> Delay:
    """The same pause after every rejected answer."""
    return lambda: F.lit(float(pause))


def _one_call(model: Model, request: dict) -> dict:
    started = time.monotonic()
    out = {"status_code": None, "retry_after": None, "body": None, "error_message": None}
    try:
        out.update(model(request))
        code = out["status_code"]
        if code is not None and code >= 400:
            out["error_message"] = out["error_message"] or f"HTTPError: {code}"
    except Exception as error:  # a failed call is a row, not a failed job
        out["error_message"] = f"{type(error).__name__}: {error}"
    out["elapsed_seconds"] = time.monotonic() - started
    return out


class _Slots:
    """The shared rate budget of a task's calls: each takes the next slot."""

    def __init__(self, interval: float):
        self._interval, self._lock, self._next = interval, threading.Lock(), 0.0
        self._started = time.monotonic()

    def wait(self, seconds: float) -> None:
        """Until ``seconds`` after the start, and until a slot is free."""
        held = self._started + seconds - time.monotonic()
        if held > 0:
            time.sleep(held)
        with self._lock:
            due = max(self._next, time.monotonic())
            self._next = due + self._interval
        time.sleep(max(0.0, due - time.monotonic()))


def call_model(
    requests: DataFrame,
    model_factory: Callable[[], Model],
    attempt: int = 1,
    partitions: int = 8,
    rpm: int = 0,
    payload: Sequence[str] = ("payload",),
    id_col: str = "request_id",
    in_flight: int = 1,
    journal: str | None = None,
) -> DataFrame:
    """One attempt per request.

    There are ``partitions`` times ``in_flight`` calls in flight; each thread of
    a task builds its own client by ``model_factory``.  The calls of a task
    share its part of the requests-per-minute limit.  A ``wait_seconds`` column
    holds a request back that long from the start of its task; those without a
    wait go first.

    With ``journal``, a folder that all executors reach, every answer is written
    there as it comes.  A task or job that runs again takes the answers from
    there and sends the rest.
    """
    interval = 60.0 * partitions / rpm if rpm > 0 else 0.0
    fields = list(payload)
    id_type = requests.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in ATTEMPT_FIELDS.split(", ")]
    if "wait_seconds" not in requests.columns:
        requests = requests.withColumn("wait_seconds", F.lit(0.0))
    asked = requests.select(id_col, *fields, "wait_seconds", request_key(id_col, fields).alias("_key"))
    known = answered(requests.sparkSession, journal, attempt) if journal else None
    if known is not None:
        # read once: the journal grows while the others are sent
        known = materialize(asked.select(id_col, "_key").join(known, "_key"), "answered")
        asked = asked.join(known.select("_key"), "_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Journal(journal, attempt, TaskContext.get().partitionId()) if journal else None
        slots, own = _Slots(interval), threading.local()

        def call(row: dict) -> dict:
            if book is not None and row["_key"] in book.known:
                return book.known[row["_key"]]
            if not hasattr(own, "model"):
                own.model = model_factory()
            slots.wait(row["wait_seconds"])
            answer = _one_call(own.model, {name: row[name] for name in fields})
            if book is not None:
                book.record(row["_key"], answer)
            return answer

        def frame(rows: list[tuple[dict, Future]]) -> pd.DataFrame:
            made = [{id_col: row[id_col], "attempt": attempt, **sent.result()} for row, sent in rows]
            return pd.DataFrame(made, columns=[id_col, *names]).astype(
                {"status_code": "Int32", "attempt": "int32"}
            )

        try:
            with ThreadPoolExecutor(in_flight) as pool:
                sent: deque[tuple[dict, Future]] = deque()
                for pdf in batches:
                    for row in sorted(pdf.to_dict("records"), key=lambda r: r["wait_seconds"]):
                        sent.append((row, pool.submit(call, row)))
                        if len(sent) >= 2 * in_flight:  # answers leave in small frames, as they come
                            yield frame([sent.popleft() for _ in range(in_flight)])
                while sent:
                    yield frame([sent.popleft() for _ in range(min(in_flight, len(sent)))])
        finally:
            if book is not None:
                book.close()

    called = asked.repartition(partitions, id_col).mapInPandas(run, f"{id_col} {id_type}, {ATTEMPT_FIELDS}")
    if known is None:
        return called
    return called.unionByName(known.withColumn("attempt", F.lit(attempt)).select(*called.columns))


def live_caller(model_factory: Callable[[], Model], **options) -> Caller:
    return lambda requests, attempt: call_model(requests, model_factory, attempt, **options)


def replay_caller(recorded: DataFrame, id_col: str = "request_id") -> Caller:
    """Answers taken from a recorded attempts table: an equi-join, no model."""
    names = [f.split()[0] for f in ATTEMPT_FIELDS.split(", ")]

    def call(requests: DataFrame, attempt: int) -> DataFrame:
        wanted = recorded.where(F.col("attempt") == attempt).select(id_col, *names)
        return requests.select(id_col).join(wanted, id_col)

    return call


def run_waves(
    requests: DataFrame,
    caller: Caller,
    judge: Judge,
    max_attempts: int,
    id_col: str = "request_id",
    delay: Delay = document_delay(),
    judge_by: Sequence[str] = ("expected_lines",),
) -> tuple[DataFrame, DataFrame]:
    """(requests, judged attempts): every request is tried until it is accepted
    or ``max_attempts`` is reached.

    One wave is one attempt for all open requests; the rejected ones, held back
    by their retry delay, form the next wave.  ``judge`` adds ``accepted``; it
    sees the answers and the request columns ``judge_by``, so a wave's table
    holds answers and no prompts.

    The tables of a wave are rows for each request.  Their files are packed many
    times over, so that Spark would take them for small and broadcast them
    through the driver; the joins are merged instead.
    """
    requests = materialize(requests, "requests")
    still, waves = requests, []
    for attempt in range(1, max_attempts + 1):
        raw = materialize(caller(still, attempt), f"attempts{attempt}")
        answered = requests.select(id_col, *judge_by).hint("merge").join(raw, id_col)
        judged = materialize(judge(answered), f"judged{attempt}")
        waves.append(judged)
        if attempt == max_attempts:
            break
        accepted = judged.where("accepted").select(id_col).hint("merge")
        delays = judged.select(id_col, delay().alias("wait_seconds")).hint("merge")
        still = (
            still.drop("wait_seconds")
            .join(accepted, id_col, "left_anti")
            .join(delays, id_col, "left")
            .withColumn("wait_seconds", F.coalesce("wait_seconds", F.lit(0.0)))
        )
        if still.isEmpty():
            break
    return requests, reduce(DataFrame.unionByName, waves)


def line_judge(verifier: Caller | None = None) -> Judge:
    """Accept equal line counts; ask the verifier about longer outputs.

    A failed call is never accepted, whatever its body holds, and a failed
    verification counts as a no.  The verifier needs the request's ``sources``.
    """

    def judge(answered: DataFrame) -> DataFrame:
        n = F.col("expected_lines")
        answered = answered.withColumns(
            {
                "verdict": F.lit(None).cast("string"),
                "failed_call": F.col("error_message").isNotNull(),
            }
        )
        if verifier is not None:
            asks = ~F.col("failed_call") & r.needs_verification("body", n)
            tails = answered.where(asks).withColumn(
                "candidates", r.tail_lines(r.output_lines("body"), n)
            )
            asked = verify_prompts(tails).select("request_id", F.col("user_text").alias("payload"))
            if not asked.isEmpty():
                verdicts = materialize(verifier(asked, 1), "verdicts").select(
                    "request_id",
                    F.when(F.col("error_message").isNull(), F.col("body")).alias("verdict"),
                )
                answered = answered.drop("verdict").join(verdicts, "request_id", "left")
        lines = answered.withColumn(
            "lines", F.when(~F.col("failed_call"), r.align_or_repair("body", n, "verdict"))
        ).drop("sources")
        return lines.withColumns(
            {
                "accepted": F.col("lines").isNotNull(),
                "error_message": F.coalesce(
                    "error_message", F.when(F.col("lines").isNull(), "line count mismatch")
                ),
            }
        )

    return judge


def score_judge(answered: DataFrame) -> DataFrame:
    """Accept answers with one score per pair; a failed call never."""
    scores = answered.withColumn(
        "scores", F.when(F.col("error_message").isNull(), r.parse_scores("body", "expected_lines"))
    )
    return scores.withColumns(
        {
            "accepted": F.col("scores").isNotNull(),
            "error_message": F.coalesce(
                "error_message", F.when(F.col("scores").isNull(), "score count mismatch")
            ),
        }
    )


def block_judge(answered: DataFrame) -> DataFrame:
    """Accept answers that hold a JSON object with a translation."""
    ok_call = F.col("error_message").isNull()
    payload = F.col("_payload")  # parsed once, read twice
    parsed = answered.withColumn("_payload", r.parse_json_body("body")).withColumns(
        {
            "translation": F.when(ok_call, r.parse_translation(payload)),
            "term_pairs": F.when(ok_call, r.parse_terms(payload)),
        }
    ).drop("_payload")
    return parsed.withColumns(
        {
            "accepted": F.col("translation").isNotNull(),
            "error_message": F.coalesce(
                "error_message",
                F.when(F.col("translation").isNull(), "ValueError: no usable translation"),
            ),
        }
    )


def resolve_attempts(
    attempts: DataFrame,
    max_attempts: int,
    outcome: Sequence[str | Column],
    id_col: str = "request_id",
) -> DataFrame:
    """(request, status, attempts, outcome, elapsed_seconds, error_message) per request.

    The first accepted attempt wins and its number is the attempt count;
    otherwise the request failed with the last error.  Attempts of a request
    are combined before the shuffle.
    """
    ok_at = F.when(F.col("accepted"), F.col("attempt"))
    return (
        attempts.groupBy(id_col)
        .agg(
            F.min(ok_at).alias("_at"),
            F.min_by(F.struct(*outcome), ok_at).alias("_won"),
            F.max_by("error_message", "attempt").alias("_error"),
            F.sum(F.col("elapsed_seconds").cast("decimal(38,18)")).cast("double").alias("_spent"),
        )
        .select(
            id_col,
            F.when(F.col("_at").isNotNull(), "ok").otherwise("failed").alias("status"),
            F.coalesce("_at", F.lit(max_attempts)).alias("attempts"),
            "_won.*",
            F.coalesce("_spent", F.lit(0.0)).alias("elapsed_seconds"),
            F.when(F.col("_at").isNotNull(), "").otherwise(F.coalesce("_error", F.lit(""))).alias(
                "error_message"
            ),
        )
    )


def fill_failed_lines(
    requests: DataFrame, resolved: DataFrame, mark: str = fv.FAILURE_MARK
) -> DataFrame:
    """Requests with ``lines``; a failed batch gets the mark on every row."""
    lines = F.coalesce("lines", F.array_repeat(F.lit(mark), F.col("expected_lines")))
    joined = requests.join(resolved.hint("merge"), "request_id", "left")
    return joined.withColumns(
        {
            "lines": lines,
            "status": F.coalesce("status", F.lit("failed")),
        }
    )


def fill_failed_scores(
    requests: DataFrame, resolved: DataFrame, failed: str = fv.FAILED_SCORE
) -> DataFrame:
    """Requests with ``scores``; a failed batch scores -1 on every row."""
    scores = F.coalesce("scores", F.array_repeat(F.lit(failed), F.col("expected_lines")))
    return requests.join(resolved.hint("merge"), "request_id", "left").withColumn("scores", scores)


def fill_failed_blocks(
    requests: DataFrame, resolved: DataFrame, max_attempts: int = fv.BLOCK_MAX_ATTEMPTS
) -> DataFrame:
    """Block results; a failed block has an empty translation and no terms."""
    no_terms = F.array().cast("array<struct<source:string,target:string>>")
    joined = requests.select(
        "request_id", "doc_key", "page", "block_no", "block_id", "source_text"
    ).join(resolved.hint("merge"), "request_id", "left")
    return joined.select(
        "doc_key",
        "page",
        "block_no",
        "block_id",
        "source_text",
        F.coalesce("translation", F.lit("")).alias("translation"),
        F.coalesce("term_pairs", no_terms).alias("term_pairs"),
        F.coalesce("attempts", F.lit(max_attempts)).cast("int").alias("attempts"),
        F.coalesce("elapsed_seconds", F.lit(0.0)).alias("elapsed_seconds"),
        F.coalesce("status", F.lit("failed")).alias("status"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.lit(False).alias("cache_hit"),
    )
