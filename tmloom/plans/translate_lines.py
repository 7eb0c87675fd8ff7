"""Line chain: pending lines, hints, batched requests, aligned results, order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.functions.text import tokens
from tmloom.operators import attempts as a
from tmloom.operators import batches as b
from tmloom.operators import fuzzy
from tmloom.operators import progress as p
from tmloom.operators.prompts import line_requests
from tmloom.operators.scale import materialize
from tmloom.plans.parameters import LineParameters


GROWTH = 8  # of one wave to the next, where their number is left open


@dataclass(frozen=True)
class LineRun:
    requests: DataFrame  # one row per batch, as sent
    attempts: DataFrame  # one row per try, judged
    new_rows: DataFrame  # (seq, src, tgt) to append to the progress log
    restored: DataFrame  # (row_id, src, tgt) in the order of the input


def plan_requests(
    batched: DataFrame,
    history: DataFrame | fuzzy.PostingsIndex,
    params: LineParameters = LineParameters(),
    segment: fuzzy.Segmenter = tokens,
) -> DataFrame:
    """Requests for batched lines (row_id, src, batch, pos), with hints from ``history``."""
    hints = fuzzy.retrieve_hints(
        batched,
        history,
        segment=segment,
        postings_per_token=params.postings_per_token,
        min_similarity=params.min_similarity,
        threshold=params.duplicate_similarity,
        cap=params.max_hints,
    )
    requests = line_requests(
        b.batch_requests(batched), hints, params.instruction, params.source_lang, params.target_lang
    )
    return requests.withColumns(
        {"request_id": F.col("batch"), "payload": F.col("input_text")}
    )


def wave_ends(total: int, waves: int) -> list[int]:
    """Ends of the waves of ``total`` batches: ``waves`` of one size, or growing ones for 0.

    Growing waves hold 1, GROWTH, GROWTH^2 ... batches: hints grow early on as
    in a sequential run, and their number grows with the logarithm of the run.
    """
    if waves > 0:
        waves = max(1, min(waves, total))
        return [total * (w + 1) // waves for w in range(waves)]
    ends, size = [], 1
    while not ends or ends[-1] < total:
        ends.append(min(total, (ends[-1] if ends else 0) + size))
        size *= GROWTH
    return ends


def send_lines(
    todo: DataFrame,
    index: fuzzy.PostingsIndex,
    first_seq: int,
    caller: a.Caller,
    verifier: a.Caller | None = None,
    params: LineParameters = LineParameters(),
    waves: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(requests, attempts, new rows, the next seq) of ``todo`` lines (row_id, src), sent in waves.

    Hints come from ``index`` and, wave by wave, from the successes before.
    """
    if params.dedupe:
        todo = todo.groupBy("src").agg(F.min("row_id").alias("row_id"))
    # ranked once: retrieval and packing read it several times
    batched = materialize(b.assign_batches(todo, params.batch_size), "batched")
    last = batched.agg(F.max("batch")).first()[0]
    ends = wave_ends(0 if last is None else last + 1, waves)
    done = []
    for low, high in zip([0, *ends], ends):
        part = batched.where((F.col("batch") >= low) & (F.col("batch") < high))
        requests, tried = a.run_waves(
            plan_requests(part, index, params, index.segment),
            caller,
            a.line_judge(verifier),
            params.max_attempts,
            delay=a.line_delay(params.retry_pause),
            judge_by=("expected_lines", "sources") if verifier is not None else ("expected_lines",),
        )
        resolved = a.resolve_attempts(tried, params.max_attempts, ["lines"])
        filled = a.fill_failed_lines(requests, resolved, params.failure_mark)
        new_rows = b.align_lines(filled).select(
            (F.col("batch") * params.batch_size + F.col("pos") + first_seq).alias("seq"), "src", "tgt"
        )
        if high < ends[-1]:
            new_rows = materialize(new_rows, "new_rows")
            index = index.extended(p.valid_history(new_rows, params.failure_mark))
        done.append((requests, tried, new_rows))
    requests, tried, new_rows = (reduce(DataFrame.unionByName, x) for x in zip(*done))
    return requests, tried, new_rows, first_seq + ends[-1] * params.batch_size


def translate_lines(
    lines: DataFrame,
    progress: DataFrame,
    caller: a.Caller,
    verifier: a.Caller | None = None,
    params: LineParameters = LineParameters(),
    segment: fuzzy.Segmenter = tokens,
    waves: int = 1,
) -> LineRun:
    """Translate what is pending and restore the input order.

    ``caller`` sees ``request_id``, ``payload`` (the lines) and ``options``.
    A second run over the returned rows sends only what failed.

    The batches are sent in ``waves`` of consecutive ones.  Each wave finds its
    hints in the log and in the successes of the waves before it, so hints grow
    inside a run as in a sequential one, in steps of a wave instead of a batch;
    ``waves=0`` takes growing waves, the choice for a first run.  The log is
    indexed once; a wave reads the index and adds its own rows to it.
    """
    todo = p.pending(lines, progress, params.failure_mark)
    log = progress.select("seq", "src", "tgt")
    last = log.agg(F.max("seq")).first()[0]
    index = fuzzy.PostingsIndex.of(p.valid_history(log, params.failure_mark), params.postings_per_token, segment)
    requests, tried, new_rows, _ = send_lines(
        todo, index, 0 if last is None else last + 1, caller, verifier, params, waves
    )
    restored = p.restore_order(
        lines, p.latest_progress(log.unionByName(new_rows)), params.failure_mark
    )
    return LineRun(requests, tried, new_rows, restored)
