"""Calls in flight, their shared rate, and answers that are never asked for twice."""

import os
import subprocess
import sys
import threading
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tmloom.operators.attempts import call_model

ROOT = str(Path(__file__).resolve().parent.parent)


def requests(spark, n):
    return spark.range(n).select(F.col("id").alias("request_id"), F.concat(F.lit("q"), "id").alias("payload"))


def counting(log, fail_at=None, once=None):
    """A model that notes every call, and breaks the job at one request until ``once`` exists."""

    def factory():
        def model(request):
            if request["payload"] == fail_at and not os.path.exists(once):
                open(once, "w").close()
                time.sleep(0.3)  # the others in flight come back first
                os._exit(1)
            with open(log, "a") as f:
                f.write(request["payload"] + "\n")
            return {"body": request["payload"].upper(), "status_code": 200}

        return model

    return factory


def test_a_job_that_runs_again_sends_only_the_rest(spark, tmp_path):
    log, journal = str(tmp_path / "log"), str(tmp_path / "journal")
    first = call_model(requests(spark, 30), counting(log), partitions=2, journal=journal)
    assert first.count() == 30
    again = call_model(requests(spark, 50), counting(log), partitions=3, journal=journal)
    assert sorted(r.body for r in again.collect()) == sorted(f"Q{n}" for n in range(50))
    assert again.columns == first.columns
    changed = requests(spark, 1).withColumn("payload", F.lit("other"))
    assert [r.body for r in call_model(changed, counting(log), journal=journal).collect()] == ["OTHER"]
    second = call_model(requests(spark, 1), counting(log), attempt=2, journal=journal).collect()
    assert [(r.attempt, r.body) for r in second] == [(2, "Q0")]
    sent = Counter(Path(log).read_text().split())
    assert sent == Counter({f"q{n}": 1 for n in range(1, 50)} | {"q0": 2, "other": 1})


def test_a_cut_line_is_asked_again(spark, tmp_path):
    log, journal = str(tmp_path / "log"), tmp_path / "journal"
    call_model(requests(spark, 5), counting(log), partitions=1, journal=str(journal)).count()
    (file,) = journal.rglob("*.json")
    file.write_bytes(file.read_bytes()[:-20])
    got = call_model(requests(spark, 5), counting(log), partitions=1, journal=str(journal)).collect()
    assert sorted(r.body for r in got) == [f"Q{n}" for n in range(5)]
    assert len(Path(log).read_text().split()) == 6


@pytest.mark.parametrize("in_flight", [1, 4])
def test_a_killed_task_sends_nothing_again(tmp_path, in_flight):
    """The worker dies in the middle of its partition; Spark runs the task again."""
    script = f"""
import sys
sys.path[:0] = [{ROOT!r}, {ROOT + "/tests"!r}]
from pyspark.sql import SparkSession
from test_journal import counting, requests
from tmloom.operators.attempts import call_model
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
got = call_model(requests(spark, 40), counting({str(tmp_path / "log")!r}, "q33", {str(tmp_path / "once")!r}),
                 partitions=1, in_flight={in_flight}, journal={str(tmp_path / "journal")!r}).collect()
assert sorted(r.body for r in got) == sorted(f"Q{{n}}" for n in range(40))
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300, capture_output=True)
    assert (tmp_path / "once").exists()
    sent = Counter((tmp_path / "log").read_text().split())
    assert sent == Counter(f"q{n}" for n in range(40))


def test_calls_go_out_side_by_side_within_one_rate(spark, tmp_path):
    peak = str(tmp_path / "peak")

    def factory():
        def model(request):
            started = time.monotonic()
            time.sleep(0.2)
            with open(peak, "a") as f:
                f.write(f"{started} {time.monotonic()} {threading.get_ident()}\n")
            return {"body": "x"}

        return model

    call_model(requests(spark, 16), factory, partitions=1, in_flight=8).count()
    spans = [tuple(map(float, x.split()[:2])) for x in Path(peak).read_text().splitlines()]
    together = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert 4 <= together <= 8
    os.truncate(peak, 0)
    call_model(requests(spark, 12), factory, partitions=1, in_flight=8, rpm=600).count()
    starts = sorted(float(x.split()[0]) for x in Path(peak).read_text().splitlines())
    assert starts[-1] - starts[0] >= 11 * 0.1 - 0.05


def test_a_waiting_request_holds_no_other_back(spark):
    rows = requests(spark, 6).withColumn("wait_seconds", F.when(F.col("request_id") == 0, 1.5).otherwise(0.0))

    def factory():
        return lambda request: {"body": str(time.monotonic())}

    at = {r.request_id: float(r.body) for r in call_model(rows, factory, partitions=1).collect()}
    assert at[0] == max(at.values()) and at[0] - min(at.values()) >= 1.4
