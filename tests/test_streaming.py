from pyspark.sql import functions as F

from tmloom.operators.attempts import call_model
from tmloom.operators.progress import latest_progress
from tmloom.plans.parameters import DocumentParameters, LineParameters
from tmloom.plans.translate_documents import translate_documents
from tmloom.plans.translate_lines import translate_lines
from tmloom.sources.files import RESULT_SCHEMA
from tmloom.streaming.incremental import (
    memory_log,
    postings_table,
    progress_log,
    refresh_memory_per_batch,
    run_incremental,
)

MARK = "[[TRANSLATION_FAILED]]"


def test_incremental_runs_skip_finished_work(spark, tmp_path):
    arriving, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    sent = []

    def caller(requests, attempt):
        sent.extend(r.payload for r in requests.collect())
        healthy = len(sent) > 1

        def factory():
            return lambda q: {"body": q["payload"].upper() if healthy or "bad" not in q["payload"] else ""}

        return call_model(requests, factory, attempt, partitions=1)

    def add(rows):
        spark.createDataFrame(rows, "row_id long, src string").coalesce(1).write.mode("append").parquet(arriving)

    def run():
        stream = spark.readStream.schema("row_id long, src string").parquet(arriving)
        run_incremental(stream, log, state, caller, params=LineParameters(max_attempts=1)).awaitTermination()
        return {r.src: r.tgt for r in latest_progress(progress_log(spark, log)).collect()}

    add([(1, "bad"), (2, "b")])
    assert run() == {"bad": MARK, "b": MARK}
    assert run() == {"bad": MARK, "b": MARK} and sent == ["bad\nb"]
    add([(3, "bad"), (4, "b"), (5, "new")])
    assert run() == {"bad": "BAD", "b": "B", "new": "NEW"} and sent[1:] == ["bad\nb\nnew"]
    add([(6, "new"), (7, "b")])
    assert run() == {"bad": "BAD", "b": "B", "new": "NEW"} and len(sent) == 2


def test_failures_are_sent_again_without_arriving_again(spark, tmp_path):
    arriving, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    sent = []

    def caller(requests, attempt):
        sent.append(sorted(x for r in requests.collect() for x in r.payload.split("\n")))
        down = len(sent) == 1
        return call_model(
            requests, lambda: lambda q: {"body": q["payload"].upper(), "status_code": 500 if down else 200},
            attempt, partitions=1,
        )

    for rows in ([(1, "a"), (2, "b")], [(3, "c")]):
        spark.createDataFrame(rows, "row_id long, src string").coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema("row_id long, src string").parquet(arriving)
        run_incremental(stream, log, state, caller, params=LineParameters(max_attempts=1)).awaitTermination()
    assert sent == [["a", "b"], ["a", "b", "c"]]
    done = {r.src: r.tgt for r in latest_progress(progress_log(spark, log)).collect()}
    assert done == {"a": "A", "b": "B", "c": "C"}


def test_hints_grow_from_wave_to_wave(spark):
    lines = spark.createDataFrame([(n, f"pump M{n // 25} valve {n}") for n in range(100)], "row_id long, src string")
    none = spark.createDataFrame([], "seq long, src string, tgt string")

    def caller(requests, attempt):
        return call_model(requests, lambda: lambda q: {"body": q["payload"].upper()}, attempt, partitions=1)

    one = translate_lines(lines, none, caller)
    assert {x.n for x in one.requests.select(F.size("tm_list").alias("n")).collect()} == {0}
    four = translate_lines(lines, none, caller, waves=4)
    hints = {x.batch: x.n for x in four.requests.select("batch", F.size("tm_list").alias("n")).collect()}
    assert hints[0] == 0 and all(hints[k] > 0 for k in (1, 2, 3))
    assert four.restored.where("tgt = upper(src)").count() == 100


def test_memory_of_a_batch_serves_the_next(spark, tmp_path):
    arriving, memory, results, state = (str(tmp_path / n) for n in ("in", "memory", "results", "state"))
    schema = "doc_key string, page int, primary_text string, fallback_text string"

    def caller(requests, attempt):
        def factory():
            return lambda q: {"body": '{"translation":"t","terms":[{"source":"Pump","target":"泵"}]}'}

        return call_model(requests, factory, attempt, partitions=1)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(schema).parquet(arriving)
        params = DocumentParameters(retry_base_delay=0.0)
        refresh_memory_per_batch(stream, memory, results, state, caller, params).awaitTermination()
        return {(r.page, r.cache_hit) for r in spark.read.parquet(results).collect()}

    assert run([("d", 1, "Big pump text", "")]) == {(1, False)}
    assert run([("d", 2, "Big pump text", ""), ("d", 3, "Other", "")]) == {(1, False), (2, True), (3, False)}
    log = memory_log(spark, memory)
    assert sorted(r.result.page for r in log.collect()) == [1, 3]
    assert log.select(F.countDistinct("seq")).first()[0] == 2


def test_lines_that_keep_failing_are_given_up(spark, tmp_path):
    arriving, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    sent = []

    def caller(requests, attempt):
        sent.append([x for r in requests.collect() for x in r.payload.split("\n")])
        answer = lambda q: {"body": q["payload"].upper(), "status_code": 500 if "bad" in q["payload"] else 200}
        return call_model(requests, lambda: answer, attempt, partitions=1)

    append = spark.createDataFrame([(1, "bad log", MARK), (2, "done", "DONE"), (3, "bad log", MARK)], "seq long, src string, tgt string")
    append.write.parquet(f"{log}/run_id=before")
    for n, rows in enumerate([["bad new", "a"], ["b", "done"], ["bad new", "c"], ["d"]]):
        df = spark.createDataFrame([(10 * n + k, x) for k, x in enumerate(rows)], "row_id long, src string")
        df.coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema("row_id long, src string").parquet(arriving)
        params = LineParameters(max_attempts=1, batch_size=1)
        run_incremental(stream, log, state, caller, params=params, max_batches=3).awaitTermination()
    assert [sorted(x) for x in sent] == [
        ["a", "bad log", "bad new"], ["b", "bad new"], ["bad new", "c"], ["d"],
    ]
    done = {r.src: r.tgt for r in latest_progress(progress_log(spark, log)).collect()}
    assert done == {"bad log": MARK, "bad new": MARK, "done": "DONE", "a": "A", "b": "B", "c": "C", "d": "D"}


def test_each_batch_gets_hints_of_those_before_it(spark, tmp_path):
    arriving, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    hints = []

    def caller(requests, attempt):
        hints.append({h.source for r in requests.collect() for h in r.tm_list})
        return call_model(requests, lambda: lambda q: {"body": q["payload"].upper()}, attempt, partitions=1)

    spark.createDataFrame([(1, "pump old", "PUMP OLD")], "seq long, src string, tgt string").write.parquet(f"{log}/run_id=before")
    for n in range(7):  # enough for the postings to be merged
        df = spark.createDataFrame([(n, f"pump {n:02d}")], "row_id long, src string")
        df.coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema("row_id long, src string").parquet(arriving)
        run_incremental(stream, log, state, caller).awaitTermination()
    all_sources = ["pump old", *[f"pump {n:02d}" for n in range(7)]]
    for n, found in enumerate(hints):  # near duplicates of better hints are suppressed, so not all need be there
        assert found and found <= set(all_sources[: n + 1])
    runs = [r.name for r in postings_table(spark, f"{log}/_postings", 20).live()]
    assert any(r.startswith("L1-") for r in runs) and len(runs) <= 5


def test_terms_of_a_wave_are_hints_of_the_next(spark):
    pages = spark.createDataFrame(
        [("d", p, f"The pump number {p} runs. Valve {p}.", "") for p in range(1, 9)] + [("e", 1, "A pump elsewhere.", "")],
        "doc_key string, page int, primary_text string, fallback_text string",
    )
    memory = spark.createDataFrame([], f"seq long, doc_key string, source_hash string, result {RESULT_SCHEMA}")

    def caller(requests, attempt):
        def factory():
            def model(q):
                terms = '[{"source":"pump","target":"泵"}]' if "number 1" in q["payload"] else "[]"
                return {"body": f'{{"translation":"t","terms":{terms}}}'}

            return model

        return call_model(requests, factory, attempt, partitions=1)

    params = DocumentParameters(retry_base_delay=0.0)
    told = {}
    for waves in (1, 4):
        run = translate_documents(pages, memory, caller, params, waves=waves)
        told[waves] = {(r.doc_key, r.page) for r in run.requests.collect() if "pump => 泵" in r.user_text}
        assert run.results.count() == 9 and run.results.where("status = 'ok'").count() == 9
    assert told == {1: set(), 4: {("d", p) for p in range(3, 9)}}
