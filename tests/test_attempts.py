import pytest
from pyspark.sql import functions as F

import catalog
from tmloom.functions import responses as r
from tmloom.operators import attempts as a
from tmloom.operators import prompts
from tmloom.operators.progress import latest_progress, pending, restore_order, valid_history
from tmloom.plans.parameters import LineParameters
from tmloom.plans.score_pairs import score_pairs
from tmloom.plans.translate_lines import translate_lines

MARK = "[[TRANSLATION_FAILED]]"
catalog.load_all()


@pytest.fixture
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()[0]

    return value


@pytest.mark.parametrize(
    "body, n, verdict, lines",
    [
        ("a\nb", 2, None, ["a", "b"]),
        (" a \n\n b\n", 3, None, ["a ", "", " b"]),
        ("head\nx\na\nb", 2, "well, yes", ["a", "b"]),
        ("head\nx\na\nb", 2, "NO", None),
        ("head\nx\na\nb", 2, None, None),
        ("a", 2, "YES", None),
        ("", 1, None, [""]),
        (None, 1, "YES", None),
    ],
)
def test_align_or_repair(one, body, n, verdict, lines):
    text = F.lit(body).cast("string")
    assert one(r.align_or_repair(text, F.lit(n), F.lit(verdict).cast("string"))) == lines


@pytest.mark.parametrize(
    "body, translation, terms",
    [
        ('{"translation":" x ","terms":[]}', "x", []),
        ('```json\n{"translation":"x"}\n```', "x", []),
        ('```\n{"translation":"x"}```', "x", []),
        ('So: {"translation":"x{}"} done', "x{}", []),
        ('{"translation":"x","terms":"none"}', "x", []),
        ('{"translation":"x","terms":[3,{"source":" a","target":"b "},{"source":"","target":"c"},{"source":"d"}]}',
         "x", [("a", "b")]),
        ('{"translation":null}', None, []),
        ('{"translation":"  "}', None, []),
        ('{"translation":"x"', None, []),
        ("no json", None, []),
        ('["x"]', None, []),
    ],
)
def test_json_bodies(one, body, translation, terms):
    payload = r.parse_json_body(F.lit(body))
    assert one(r.parse_translation(payload)) == translation
    assert [(p.source, p.target) for p in one(r.parse_terms(payload))] == terms


@pytest.mark.parametrize(
    "body, n, scores",
    [("10\n9", 2, ["10", "9"]), ("10\n\n 9 \n", 2, ["10", "9"]), ("10\n9\n8", 2, None), ("10.", 1, ["10."])],
)
def test_parse_scores(one, body, n, scores):
    assert one(r.parse_scores(F.lit(body), F.lit(n))) == scores


@pytest.mark.parametrize(
    "status, header, attempt, delay",
    [
        (429, "7", 1, 7.0), (429, "0.5", 1, 2.0), (429, "soon", 3, 8.0), (429, None, 9, 15.0),
        (429, "", 1, 2.0), (500, "7", 2, 4.0), (None, None, 7, 8.0),
    ],
)
def test_retry_delay(one, status, header, attempt, delay):
    column = r.retry_delay(F.lit(status).cast("int"), F.lit(header).cast("string"), F.lit(attempt))
    assert one(column) == delay


def test_parameter_score(one):
    assert one(r.parameter_score(F.lit("门阻 E160233-118-0"), F.lit("Door stop E160233-118-0"))) is None
    assert one(r.parameter_score(F.lit("管 Φ40"), F.lit("Pipe 41"))) == 0


def test_resolve_attempts(spark):
    rows = [
        (1, 1, True, "a", None), (1, 2, True, "late", None),
        (2, 1, False, "x", "e1"), (2, 2, False, "x", "e2"), (2, 3, True, "b", None),
        (3, 1, False, None, "e1"), (3, 2, False, None, "last"),
    ]
    df = spark.createDataFrame(
        [(*x, 0.5) for x in rows],
        "request_id long, attempt int, accepted boolean, body string, error_message string, elapsed_seconds double",
    )
    got = {x.request_id: x for x in a.resolve_attempts(df, 4, ["body"]).collect()}
    assert (got[1].status, got[1].attempts, got[1].body) == ("ok", 1, "a")
    assert (got[2].status, got[2].attempts, got[2].body, got[2].error_message) == ("ok", 3, "b", "")
    assert (got[3].status, got[3].attempts, got[3].body, got[3].error_message) == ("failed", 4, None, "last")


def test_call_model_keeps_failures_as_rows(spark):
    def factory():
        def model(request):
            if request["payload"] == "boom":
                raise RuntimeError("down")
            if request["payload"] == "slow":
                return {"status_code": 429, "retry_after": "3"}
            return {"status_code": 200, "body": request["payload"] * 2}

        return model

    requests = spark.createDataFrame([(1, "x"), (2, "boom"), (3, "slow")], "request_id long, payload string")
    got = {x.request_id: x for x in a.call_model(requests, factory, attempt=2, partitions=2, rpm=6000).collect()}
    assert (got[1].body, got[1].status_code, got[1].error_message, got[1].attempt) == ("xx", 200, None, 2)
    assert got[2].error_message == "RuntimeError: down" and got[2].status_code is None
    assert (got[3].status_code, got[3].retry_after, got[3].error_message) == (429, "3", "HTTPError: 429")


def test_waves_send_only_what_is_open(spark):
    sent = []

    def caller(requests, attempt):
        sent.append(sorted(x.request_id for x in requests.collect()))
        body = F.when(F.col("request_id") < attempt, "5").otherwise("no\nmatch")
        return requests.select(
            "request_id", F.lit(attempt).alias("attempt"), F.lit(200).alias("status_code"),
            F.lit(None).cast("string").alias("retry_after"), body.alias("body"),
            F.lit(None).cast("string").alias("error_message"), F.lit(0.1).alias("elapsed_seconds"),
        )

    requests = spark.createDataFrame([(0, 1), (1, 1), (7, 1)], "request_id long, expected_lines int")
    _, tried = a.run_waves(requests, caller, a.score_judge, 3)
    assert sent == [[0, 1, 7], [1, 7], [7]]
    resolved = {x.request_id: (x.status, x.attempts) for x in a.resolve_attempts(tried, 3, ["scores"]).collect()}
    assert resolved == {0: ("ok", 1), 1: ("ok", 2), 7: ("failed", 3)}


def test_failed_scores_are_minus_one(spark):
    def caller(requests, attempt):
        return a.call_model(requests, lambda: lambda q: {"body": "1\n2\n3"}, attempt, partitions=1)

    pairs = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(13)], "row_id long, source string, target string")
    scored = score_pairs(pairs, caller, max_attempts=2).scored.orderBy("row_id").collect()
    assert [x.score_raw for x in scored] == ["-1"] * 10 + ["1", "2", "3"]
    assert [x.score for x in scored] == [-1] * 10 + [1, 2, 3]


def test_progress_rules(spark):
    log = spark.createDataFrame(
        [(1, "a", MARK), (2, "a", "A"), (3, "b", "B"), (4, "b", MARK), (5, "c", ""), (6, "d", None)],
        "seq long, src string, tgt string",
    )
    lines = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (6, "new")], "row_id long, src string"
    )
    assert sorted(x.row_id for x in pending(lines, log).collect()) == [2, 3, 6]
    assert sorted(x.seq for x in valid_history(log).collect()) == [2, 3]
    restored = restore_order(lines, latest_progress(log)).orderBy("row_id").collect()
    assert [x.tgt for x in restored] == ["A", MARK, MARK, "", MARK, MARK]


def test_a_second_run_sends_only_failures(spark):
    def flaky(requests, attempt):
        def factory():
            return lambda q: {"body": q["payload"].upper() if "bad" not in q["payload"] else ""}

        return a.call_model(requests, factory, attempt, partitions=2)

    lines = spark.createDataFrame(
        [(i, f"line {i}" if i < 50 else f"bad {i}") for i in range(60)], "row_id long, src string"
    )
    empty = spark.createDataFrame([], "seq long, src string, tgt string")
    params = LineParameters(max_attempts=1)
    first = translate_lines(lines, empty, flaky, params=params)
    assert first.requests.count() == 3
    targets = [x.tgt for x in first.restored.orderBy("row_id").collect()]
    assert targets == [f"LINE {i}" for i in range(50)] + [MARK] * 10
    second = translate_lines(lines, first.new_rows, flaky, params=params)
    assert second.requests.count() == 1
    assert second.new_rows.agg(F.min("seq")).first()[0] > first.new_rows.agg(F.max("seq")).first()[0]


def test_line_request_options_and_prompts(spark):
    batches = spark.createDataFrame([(0, "a\nb"), (1, "c")], "batch long, input_text string")
    hints = spark.createDataFrame(
        [(1, [("x", 'y"')])], "batch long, tm_list array<struct<source:string,target:string>>"
    )
    got = {x.batch: x.options for x in prompts.line_requests(batches, hints, "rule").collect()}
    assert got[0] == '{"source_lang":"zh","target_lang":"en","tm_list":[],"domains":"rule"}'
    assert got[1] == '{"source_lang":"zh","target_lang":"en","tm_list":[{"source":"x","target":"y\\""}],"domains":"rule"}'


def answered(spark, rows):
    return spark.createDataFrame(
        rows,
        "request_id long, expected_lines int, sources array<string>, body string, status_code int, error_message string",
    )


def test_failed_calls_are_never_accepted(spark):
    """Error bodies whose line count fits, also in batches of one row."""
    rows = [
        (1, 1, ["a"], "Internal Server Error", 500, "HTTPError: 500"), (2, 1, ["a"], "busy", 503, "HTTPError: 503"),
        (3, 1, ["a"], "slow down", 429, "HTTPError: 429"), (4, 1, ["a"], "fine", 200, None),
        (5, 1, ["a"], "head\nfine", 200, None), (6, 1, ["a"], "error\npage", 500, "HTTPError: 500"),
    ]
    def verifier(asked, attempt):
        failed = F.col("request_id") == 7
        return asked.select(
            "request_id", F.lit(1).alias("attempt"), F.lit("YES").alias("body"),
            F.when(failed, "HTTPError: 500").alias("error_message"),
        )
    rows.append((7, 1, ["a"], "head\nfine", 200, None))  # its verification fails
    judged = a.line_judge(verifier)(answered(spark, rows)).collect()
    assert {x.request_id for x in judged if x.accepted} == {4, 5}
    scored = a.score_judge(answered(spark, [(1, 1, [], "5", 503, "HTTPError: 503"), (2, 1, [], "5", 200, None)]))
    assert {x.request_id for x in scored.collect() if x.accepted} == {2}


def test_each_chain_waits_by_its_own_rule(spark):
    rows = [(1, 1, [], "x\ny", 200, None), (2, 1, [], None, 500, "HTTPError: 500")]
    judged = a.line_judge()(answered(spark, rows))
    waits = {x.request_id: x.w for x in judged.select("request_id", a.line_delay()().alias("w")).collect()}
    assert waits == {1: 0.0, 2: 1.0}
    scored = a.score_judge(answered(spark, rows))
    assert {x.w for x in scored.select(a.score_delay()().alias("w")).collect()} == {2.0}


def test_a_replayed_record_is_added_up_once(spark, tmp_path):
    rows = [(k, n, "R" if n < 3 else "N", (k or 0) + n, n, 1.0) for k in (1, 2, None) for n in (1, 2, 3)]
    rows.append((1, 1, "A", 9, 9, 2.0))
    spark.createDataFrame(
        rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_partkey long, l_suppkey long, l_quantity double"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog.QUERIES["replay_attempts"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == [(1, 1, "body 11"), (1, 2, "body 3"), (1, 3, "body 4"), (2, 1, "body 3"), (2, 2, "body 4"), (2, 3, "body 5")]
    assert "lineitem" not in df._jdf.queryExecution().toString()  # seven waves read the stored record


def test_waves_broadcast_no_table_of_requests(spark, monkeypatch):
    """Files of requests are packed: Spark would take them for small and send them through the driver."""
    plans = []
    write = a.materialize

    def seen(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(a, "materialize", seen)
    requests = spark.range(50).select(F.col("id").alias("request_id"), F.lit(1).alias("expected_lines"))

    def caller(open_, attempt):
        body = F.when((F.col("request_id") % 2 == 0) | F.lit(attempt == 2), F.lit("x"))
        return open_.select(
            "request_id", F.lit(attempt).alias("attempt"), F.lit(200).alias("status_code"),
            F.lit(None).cast("string").alias("retry_after"), body.alias("body"),
            F.when(body.isNull(), "down").alias("error_message"), F.lit(0.0).alias("elapsed_seconds"),
        )

    sent, tried = a.run_waves(requests, caller, a.line_judge(), 2, delay=a.line_delay(0.0))
    done = a.fill_failed_lines(sent, a.resolve_attempts(tried, 2, ["lines"]))
    plans.append(done._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert done.where(F.col("lines") == F.array(F.lit("x"))).count() == 50
