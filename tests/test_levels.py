"""Levelled logs: what is read, what is rewritten, and crashes in between."""

import random

import pytest
from pyspark.sql import functions as F

from tmloom.operators import fuzzy
from tmloom.operators.memory import latest_memory, merged_memory
from tmloom.sources.levels import LevelTable, Run

SCHEMA = "k string, seq long, v string"


def latest(rows):
    return rows.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))


def table(spark, path, **options):
    return LevelTable(spark, str(path), SCHEMA, ["k"], latest, **{"buckets": 4, "fan": 3, **options})


def rows_of(df):
    return {r.k: r.v for r in latest(df).collect()}


def test_fifty_batches_cost_the_same_each(spark, tmp_path):
    log, rng = table(spark, tmp_path / "t"), random.Random(1)
    want, written, read, merges = {}, [], [], 0
    for batch in range(50):
        merges += log.compact(before=batch)
        new = {f"k{rng.randrange(40)}": f"{batch}" for _ in range(6)}
        if batch % 10 == 9:
            asked = spark.createDataFrame([(k,) for k in new], "k string")
            found = log.read(asked, batch)
            assert rows_of(found) == {k: want[k] for k in new if k in want}
            read.append(found.count())
        log.append(spark.createDataFrame([(k, batch, v) for k, v in new.items()], SCHEMA).coalesce(1), batch)
        want |= new
        written.append(len(log.live()))
    assert rows_of(log.read()) == want
    # levels of at most ``fan`` runs (one more before the next merge), so their number follows the logarithm
    assert max(written) <= 3 * 4 + 1 and merges <= 50 / 2
    # of six wanted keys, each run holds one row at most, however many batches there were
    assert max(read) <= 6 * max(written)
    levels = {r.level for r in log.live()}
    assert max(levels) >= 3


def test_covered_and_unfinished_runs_are_not_read(spark, tmp_path):
    log = table(spark, tmp_path / "t")
    for batch in range(3):
        log.append(spark.createDataFrame([("a", batch, str(batch))], SCHEMA), batch)
    assert log.compact(before=2) == 0 and log.compact(before=3) == 1
    assert [r.name for r in log.live()] == [Run(1, 0, 2).name] and len(log.runs()) == 4
    assert log.compact(before=4) == 0 and log.runs() == [Run(1, 0, 2)]
    (tmp_path / "t" / Run(0, 3, 3).name).mkdir()  # a write that was broken off
    assert log.live() == [Run(1, 0, 2)]
    log.append(spark.createDataFrame([("a", 3, "x")], SCHEMA), 3)
    log.append(spark.createDataFrame([("a", 3, "y")], SCHEMA), 3)  # the batch again
    assert rows_of(log.read()) == {"a": "y"} and rows_of(log.read(before=3)) == {"a": "2"}


def test_reading_keys_prunes_buckets(spark, tmp_path):
    log = table(spark, tmp_path / "t", buckets=8)
    log.append(spark.createDataFrame([(f"k{n}", n, "v") for n in range(200)], SCHEMA), 0)
    found = log.read(spark.createDataFrame([("k7",)], "k string"))
    assert [r.seq for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket#", "").replace("[(", "[") or "_bucket" in plan.split("PartitionFilters")[1]
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 8


def test_missing_tables_are_empty(spark, tmp_path):
    log = table(spark, tmp_path / "none")
    assert log.read().count() == 0 and log.live() == [] and log.compact(before=9) == 0
    assert log.read(spark.createDataFrame([("a",)], "k string")).count() == 0


def test_merged_memory_reads_like_the_whole_log(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice("de"), f"h{rng.randrange(6)}", f"t{n}") for n in range(60)]
    log = spark.createDataFrame(rows, "seq long, doc_key string, source_hash string, t string").select(
        "seq", "doc_key", "source_hash", F.struct(F.col("t").alias("translation")).alias("result")
    )
    parts = [log.where((F.col("seq") >= a) & (F.col("seq") < a + 20)) for a in (0, 20, 40)]
    merged = merged_memory(merged_memory(parts[0]).unionByName(merged_memory(parts[1]))).unionByName(merged_memory(parts[2]))
    plain = lambda df: sorted(map(repr, latest_memory(df).collect()))
    assert plain(merged) == plain(log)


@pytest.mark.parametrize("fan", [2, 8])
def test_an_index_in_parts_is_the_index_of_the_whole_log(spark, fan):
    rng = random.Random(fan)
    word = lambda: rng.choice(["pump", "valve", "seal", "ring"])
    rows = [(n, f"{word()} {word()} {n:03d}", f"T{n}") for n in range(90)]
    log = spark.createDataFrame(rows, "seq long, src string, tgt string")
    index = fuzzy.PostingsIndex.of(log.where("seq < 30"), 5)
    index = fuzzy.PostingsIndex(index.parts, 5, fan=fan)
    for low in range(30, 90, 10):
        index = index.extended(log.where((F.col("seq") >= low) & (F.col("seq") < low + 10)))
    assert len(index.parts) <= 1 + fan
    wanted = spark.createDataFrame([(1, "pump"), (1, "045"), (2, "pump"), (2, "none")], "batch long, token string")
    plain = lambda df: sorted(map(repr, df.collect()))
    want = fuzzy.snapshot_postings(wanted, fuzzy.postings(log), 5)
    assert plain(fuzzy.snapshot_postings(wanted, index.of_tokens(wanted), 5)) == plain(want)
    text = index.of_tokens(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text  # the tokens go to the history
