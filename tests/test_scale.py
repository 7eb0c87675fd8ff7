import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tmloom.operators.batches import align_lines, assign_batches, batch_requests
from tmloom.operators.scale import (
    durable_dir,
    global_rank,
    materialize,
    previous_value,
    release,
)


def test_released_tables_are_gone(spark):
    table = materialize(spark.range(5), "kept")
    folder = Path(table._written_at.removeprefix("file:"))
    assert table.count() == 5 and folder.exists()
    release(table, None, spark.range(3))
    assert not folder.exists()


@pytest.mark.parametrize("seed", [1, 3])
def test_global_rank_of_sparse_ids(spark, seed):
    rng = random.Random(seed)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(200)] + rng.sample(range(0, 5000), 300) + [1 << 40, (1 << 40) + 7, -5, 1 << 61]
    ranked = global_rank(spark.createDataFrame([(i,) for i in ids], "i long"), "i")
    assert [(r.i, r.rank) for r in ranked.orderBy("i").collect()] == [
        (i, n) for n, i in enumerate(sorted(ids))
    ]


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_previous_value_equals_a_plain_lag(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice("ab"), n, rng.choice([None, "x", "y"])) for n in rng.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    got = {(r.k, r.n): r.p for r in previous_value(df, ["k"], "n", F.col("v"), "p", bits).collect()}
    last, expected = {}, {}
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        expected[k, n] = last.get(k)
        last[k] = v
    assert got == expected


def test_materialize_writes_once_to_the_shared_folder(spark):
    made = materialize(spark.range(5).withColumn("r", F.rand()), "t")
    assert sorted(r.r for r in made.collect()) == sorted(r.r for r in made.collect())
    assert durable_dir(spark) in made.inputFiles()[0]


@pytest.mark.parametrize("n", [0, 1, 25, 26, 60])
def test_batches_and_alignment(spark, n):
    rows = [(i * 10, f"s{i}") for i in range(n)]
    batched = assign_batches(spark.createDataFrame(rows, "row_id long, src string"))
    requests = batch_requests(batched)
    sizes = [r.expected_lines for r in requests.orderBy("batch").collect()]
    assert sizes == [25] * (n // 25) + ([n % 25] if n % 25 else [])
    back = align_lines(requests.withColumn("lines", F.split(F.upper("input_text"), "\n")))
    got = [(r.row_id, r.src, r.tgt) for r in back.orderBy("row_id").collect()]
    assert got == [(i, x, x.upper()) for i, x in rows]
