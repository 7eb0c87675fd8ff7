"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from catalog import standins as s
from tmloom.functions.text import block_id
from tmloom.operators import fuzzy, memory, progress
from tmloom.operators.batches import assign_batches, batch_requests
from tmloom.operators.scale import global_rank, numbered_in_place
from tmloom.operators.segment import to_blocks
from tmloom.plans.translate_documents import plan_requests

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text


def test_joins_stay_out_of_python(spark, plan):
    log = s.progress(spark, SF)
    hits, misses = memory.lookup_exact(s.whole_blocks(spark, SF), s.memory(spark, SF))
    prompts = plan_requests(s.whole_blocks(spark, SF), s.memory(spark, SF))
    for df in (
        progress.restore_order(s.lines(spark, SF), progress.latest_progress(log)),
        progress.pending(s.lines(spark, SF), log), hits, misses, prompts,
    ):
        assert "Python" not in plan(df)
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_segmentation_is_one_narrow_pass(spark, plan):
    # a plain scan: the catalog's text tables may be dealt to all cores beforehand
    pages = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("source").alias("doc_key"), F.col("doc_id").cast("int").alias("page"),
        F.col("text").alias("primary_text"), F.lit("").alias("fallback_text"),
    )
    text = plan(to_blocks(pages))
    assert "Exchange" not in text and "Python" not in text


def test_last_postings_limit_before_the_shuffle(spark, plan):
    text = plan(fuzzy.last_postings(fuzzy.postings(s.progress(spark, SF))))
    below = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_similarity_runs_once_after_grouping(spark, plan):
    lines = fuzzy.line_tokens(assign_batches(s.lines(spark, SF)))
    wanted = lines.select("batch", "token").distinct()
    recent = fuzzy.snapshot_postings(wanted, fuzzy.postings(s.progress(spark, SF)))
    text = plan(fuzzy.fuzzy_candidates(fuzzy.candidate_pairs(lines, recent)))
    assert text.count("ArrowEvalPython") == 1
    assert text.index("ArrowEvalPython") < text.index("REPARTITION_BY_NUM")


def test_rank_sends_only_chunk_totals_through_one_task(spark, plan):
    ranked = global_rank(s.table(spark, SF, "events"), "event_id")
    text = plan(ranked)
    assert text.count("SinglePartition") == 1
    single = text[text.index("SinglePartition"):]
    assert "HashAggregate" in single.split("\n")[1]


def test_scans_read_needed_columns(spark, plan):
    rows = s.table(spark, SF, "events").select(F.col("event_id").alias("row_id"), F.col("event_type").alias("src"))
    text = plan(batch_requests(assign_batches(rows)))
    assert "props" not in text and "value" not in text.replace("IsNotNull", "")


def test_memory_of_one_document_prunes_folders(spark, plan, tmp_path):
    from tmloom.sources.files import read_memory_log
    from tmloom.sources.sinks import append_memory

    append_memory(s.memory(spark, SF), str(tmp_path / "m"), "run-0", buckets=8, split=2)
    log = read_memory_log(spark, str(tmp_path / "m"), "en", buckets=8)
    assert "PartitionFilters: [isnotnull(bucket" in plan(log)
    assert log.count() == s.memory(spark, SF).where("doc_key = 'en'").count()
    files = list((tmp_path / "m").rglob("*.json"))
    assert len(files) <= 8 * 2


def test_lookup_joins_once_by_equality(spark, plan):
    blocks = s.whole_blocks(spark, SF).withColumn("block_id", block_id("page", "block_no"))
    hits, _ = memory.lookup_exact(blocks, s.memory(spark, SF))
    assert "Join" not in plan(hits) and "Cartesian" not in plan(hits)


def test_rows_in_order_are_numbered_where_they_are(spark, plan):
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v")).orderBy("v")
    numbered = numbered_in_place(rows, "n")
    assert numbered.where("n <> v").isEmpty() and numbered.count() == 5000
    assert "rangepartitioning" not in plan(numbered)


def test_text_tables_that_make_enough_splits_are_not_dealt_again(spark, plan, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    for n, dealt in ((1, True), (8, False)):  # the test session has four cores
        d = tmp_path / str(n)
        docs.repartition(n, "doc_id").write.option("maxRecordsPerFile", 40 // n).parquet(f"{d}/documents.parquet")
        rows = s.in_place(spark, str(d), "documents")
        assert ("Exchange" in plan(rows)) == dealt
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))


def test_places_of_partitions_are_broadcast_not_the_rows_shuffled(spark, plan):
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v")).orderBy("v")
    numbered = numbered_in_place(rows, "n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(numbered.select("*"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
