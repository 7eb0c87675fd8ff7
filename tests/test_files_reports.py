import pytest
from pyspark.sql import functions as F

from tests.test_memory_hints import entry, results
from tmloom.operators import memory, progress
from tmloom.operators import reports as r
from tmloom.operators import segment as seg
from tmloom.operators.progress import exit_status
from tmloom.sources import files, sinks
from tmloom.sources.pages import pages_with_fallback


def test_lines_keep_order_commas_and_quotes(spark, tmp_path):
    big = tmp_path / "b.csv"
    big.write_text("\n".join(f"x,{i}" for i in range(5000)) + "\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text('plain\n"quoted, ""twice"""\n\n  kept \nNA\n007\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_lines(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({x.row_id for x in rows}) == len(rows)
    assert [x.src for x in rows] == ["plain", 'quoted, "twice"', "  kept ", "NA", "007"] + [
        f"x,{i}" for i in range(5000)
    ]


def test_line_feeds_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"one\ntwo"\nthree\n', encoding="utf-8")
    rows = files.read_lines(spark, str(tmp_path / "a.csv"), multi_line=True).orderBy("row_id").collect()
    assert [x.src for x in rows] == ["one\ntwo", "three"]


def test_missing_logs_are_empty(spark, tmp_path):
    assert files.read_progress(spark, str(tmp_path / "none")).columns == ["seq", "src", "tgt"]
    assert files.read_memory(spark, str(tmp_path / "none")).isEmpty()


def test_pairs_pad_and_cut_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b,c\nlonely\n"x, y",z\n', encoding="utf-8")
    rows = files.read_pairs(spark, str(tmp_path / "p.csv")).orderBy("row_id").collect()
    assert [(x.source, x.target) for x in rows] == [("a", "b"), ("lonely", ""), ("x, y", "z")]


def test_scored_file_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿Source,Target,Score\na,A,10\nb,B,10.\n", encoding="utf-8")
    rows = files.read_scored(spark, str(tmp_path / "s.csv")).orderBy("row_id").collect()
    assert [(x.source, x.score_raw, x.score) for x in rows] == [("a", "10", 10), ("b", "10.", None)]


def test_memory_defaults_and_bad_json(spark, tmp_path):
    good = tmp_path / "m.jsonl"
    good.write_text(
        '{"source_hash":"h","result":{"page":1,"block_id":"P001-B001","source_text":"s","translation":"t"}}\n\n',
        encoding="utf-8",
    )
    (row,) = files.read_memory(spark, str(good)).collect()
    x = row.result
    assert (x.term_pairs, x.attempts, x.elapsed_seconds, x.status, x.error_message, x.cache_hit) == (
        [], 0, 0.0, "ok", "", False,
    )
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"source_hash":\n', encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_memory(spark, str(bad)).collect()


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a", "A")], "seq long, src string, tgt string")
    for run in ("r1", "r1", "r2"):
        sinks.append_progress(rows, path, run)
    assert files.read_progress(spark, path).count() == 2


def test_appended_runs_resume(spark, tmp_path):
    """The sequence of the README: append, read back, send only what failed."""
    path = str(tmp_path / "log")
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id long, src string")
    mark = "[[TRANSLATION_FAILED]]"
    first = [(0, "a", "A"), (1, "b", mark)]
    sinks.append_progress(spark.createDataFrame(first, "seq long, src string, tgt string"), path, "run-0001")
    assert {x.src for x in progress.pending(lines, files.read_progress(spark, path)).collect()} == {"b", "c"}
    later = [(2, "b", "B"), (3, "c", "C")]
    sinks.append_progress(spark.createDataFrame(later, "seq long, src string, tgt string"), path, "run-0002")
    log = files.read_progress(spark, path)
    assert progress.pending(lines, log).isEmpty()
    assert {x.src: x.tgt for x in progress.latest_progress(log).collect()} == {"a": "A", "b": "B", "c": "C"}


def test_the_last_appended_memory_wins(spark, tmp_path):
    def entry(word):
        return spark.range(40).selectExpr(
            "'d' AS doc_key", "id AS seq", "cast(id AS string) AS source_hash",
            f"named_struct('page', 1, 'block_id', 'b', 'source_text', 's', 'translation', '{word}') AS result",
        )

    for n, word in enumerate(("old", "new", "newest")):
        sinks.append_memory(entry(word), str(tmp_path / "m"), f"run-{n}")
    latest = memory.latest_memory(files.read_memory_log(spark, str(tmp_path / "m")))
    assert {x.result.translation for x in latest.collect()} == {"newest"} and latest.count() == 40


def test_files_follow_each_other_by_number(spark, tmp_path):
    for n in (2, 10, 99999, 100000):
        (tmp_path / f"part-{n:05d}.csv").write_text(f"{n}\nx{n}\n", encoding="utf-8")
    rows = files.read_lines(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [x.src for x in rows] == [t for n in (2, 10, 99999, 100000) for t in (str(n), f"x{n}")]


def test_splits_of_a_file_keep_their_order(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("".join(f"{n}\n" for n in range(5000)), encoding="utf-8")
    (tmp_path / "b.csv").write_text("".join(f"{n}\n" for n in range(5000, 5050)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.read_lines(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x.src for x in rows] == [str(n) for n in range(5050)]


def test_pages_choose_and_skip(spark):
    pages = spark.createDataFrame(
        [("d", 1, "one\n7", "x"), ("d", 2, " 12 ", "two"), ("d", 3, None, "3"), ("d", 10, "", None), ("e", 1, "a", None)],
        "doc_key string, page int, primary_text string, fallback_text string",
    )
    chosen = pages_with_fallback(pages)
    got = {(x.doc_key, x.page): (x.text, x.backend) for x in chosen.collect()}
    assert got["d", 1] == ("one", "pdfplumber") and got["d", 2] == ("two", "PyPDF2")
    assert got["d", 3] == (None, None)
    (lists,) = seg.skipped_page_lists(chosen).collect()
    assert lists.skipped_pages == [3, 10]
    maps = {x.doc_key: x.page_backends for x in seg.page_backend_maps(chosen).collect()}
    assert maps == {"d": {1: "pdfplumber", 2: "PyPDF2"}, "e": {1: "pdfplumber"}}
    view = r.extraction_view(seg.blocks_of(chosen), seg.skipped_page_lists(chosen))
    assert {(x["doc_key"], x["Skipped Pages"]) for x in view.collect()} == {("d", "3, 10"), ("e", "")}


def test_block_numbers_are_contiguous(spark):
    text = "1.1 Head\nAlpha beta. Gamma delta. " + "x" * 50 + "\n\nTail"
    pages = spark.createDataFrame(
        [("d", 1, text, ""), ("d", 2, "Solo", "")], "doc_key string, page int, primary_text string, fallback_text string"
    )
    rows = seg.to_blocks(pages, 20).orderBy("page", "block_no").collect()
    assert [x.block_no for x in rows if x.page == 1] == list(range(1, len(rows)))
    assert rows[0].block_id == "P001-B001" and rows[-1].block_id == "P002-B001"
    assert all(x.source_char_count == len(x.source_text) <= 20 for x in rows)
    assert [x.block_id for x in seg.limit_blocks(seg.to_blocks(pages, 20), 2).collect()] == ["P001-B001", "P001-B002"]
    assert seg.limit_blocks(seg.to_blocks(pages, 20), 0).count() == len(rows)


@pytest.fixture(scope="module")
def translated(spark):
    return results(spark, [
        entry("one", "译文a", [("The  term", "术语"), ("x", "y"), ("Term", "术语")], page=2),
        entry("two", "english", [("The term", "术语"), ("Term", "其他")], page=10),
        entry("three", "", status="failed", page=10, block_no=2),
        entry("four", "ab译文", page=11),
    ])


def test_glossary_merges_and_orders(translated):
    rows = [x.asDict() for x in r.glossary_view(r.glossary(translated)).collect()]
    assert [(x["English Term"], x["Chinese Term"], x["Frequency"], x["Pages"], x["Example"]) for x in rows] == [
        ("The term", "术语", 2, "2, 10", "one"), ("Term", "术语", 1, "2", "one"), ("Term", "其他", 1, "10", "two"),
    ]


def review_text(spark, df, **options):
    rows = r.review_report(df, **options).orderBy("section", "page", "block_no").collect()
    return [x.line for x in rows]


def test_review_lines(spark, translated):
    assert review_text(spark, translated) == [
        "# 自检报告", "", "- 总块数：4", "- 成功块数：3", "- 失败块数：1", "- 中文占比可疑块数：1", "",
        "## 失败块", "- P010-B002 (page 10): unknown error", "", "## 中文占比可疑块", "- P010-B001 (page 10)",
    ]
    assert r.english_heavy(translated).count() == 1  # equal counts are not suspicious
    assert exit_status(translated) == 2
    assert exit_status(translated.where(F.col("page") != 10)) == 0


def test_review_lists_twenty_but_counts_all(spark):
    many = results(spark, [entry("s", "abc", page=p) for p in range(1, 26)])
    lines = review_text(spark, many)
    assert "- 中文占比可疑块数：25" in lines and "- 无" in lines
    assert sum(x.startswith("- P0") for x in lines) == 20


def test_document_parts(translated):
    rows = r.assemble_document(translated).orderBy("page", "part", "block_no").collect()
    assert [x.text for x in rows] == [
        "d 中文译文", "第 2 页", "译文a", "第 10 页", "english", "[翻译失败] P010-B002\nthree", "第 11 页", "ab译文",
    ]


def test_summary_and_manifest(spark, translated):
    row = r.run_summary(translated).first()
    assert (row.total, row.ok, row.failed, row.cache_hits, row.suspicious) == (4, 3, 1, 0, 1)
    assert (row.elapsed_seconds, row.blocks_per_second) == (2.0, 2.0)
    chosen = spark.createDataFrame([("d", 2, "t", "b"), ("d", 3, None, None)], "doc_key string, page int, text string, backend string")
    (line,) = r.run_manifest(translated, translated, chosen, '{"k":1}', {"results": "/x"}, "now").collect()
    assert (line.skipped_pages, line.blocks, line.failed, line.artifacts) == ([3], 4, 1, {"results": "/x"})


def test_empty_results_keep_their_schema(spark, translated):
    none = translated.where("page < 0")
    assert r.glossary_view(r.glossary(none)).columns[1] == "English Term"
    assert r.bilingual_view(none).isEmpty()
    assert r.run_summary(none).first().blocks_per_second == 0.0


def test_texts_lie_in_few_files_and_are_found_by_their_index(spark, tmp_path):
    parts = spark.range(3000).select(
        F.concat(F.lit("doc"), F.col("id") % 500).alias("doc_key"), (F.col("id") / 500).cast("int").alias("page"),
        F.lit(2).alias("part"), F.lit(1).alias("block_no"), F.concat(F.lit("line one\n"), "id").alias("text"),
    )
    parts = parts.unionByName(spark.range(4000).selectExpr(  # one text that fills several files
        "'huge' as doc_key", "cast(id as int) as page", "2 as part", "1 as block_no", "cast(id as string) as text"
    ))
    path = str(tmp_path / "d")
    sinks.write_document(parts, path, files=5)
    assert len(list((tmp_path / "d" / "rows").glob("*.parquet"))) <= 5
    back = files.read_texts(spark, path, ["doc7"])
    rows = back.orderBy("place").collect()
    assert [x.value for x in rows] == [f"line one\n{7 + 500 * k}" for k in range(6)]
    assert len(back.inputFiles()) <= 2
    huge = files.read_texts(spark, path, ["huge"]).orderBy("place").collect()
    assert [x.value for x in huge] == [str(k) for k in range(4000)]
    assert files.read_texts(spark, path).count() == 7000
    assert files.read_texts(spark, path, ["none"]).count() == 0
    index = spark.read.parquet(f"{path}/index")
    assert index.agg(F.sum("rows")).first()[0] == 7000 and index.select("doc_key").distinct().count() == 501


def test_ids_that_would_overflow_raise(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x\n" * 40, encoding="utf-8")
    (tmp_path / "b.csv").write_text("y\n", encoding="utf-8")
    monkeypatch.setattr(files, "_MOST_FILES", 1)
    with pytest.raises(ValueError, match="read them in parts"):
        files.read_lines(spark, str(tmp_path))
    monkeypatch.setattr(files, "_FILE_BITS", 4)
    with pytest.raises(Exception, match="too large a file"):
        files.read_lines(spark, str(tmp_path / "a.csv")).collect()


def test_repeating_sinks_are_compressed_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, "x\ny", [("a", "A")]), ("d", 2, None, [])], "doc_key string, page int, text string, term_pairs array<struct<source:string,target:string>>")
    sinks.write_results_json(rows, str(tmp_path / "json"))
    assert list((tmp_path / "json").glob("*.json.gz")) and not list((tmp_path / "json").glob("*.json"))
    assert sorted(spark.read.schema(rows.schema).json(str(tmp_path / "json")).collect(), key=lambda r: r.page) == rows.collect()
    flat = rows.drop("term_pairs")
    out = sinks.write_tables(flat, flat, flat, str(tmp_path / "csv"))
    back = spark.read.schema(flat.schema).options(header=True, escape='"', multiLine=True).csv(out["glossary"])
    assert list((tmp_path / "csv" / "glossary").glob("*.csv.gz"))
    assert sorted((r.page, r.text or "") for r in back.collect()) == [(1, "x\ny"), (2, "")]


def test_glossary_sends_an_example_once_for_a_list_of_terms(spark):
    """Terms travel as lists: far fewer rows than terms pass the shuffle, and no example stands beside each term."""
    rows = [
        entry(f"text {p} " + "x" * 300, "译", [(f"word {i}", f"词{i}") for i in range(p % 7, 400)] + [(f"word {p % 7}", f"词{p % 7}")], page=p)
        for p in range(1, 21)
    ]
    found = r.glossary(results(spark, rows))
    got = {(x.source, x.target): x for x in found.collect()}
    assert len(got) == 400
    one = got["word 3", "词3"]
    assert one.frequency == sum(p % 7 <= 3 for p in range(1, 21)) + sum(p % 7 == 3 for p in range(1, 21))
    assert one.pages == ", ".join(str(p) for p in range(1, 21) if p % 7 <= 3)
    assert one.example == ("text 1 " + "x" * 300)[:180] and tuple(one.first_seen) == (1, 1, 2)
    only = got["word 0", "词0"]
    assert (only.frequency, only.pages, only.example[:6], tuple(only.first_seen)) == (4, "7, 14", "text 7", (7, 1, 0))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (dealt,) = [i for i, x in enumerate(plan) if "RepartitionByExpression" in x]
    assert any("posexplode" in x for x in plan[:dealt]) and not any("posexplode" in x for x in plan[dealt:])
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1


def test_glossary_keeps_null_keys_and_repeated_blocks(spark):
    pairs = "array<struct<source:string,target:string>>"
    rows = [
        (None, None, 1, "a", [("one", "1"), (None, "x"), ("two", None)]), (None, None, 1, "a", [("one", "1")]),
        ("d", 1, 1, None, [("one", "1")]), ("d", 1, 1, "b", None), ("d", 2, 1, "c", []),
    ]
    df = spark.createDataFrame(rows, f"doc_key string, page int, block_no int, source_text string, term_pairs {pairs}")
    got = sorted((tuple(x[:-1]) + tuple(x.first_seen) for x in r.glossary(df).collect()), key=repr)
    assert got == [("d", "one", "1", 1, "1", None, 1, 1, 0), (None, "one", "1", 2, "", "a", None, 1, 0)]
