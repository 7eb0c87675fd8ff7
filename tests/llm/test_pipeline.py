"""The pipeline on a small table, stage by stage, against plain Python."""

import random
from collections import defaultdict

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tmloom.llm import queries
from tmloom.llm.queries import tokenizer_path
from tmloom.llm.simhash import fingerprint

SYLLABLES = {"xx": ["ka", "lo", "mi", "fen"], "yy": ["ta", "ro", "shu", "gri"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def made(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for k in range(120):
        lang = rng.choice(["xx", "yy"])
        rows.append((k, text(rng, lang, rng.randint(20, 120)), lang, rng.choice(["a", "a", "b", None])))
    for k in range(120, 150):  # copies, near copies
        words = rows[k - 120][1].split()
        if k % 2:
            words[len(words) // 2] = "other"
        rows.append((k, " ".join(words), rows[k - 120][2], "c"))
    rows += [(150, None, None, "a"), (151, "", "xx", "a"), (152, "12 34", "xx", "b"), (153, "12 34", None, None)]
    rows += [rows[5], rows[6]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    frame = frame.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("clash"))
    frame.withColumn("kept", F.lit(1)).withColumn("_row", F.lit(2)).drop("_row").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages(spark, tmp_path):
    made(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name == "language":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id < 150)
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        if name == "exact_dedup":
            best = defaultdict(int)
            for r in before:
                best[r.text] = max(best[r.text], r.doc_id)
            assert sorted((r.text, r.doc_id) for r in after) == sorted(best.items())
        if name == "simhash_near_dedup":
            prints = {r.doc_id: fingerprint(r.text) for r in before}
            root = {k: k for k in prints}
            for _ in range(4):
                for a in prints:
                    for b in prints:
                        if (prints[a] ^ prints[b]).bit_count() <= 4:
                            root[a] = root[b] = min(root[a], root[b])
            assert sorted(r.doc_id for r in after) == sorted(set(root.values()))
        if name == "mixing":
            words = lambda rows: sum(len(r.text.split()) for r in rows)
            assert abs(words(after) - 1.5 * words(before)) < 200
            whole = {r.doc_id: r.text for r in before}
            assert all(f" {r.text} " in f" {whole[r.doc_id]} " for r in after)
        if name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
            want = sorted((r.doc_id, library.encode(r.text)) for r in before)
            assert sorted((r.doc_id, r.ids) for r in after) == want
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)
        before = after


def test_language_keeps_a_document_of_three_languages(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setitem(SYLLABLES, "zz", ["да", "но", "ли", "пу"])
    monkeypatch.setitem(SYLLABLES, "ww", ["θα", "λο", "μι", "ψε"])
    rows = [(k, text(rng, lang, 60), lang) for k, lang in enumerate(["xx", "zz", "ww"] * 30)]
    even = lambda lang: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(60))
    rows += [(1000, " ".join(map(even, ["ww", "zz", "xx"])).replace("fen", "fe"), None), (1001, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert 1000 in ids and 1001 not in ids


def test_run_and_empty_table(spark, tmp_path):
    made(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "ids" in out.columns
    none = tmp_path / "none"
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(none / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_every_operator_has_a_query():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    with_sql = {"op1_exact_dedup", "op4_url_filter", "op7_mix_sources", "op11_repair", "op12_near_vectors", "op13_periodic_runs"}
    assert with_sql == set(queries.ORACLES)
