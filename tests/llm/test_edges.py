"""Clashing column names, texts without letters, marks inside words."""

import pytest
from pyspark.sql import functions as F

from tmloom.llm.exact import drop_exact_copies, exact_groups
from tmloom.llm.language import identify
from tmloom.llm.pieces import encode
from tmloom.llm.quality import score_quality
from tmloom.llm.queries import tokenizer_path
from tmloom.llm.simhash import drop_near_copies, near_groups
from tmloom.llm.texts import words_of
from tmloom.llm.toxicity import score_toxicity

INNER = ["_keys", "_row", "_blocks", "_n", "_level", "_name", "_best", "_id", "_text", "_doc", "_sha", "_stay", "_key",
         "_half", "_label", "fp", "node", "root", "quality", "toxic", "score", "lang_pred", "ids", "kept"]


@pytest.fixture
def clashing(spark):
    rows = [(k, t) for k, t in enumerate(["a b c d e", "a b c d e", "f g h i j k", "", None, "l m n o p q r", "x y"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in INNER], (F.col("doc_id") % 2).alias("label"))


def test_copies_with_clashing_names(clashing):
    groups = exact_groups(clashing)
    assert len(groups.columns) == len(set(groups.columns))
    got = {r.doc_id: r for r in groups.collect()}
    assert got[0].keep_id == 1 and got[3].group_size == 2 and got[2].kept is True
    assert all(got[0][c] == f"own {c}" for c in INNER if c not in ("kept", "_text"))
    for kept in (drop_exact_copies(clashing), drop_near_copies(clashing)):
        assert kept.columns == clashing.columns
        rows = kept.collect()
        assert len(rows) == 5 and all(r[c] == f"own {c}" for r in rows for c in INNER)
    assert near_groups(clashing).count() == 7


def test_scores_with_clashing_names(clashing):
    for score, name in ((score_quality, "quality"), (score_toxicity, "toxic")):
        labels = clashing.select("doc_id", F.col("label").alias(name))
        assert score(clashing, labels).count() == 7
        assert score(clashing, labels.withColumn("text", F.lit("clash"))).count() == 7


def test_kept_columns_with_clashing_names(clashing):
    learn = clashing.select("doc_id", "text", F.lit("xx").alias("lang"))
    named = identify(clashing, learn, carry=INNER)
    assert sorted(named.columns) == sorted({"doc_id", "spans", *INNER})
    assert {r.lang_pred for r in named.where("doc_id = 0").collect()} == {"xx"}
    coded = encode(clashing, tokenizer_path(), carry=INNER)
    assert sorted(coded.columns) == sorted({"doc_id", "decoded", *INNER})
    assert [r._text for r in coded.where("doc_id = 0").collect()] == ["own _text"]


def test_words_are_letters_with_their_marks(spark):
    assert words_of("½ ² Ⅷ 12 __ ́") == []
    assert words_of("नमस्ते हिन्दी") == ["नमस्ते", "हिन्दी"]
    assert words_of("ที่นี่ Don't x²y É́a") == ["ที่นี่", "don", "t", "x", "y", "é́a"]
    learn = spark.createDataFrame([(1, "the of", "en"), (2, "नमस्ते हिन्दी", "hi")], "doc_id long, text string, lang string")
    texts = ["½ ²", "Ⅷ ①", "٣", "́", "नमस्ते", "the ½"]
    got = identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learn).collect()
    assert [r.lang_pred for r in sorted(got)] == ["und"] * 4 + ["hi", "en"]
    assert [r.score for r in sorted(got)][:4] == [0.0] * 4
