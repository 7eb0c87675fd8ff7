import itertools
import random
import time
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tmloom.functions import segmenter
from tmloom.functions import text as t
from tmloom.functions.similarity import similarity, similarity_bound
from tmloom.operators import fuzzy


@pytest.fixture
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()[0]

    return value


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("co­op", "coop"),
        ("über-\n ärzte", "überärzte"),
        ("a\r\nb", "a\n\nb"),
        ("a\t \tb", "a b"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("　a b ", "a b"),
        ("\x1ca\x1f", "a"),
        ("x -\ny", "x -\ny"),
    ],
)
def test_normalize_whitespace(one, raw, clean):
    assert one(t.normalize_whitespace(F.lit(raw))) == clean


@pytest.mark.parametrize(
    "line, heading",
    [
        ("Chapter One", True), ("Chapters", False), ("Appendix", True), ("1.1 Scope", True),
        ("3", True), ("12a", False), ("1.2a", True), ("1984 was", True), ("chapter 1", False),
        ("1 " + "x" * 118, True), ("1 " + "x" * 119, False), ("", False),
    ],
)
def test_is_heading(one, line, heading):
    assert one(t.is_heading(F.lit(line))) is heading


def test_noise_lines(one):
    lines = ["12", " 1 Introduction ", "1.1 Scope", "3 a b c d e f g h", "3 a b c d e f g", "3rd edition", "", "text"]
    kept = one(t.drop_noise_lines(F.array(*[F.lit(x) for x in lines])))
    assert kept == ["1.1 Scope", "3 a b c d e f g h", "3rd edition", "", "text"]


@pytest.mark.parametrize(
    "page, text",
    [
        ("a\nb\n\nc", "a b\n\nc"),
        ("a\n1.1 Head\nb\nc", "a\n\n1.1 Head\n\nb c"),
        ("1.1 A\n1.2 B", "1.1 A\n\n1.2 B"),
        ("a\n7\nb", "a b"),
        ("\n\n", ""),
        ("", ""),
        ("a\u0001b\nc", "a\u0001b c"),
    ],
)
def test_clean_page(one, page, text):
    assert one(t.clean_page(F.lit(page))) == text


@pytest.mark.parametrize(
    "text, parts",
    [
        ("A b. C", ["A b.", "C"]),
        ('e; "F"', ["e;", '"F"']),
        ("g: (H)", ["g:", "(H)"]),
        ("Nr. 9. 10", ["Nr.", "9.", "10"]),
        ("no. break", ["no. break"]),
        ("A.\nB", ["A.", "B"]),
        ("A. B. C", ["A.", "B.", "C"]),
        ("  ", []),
    ],
)
def test_split_sentences(one, text, parts):
    assert one(t.split_sentences(F.lit(text))) == parts


@pytest.mark.parametrize(
    "text, size, chunks",
    [
        ("exactly10!", 10, ["exactly10!"]),
        ("in\nner", 10, ["in\nner"]),
        ("Aa bb. Cc dd.", 13, ["Aa bb. Cc dd."]),
        ("Aa bb. Cc dd. E", 13, ["Aa bb. Cc dd.", "E"]),
        ("Aa. " + "X" * 25 + ". B. C", 10, ["Aa.", "X" * 10, "X" * 10, "XXXXX.", "B. C"]),
        ("", 5, [""]),
        ("      ", 5, []),
    ],
)
def test_chunk_text(one, text, size, chunks):
    assert one(t.chunk_text(F.lit(text), size)) == chunks


def test_chunks_keep_all_characters_within_the_limit(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta.", "gamma;", "Delta", "x" * 37, "(Eta)", "9.", "Äö!", "译文。"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(
        "x", t.chunk_text("x", 60).alias("c")
    )
    for row in rows.collect():
        assert all(len(c) <= 60 for c in row.c)
        assert "".join("".join(row.c).split()) == "".join(row.x.split())


@pytest.mark.parametrize(
    "term, out", [(" a \n b ", "a b"), ("x", ""), ("--_", ""), ("é!", "é!"), ("", "")]
)
def test_normalize_term(one, term, out):
    assert one(t.normalize_term(F.lit(term))) == out


def test_counts_and_ids(one):
    assert one(t.ascii_letter_count(F.lit("aZ1é译"))) == 2
    assert one(t.han_char_count(F.lit("a译文。"))) == 2
    assert one(t.word_count(F.lit(" a　b\n c "))) == 3
    assert one(t.char_count(F.lit("译😀"))) == 2
    assert one(t.block_id(F.lit(7), F.lit(1234))) == "P007-B1234"
    assert one(t.source_hash(F.lit("é"))) == "bf15be717ac1b080b4f1c456692825891ff5073d"
    assert one(t.doc_key(F.lit("book"), F.lit("/x/book.pdf"))).startswith("book_")
    assert one(t.is_yes(F.lit(" yes, fine"))) and not one(t.is_yes(F.lit("no")))


def test_tokens(one):
    assert one(t.tokens(F.lit("铜芯YJV电力电缆 a 3×6mm2"))) == ["铜芯", "YJV", "电力", "力电", "电缆", "6mm2"]
    assert one(t.tokens(F.lit("ab ab"))) == ["ab", "ab"]
    assert one(t.tokens(F.lit(""))) == []


def test_round2_is_exact(spark):
    rng = random.Random(3)
    values = [2.675, 0.125, 0.375, 1.005, 0.29, 0.0] + [rng.uniform(0, 999) for _ in range(2000)]
    values += [k / 200 for k in range(0, 4000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", t.round2("v").alias("r"))
    assert [(r.v, r.r) for r in rows.collect() if r.r != round(r.v, 2)] == []


def test_similarity_matches_the_standard_library(spark):
    rng = random.Random(11)
    letters = "ab 12电缆"
    pairs = [
        ("".join(rng.choices(letters, k=rng.randint(0, 30))), "".join(rng.choices(letters, k=rng.randint(0, 30))))
        for _ in range(300)
    ]
    shifted = "abcdefghij" * 30
    pairs += [(shifted, "x" + shifted), (shifted, shifted), ("", ""), ("a", "")]
    pairs += [(b, a) for a, b in pairs]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", similarity("a", "b").alias("s"), similarity_bound("a", "b").alias("bound")
    )
    for row in rows.collect():
        assert row.s == SequenceMatcher(None, row.a, row.b).ratio()
        assert row.bound >= row.s


def test_best_path_is_the_cheapest_of_all_cuts():
    rng = random.Random(5)
    letters = "力电缆铜"
    for _ in range(300):
        words = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.randint(1, 6) for _ in range(12)}
        run = "".join(rng.choices(letters + "无", k=rng.randint(1, 9)))
        unknown = max(words.values()) + 2
        cuts = []
        for marks in itertools.product([0, 1], repeat=len(run) - 1):
            ends = [0, *[i + 1 for i, m in enumerate(marks) if m], len(run)]
            cut = [run[a:b] for a, b in itertools.pairwise(ends)]
            costs = [words.get(w, unknown if len(w) == 1 else None) for w in cut]
            if None not in costs:
                cuts.append((sum(costs), [-len(w) for w in cut], cut))
        assert segmenter.best_path(run, words, 4, unknown) == min(cuts)[2]


def test_a_learned_dictionary_finds_its_words(spark):
    rng = random.Random(6)
    vocabulary = ["电力", "电缆", "铜芯线", "变压器", "开关", "泵", "不锈钢管"]
    texts = ["".join(rng.choices(vocabulary, k=30)) + f" M{n} x" for n in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = segmenter.learn_words(df, least=20, cohesion=3)
    learned = {r.word for r in words.collect()}
    assert set(vocabulary) <= learned
    segment = segmenter.DictionarySegmenter.from_words(words)
    asked = spark.createDataFrame([("铜芯线电缆 YJV 泵变压器 a 电",), (None,), ("",), ("unbekannt 魑魅",)], "text string")
    got = [r.words for r in asked.select(segment(F.col("text")).alias("words")).collect()]
    assert got == [["铜芯线", "电缆", "YJV", "变压器"], None, [], ["unbekannt"]]
    with pytest.raises(ValueError, match="words are more than"):
        segmenter.DictionarySegmenter(dict.fromkeys(map(str, range(segmenter.MOST_WORDS + 1)), 1))
    assert segmenter.learn_words(df.limit(0)).count() == 0


def test_a_long_run_is_counted_in_one_pass(spark):
    rng = random.Random(8)
    run = "".join(rng.choices("电力缆铜芯", k=120_000))
    df = spark.createDataFrame([(f"{run} x 电力 {run[:9]}",), ("泵",), (None,)], "text string")
    began = time.monotonic()
    words = segmenter.learn_words(df, cohesion=0)
    got = {r.word: r.n for r in words.collect()}
    assert time.monotonic() - began < 20  # a scan up to each character takes minutes
    want = Counter(x[i : i + n] for x in (run, "电力", run[:9], "泵") for n in range(1, 5) for i in range(len(x) - n + 1))
    assert got == {w: n for w, n in want.items() if len(w) == 1 or n >= 5}


def test_operators_take_the_dictionary_as_segmenter(spark):
    segment = segmenter.DictionarySegmenter({"电力": 1, "电缆": 1})
    history = spark.createDataFrame([(1, "电力电缆", "power cable")], "seq long, src string, tgt string")
    posted = fuzzy.postings(history, segment)
    assert sorted((r.token, r.tok_pos) for r in posted.collect()) == [("电力", 0), ("电缆", 1)]
