"""Classifiers, tokens, urls, pages and neighbours on small tables."""

import html
import itertools
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tmloom.llm import language, quality, toxicity
from tmloom.llm.html import main_text, page_blocks
from tmloom.llm.neighbours import _small, descend, greedy_search, nearest
from tmloom.llm.pieces import Pieces, decode_ids, encode, encode_texts
from tmloom.llm.queries import tokenizer_path
from tmloom.llm.urls import filter_urls, rules_table, site_rule, word_rule

ODD = ["", None, " ", "\n\n", "12 34 !!", "a", "long " * 40_000]


def sentence(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_tokens_as_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rng = random.Random(4)
    letters = "aaabbt he▁▁ \n\té日😀ß1.,th the er"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    texts += ["a" * 3000, " " * 999, "\n" * 40, "▁", "the" * 900, *ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    for r in encode(df, tokenizer_path()).collect():
        want = library.encode(texts[r.doc_id] or "")
        assert r.ids == want
        assert r.decoded == library.decode(want)
    assert encode(df.limit(0), tokenizer_path()).count() == 0


def differing(pieces, library, texts):
    got = encode_texts(pieces, texts, {})
    return [t for t, g, w in zip(texts, got, library.encode(texts), strict=True) if np.frombuffer(g, "<i4").tolist() != w]


def test_runs_of_every_length_of_repeated_pieces():
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    pieces = Pieces.load(tokenizer_path())
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(library.vocab_size())]
    repeated = sorted({p[0] for p in names if len(p) > 1 and set(p) == {p[0]}})
    repeated += sorted({p[: len(p) // 2] for p in names if len(p) > 3 and p[: len(p) // 2] * 2 == p})
    assert " " in repeated
    for unit in repeated:
        runs = [unit * n for n in range(1, 301)]
        assert not differing(pieces, library, runs)
        assert not differing(pieces, library, ["def f():\n" + r + "return 1" for r in runs])


def test_a_large_fuzz_over_indentation():
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    pieces = Pieces.load(tokenizer_path())
    rng = random.Random(11)
    words = ["return", "x", "if", "==", "--", "the", "er", "aaa", "\t", "é", "____", "1000", "....", "▁"]

    def line():
        body = (rng.choice(words) + rng.choice(["", " ", " " * rng.randint(1, 40)]) for _ in range(rng.randint(0, 4)))
        return " " * rng.randint(0, 70) + "".join(body)

    texts = ["\n".join(line() for _ in range(rng.randint(1, 3))) for _ in range(50_000)]
    assert not differing(pieces, library, texts)


def test_models_of_other_rules_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    proto.pieces[700].type = proto.pieces[700].USER_DEFINED
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="spaces are removed, user-defined"):
        Pieces.load(str(path))


def test_cache_never_changes_ids(monkeypatch):
    import tmloom.llm.pieces as p

    pieces = Pieces.load(tokenizer_path())
    rng = random.Random(1)
    texts = [sentence(rng, ["the", "er", "in", "tion", "é"], 30) for _ in range(40)]
    want = encode_texts(pieces, texts, {})
    monkeypatch.setattr(p, "CACHE_UNITS", 20)
    monkeypatch.setattr(p, "CACHE_CHARS", 3)
    cache = {}
    assert [encode_texts(pieces, [t], cache)[0] for t in texts] == want
    assert len(cache) <= 20 + 64
    assert decode_ids(pieces, [pieces.byte_ids[0xFF], pieces.byte_ids[65]]) == "�A"


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 0, 6, 1, 5])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    starts = np.cumsum(lengths) - lengths
    labels = language.viterbi(scores, starts, lengths, 1.5)

    def value(path, rows):
        return sum(rows[k, s] for k, s in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))

    for s, n in zip(starts, lengths, strict=True):
        rows = scores[s : s + n]
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: value(p, rows))
        assert value(labels[s : s + n], rows) == pytest.approx(value(best, rows))


SYLLABLES = {"xx": ["ka", "lo", "mi"], "yy": ["ta", "ro", "shu"], "zz": ["да", "но", "ли"]}


def test_language(spark):
    rng = random.Random(6)
    rows = [(k, sentence(rng, SYLLABLES[lang], 30), lang) for k, lang in enumerate(["xx", "yy", "zz"] * 40)]
    learn = spark.createDataFrame([*rows, (900, "kalo", None)], "doc_id long, text string, lang string")
    mixed = sentence(rng, SYLLABLES["xx"], 60) + " " + sentence(rng, SYLLABLES["zz"], 20)
    texts = [(r[0], sentence(rng, SYLLABLES[r[2]], 12)) for r in rows[:30]] + [(100, mixed)]
    odd = [(200 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(texts + odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.identify(df, learn).collect()}
    assert len(got) == len(texts) + len(odd)
    assert all(got[k].lang_pred == rows[k][2] for k in range(30))
    assert [(s.lang, s.words) for s in got[100].spans] == [("xx", 60), ("zz", 20)]
    assert got[100].lang_pred == "xx" and 0.5 < got[100].score < 1
    assert [got[200 + k].lang_pred for k in range(5)] == ["und"] * 5
    assert got[205].lang_pred in SYLLABLES
    nothing = language.identify(df, learn.limit(0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(df.limit(0), learn).count() == 0


def test_toxicity(spark):
    rng = random.Random(7)

    def text(bad):
        words = sentence(rng, SYLLABLES["xx"], rng.randint(20, 200)).split()
        for _ in range(bad * (1 + len(words) // 40)):
            words[rng.randrange(len(words))] = rng.choice(["grumpf", "grumpfen", "vexel"])
        return " ".join(words)

    rows = [(k, text(k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    df = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(ODD)], "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").where("doc_id < 300")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df.drop("toxic"), labels).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    held = [(got[k] >= 0.5) == bool(label) for k, _, label in rows if k >= 300]
    assert sum(held) >= 0.95 * len(held)
    one = toxicity.score_toxicity(df.drop("toxic"), labels.where("toxic = 0")).collect()
    assert max(r.score for r in one) < 0.5
    assert toxicity.score_toxicity(df.drop("toxic").limit(0), labels).count() == 0


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(2)
    counts = np.array([3, 1, 5])
    unary, step = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    log_p, pair, inner = quality.marginals(unary, step, counts)
    at = 0
    for n in counts:
        rows = unary[at : at + n]
        weight = {
            y: np.exp(sum(rows[k, s] for k, s in enumerate(y)) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            for y in itertools.product((0, 1), repeat=int(n))
        }
        total = sum(weight.values())
        for k in range(n):
            assert np.exp(log_p[at + k, 1]) == pytest.approx(sum(w for y, w in weight.items() if y[k]) / total)
        for k in range(n - 1):
            got = pair[np.flatnonzero(inner == at + k)[0], 0, 1]
            assert got == pytest.approx(sum(w for y, w in weight.items() if y[k : k + 2] == (0, 1)) / total)
        at += n


def test_quality(spark):
    rng = random.Random(8)

    def text(good):
        lines = [sentence(rng, SYLLABLES["yy"], 12).capitalize() + "." for _ in range(rng.randint(1, 9))]
        return "\n".join(lines) if good else "\n".join(x.replace(" ", "### ").upper() for x in lines)

    rows = [(k, text(k % 4 > 0), int(k % 4 > 0)) for k in range(300)]
    df = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(ODD)], "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").where("doc_id < 200")
    got = {r.doc_id: r for r in quality.score_quality(df.drop("quality"), labels).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[k].score >= 0.7) == bool(label) for k, _, label in rows if k >= 200]
    assert sum(held) >= 0.95 * len(held)
    assert got[1000].lines == got[1001].lines == 1 and got[1003].lines == 3
    none = quality.score_quality(df.drop("quality"), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_trains_on_all_lines(spark, monkeypatch):
    seen, fit = [], quality.LineField.fit
    monkeypatch.setattr(quality.LineField, "fit", lambda features, counts, *rest: (seen.append((features, counts)), fit(features, counts, *rest))[1])
    texts = ["\n".join(f"{'AB#' if k % 3 else 'a word.'} {k}" for k in range(n)) for n in (200, 3, 130, 1)]
    rows = [(k, t, k % 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    quality.score_quality(df.drop("quality"), df.select("doc_id", "quality")).count()
    features, counts = seen[0]
    assert sorted(counts.tolist()) == [1, 3, 130, 200]
    at = counts.tolist().index(200)
    start = int(counts[:at].sum())
    assert np.allclose(features[start : start + 200], quality.line_features(texts[:1])[0], atol=1e-5)


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(4)
    counts = np.array([1, 4, 3])
    x, label, weight = rng.normal(size=(8, 5)), np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])
    theta = rng.normal(size=14)
    value, slope = quality.chain_gradient(theta, x, counts, label, weight)
    unary, step, at, want = x @ theta[:10].reshape(5, 2), theta[10:].reshape(2, 2), 0, 0.0
    for n, y, w in zip(counts, label.astype(int), weight, strict=True):  # of all labellings, the one that is all y
        scores = [
            sum(unary[at + k, s] for k, s in enumerate(z)) + sum(step[a, b] for a, b in itertools.pairwise(z))
            for z in itertools.product((0, 1), repeat=int(n))
        ]
        want -= w * (scores[-1 if y else 0] - np.log(np.exp(scores).sum()))
        at += n
    assert value == pytest.approx(want)
    for k in range(14):
        more = theta.copy()
        more[k] += 1e-6
        assert (quality.chain_gradient(more, x, counts, label, weight)[0] - value) / 1e-6 == pytest.approx(slope[k], abs=1e-4)


def test_a_very_long_training_document(spark):
    """A hundred thousand lines in one document take as many steps as the longest run, not as many as lines."""
    rng = random.Random(15)
    good = "\n".join(sentence(rng, SYLLABLES["yy"], 6).capitalize() + "." for _ in range(500))
    rows = [(0, "\n".join([good] * 200), 1), (1, "AB## CD##\n" * 30, 0)] + [
        (k, "\n".join(good.split("\n")[k : k + 5]) if k % 2 else "XY## ZZ##\nQ## W##", k % 2) for k in range(2, 40)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    started = time.monotonic()
    got = {r.doc_id: r.score for r in quality.score_quality(df.drop("quality"), df.select("doc_id", "quality")).collect()}
    assert time.monotonic() - started < 60
    assert all((got[k] >= 0.7) == bool(label) for k, _, label in rows)


def test_spelling_models_are_kneser_ney():
    """Word values against the formula, worked out from the counts anew for each letter."""
    rng = random.Random(21)
    counts = [Counter(), Counter()]
    for k in (0, 1):
        for _ in range(60):
            for g in toxicity.grams_of("".join(rng.choices("abc" if k else "abd", k=rng.randint(1, 5))), 3):
                counts[k][g] += 1
    models = toxicity.SpellingModels.fit([(g, counts[0][g], counts[1][g]) for g in counts[0] | counts[1]], 3)
    every = set(counts[0]) | set(counts[1])
    before = {g[j:]: {h[i - 1] for h in every for i in range(1, len(h)) if h[i:] == g[j:]} for g in every for j in range(1, len(g))}
    letters = len({g[-1] for g in before}) + 1

    def shared(g):  # of both classes: by how many letters stand before
        if not g:
            return 1 / letters
        followers = {x: len(s) for x, s in before.items() if x[:-1] == g[:-1] and len(x) == len(g)}
        if not followers:
            return shared(g[1:])
        lower = 1 / letters if len(g) == 1 else shared(g[1:])
        d = toxicity.DISCOUNT
        return (max(followers.get(g, 0) - d, 0) + d * len(followers) * lower) / sum(followers.values())

    def prob(k, g):
        of = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not of:
            return shared(g[1:])
        d = toxicity.DISCOUNT
        return (max(of.get(g, 0) - d, 0) + d * len(of) * shared(g[1:])) / sum(of.values())

    words = ["a", "abc", "dab", "cab", "bb", "abd", "ccc"]
    want = [sum(np.log(prob(1, g)) - np.log(prob(0, g)) for g in toxicity.grams_of(w, 3)) for w in words]
    assert models.word_values(words) == pytest.approx(want, abs=1e-4)


def test_urls(spark):
    rules = [site_rule("org", "/", "allow"), site_rule("example.org", "/en/1", "block"), word_rule("spam"),
             ("any", ".*zzz.*", [], "block", 1)]
    urls = ["http://a.ORG/x", "https://www.example.org/en/12?q", "example.org/en/1", None, "", "x://org", "x://notorg/",
            "http://a.spam-x.com/", "http://aspam.com/", "http://q.com/zzzz#y", "http://example.org/en/1",
            "http://h?a://b/", "http://a.org/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules_table(spark, rules)).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") == got[12]
    assert got[1] == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == got[3] == got[4] == ("", "", None, None)
    assert got[5] == ("org", "", None, None)
    assert got[6] == ("notorg", "/", None, None)
    assert got[7][2:] == ("*spam*", "block") and got[8][2:] == (None, None)
    assert got[9][2:] == ("any", "block")
    assert got[10][2:] == ("example.org/en/1", "block")
    assert got[11][:2] == ("h", "")
    assert filter_urls(df.limit(0), rules_table(spark, rules)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a><li>more</ul></nav><div class="top-banner ad">buy</div><p>{same}</p>
<article class=a><header><h1>Title &amp; more</h1></header><p><b>First<br>line &nbsp; here<p>Second &lt;x&gt;<ul><li>one<li>two</ul>
<aside>side</aside><form><p>ask</form><div id="comments"><p>nice</div><p>{own}</article><footer>end</footer>"""


def test_pages(spark):
    want = "Title & more\n\nFirst line here\n\nSecond <x>\n\none\n\ntwo\n\n{own}"
    rows = [(k, f"http://h.com/{k}", PAGE.format(same="We use this notice everywhere", own=f"own {k}")) for k in range(8)]
    rows += [(90, None, None), (91, "http://h.com/", ""), (92, "x", "plain < text & <b>bold"), (93, "y", "<p>" * 3000 + "deep"),
             (94, "z", "<div title=\"a>b\">kept</div><script>lost"), (95, "z", "<!-- open <p>lost")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(got[k] == want.format(own=f"own {k}") for k in range(8))
    assert got[90] == got[91] == got[95] == ""
    assert got[92] == "plain < text & bold" and got[93] == "deep" and got[94] == "kept"
    assert main_text(df.limit(0)).count() == 0


def test_noise_words_never_empty_a_page(spark):
    sources = [
        '<body class="has-sidebar"><p>text</p>', '<body class="sidebar"><p>text</p>',
        '<div class="layout no-comments"><p>text</p></div>', '<main class="with-nav"><p>text</p></main>',
        '<div id="share-wrapper"><article><p>text</p></article></div>',
        '<div id="share"><article class="related"><p>text</p><div class="ad">no</div></article></div><div class="ad">no</div>',
        '<article><p>text</p></article><div id="comments"><article>no</article></div>',
        '<aside><article>no</article></aside><main><p>text</p></main>',
    ]
    df = spark.createDataFrame([(k, f"http://h{k}.com/", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in main_text(df).collect()} == dict.fromkeys(range(len(sources)), "text")


def test_copies_of_a_page_are_no_boilerplate(spark):
    rng = random.Random(13)
    words = lambda n: sentence(rng, SYLLABLES["xx"], n)
    page = '<div class="content"><p>{}</p><p>{}</p></div><div class="low"><p>{}</p></div>'
    a, b, c, notice = words(60), words(70), words(50), words(8)
    rows = [(k, f"http://same.com/?t={k}", page.format(a, b, notice)) for k in range(6)]
    rows += [(10 + k, f"http://near.com/?t={k}", page.format(a, b, f"seen {k}")) for k in range(6)]
    rows += [(100 + k, f"http://most.com/?t={k}", page.format(a, c, notice)) for k in range(60)]
    own = {200 + k: (words(40), words(40)) for k in range(6)}
    rows += [(k, f"http://most.com/{k}", page.format(*x, notice)) for k, x in own.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(got[k] == f"{a}\n\n{b}\n\n{notice}" for k in range(6))
    assert all(got[10 + k] == f"{a}\n\n{b}\n\nseen {k}" for k in range(6))
    assert all(got[100 + k] == f"{a}\n\n{c}" for k in range(60))
    assert all(got[k] == "\n\n".join(x) for k, x in own.items())


def test_blocks_of_plain_markup():
    rng = random.Random(9)
    parts = [html.escape(sentence(rng, SYLLABLES["xx"], 5)) for _ in range(200)]
    blocks = page_blocks("<body>" + "".join(f"<p>{p}</p>" for p in parts))
    assert [b.text for b in blocks] == parts


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (1080, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = nearest(df, df.where("vec_id % 20 = 0"))
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 600, 20))
    hits, y = 0, x.astype(float)
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        sims = y @ y[q]
        order = [k for k in np.lexsort((np.arange(600), -sims)) if k != q][:20]
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(r.score == pytest.approx(sims[r.vec_id], abs=1e-12) for r in found)
        hits += len({r.vec_id for r in found} & set(order))
    assert hits >= 0.95 * 20 * len(by)
    few = df.where("vec_id < 3")
    assert sorted((r.query_id, r.vec_id) for r in nearest(few, few.where("vec_id = 0")).collect()) == [(0, 1), (0, 2)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_search_goes_on_until_the_beam_is_settled(spark):
    n = 10
    angle = np.linspace(0, 3, n)
    x = np.column_stack([np.cos(angle), np.sin(angle)])
    nodes = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, vec binary")
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "node long, nbr long")
    asked = spark.createDataFrame([(0, bytearray(x[-1].tobytes())), (1, bytearray(x[3].tobytes()))], "query long, vec binary")
    entries = spark.createDataFrame([(0, 0), (1, 0)], "query long, node long")
    got = greedy_search(asked, nodes, edges, "<f8", entries, beam=3, width=4).collect()
    by = {q: sorted(r.node for r in got if r.query == q) for q in (0, 1)}
    assert by == {0: [7, 8, 9], 1: [2, 3, 4]}


def test_recall_on_a_large_table(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    asked = np.arange(0, len(x), 500)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-sims, 19, axis=1)[:, :20]
    got = nearest(df, df.where("vec_id % 500 = 0")).toPandas().groupby("query_id")["vec_id"].agg(set)
    hits = sum(len(got[q] & set(w.tolist())) for q, w in zip(asked.tolist(), want, strict=True))
    assert hits >= 0.9 * 20 * len(asked)


def test_every_link_into_a_hub_takes_part(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    nodes = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, vec binary")
    rows = [(k, 0, float(x[k] @ x[0]), True) for k in range(2, 60)] + [(0, 1, float(x[0] @ x[1]), True), (1, 0, float(x[0] @ x[1]), True)]
    edges = spark.createDataFrame(rows, "node long, nbr long, sim double, new boolean")
    small = _small(nodes, "<f4")
    pairs = {(r.node, r.nbr) for r in descend(edges, small, 60, 5).collect()}
    assert {(k, 1) for k in range(2, 60)} <= pairs  # each is offered the hub's neighbour
    met = []
    for turn in (0, 1):
        old = descend(edges.withColumn("new", F.lit(False)), small, 60, 5, turn)
        met.append({(r.node, r.nbr) for r in old.collect()} - {(a, b) for a, b, *_ in rows})
    assert all(len(m) > 58 for m in met) and met[0] != met[1]  # others of the hub's links each round
