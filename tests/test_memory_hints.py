import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tmloom.functions.text import source_hash
from tmloom.operators import hints as h
from tmloom.operators import memory as m
from tmloom.sources.files import RESULT_SCHEMA

MEMORY = f"seq long, doc_key string, source_hash string, result {RESULT_SCHEMA}"


def entry(text, translation, terms=(), status="ok", page=1, block_no=1, cache_hit=False):
    pairs = [{"source": a, "target": b} for a, b in terms]
    return {
        "page": page, "block_id": f"P{page:03d}-B{block_no:03d}", "source_text": text,
        "translation": translation, "term_pairs": pairs, "attempts": 1, "elapsed_seconds": 0.5,
        "status": status, "error_message": "", "cache_hit": cache_hit,
    }


def log(spark, rows):
    """rows of (seq, doc_key, hash key or None for the real one, entry)"""
    df = spark.createDataFrame(rows, MEMORY)
    return df.withColumn(
        "source_hash", F.coalesce("source_hash", source_hash("result.source_text"))
    )


def results(spark, entries):
    df = spark.createDataFrame([("d", 1, e) for e in entries], f"doc_key string, b int, r {RESULT_SCHEMA}")
    return df.select("doc_key", F.substring("r.block_id", 7, 9).cast("int").alias("block_no"), "r.*")


def blocks(spark, rows):
    return spark.createDataFrame(
        rows, "doc_key string, page int, block_no int, block_id string, source_text string"
    )


def test_lookup_needs_document_hash_and_text(spark):
    wrong = "0" * 40
    memory = log(spark, [
        (1, "d", None, entry("same", "first")), (2, "d", None, entry("same", "second", [("a", "b")])),
        (3, "e", None, entry("other", "x")), (4, "d", wrong, entry("clash", "y")),
    ])
    asked = blocks(spark, [
        ("d", 4, 2, "P004-B002", "same"), ("d", 5, 1, "P005-B001", "other"), ("d", 6, 1, "P006-B001", "clash"),
    ])
    hits, misses = m.lookup_exact(asked, memory)
    (hit,) = hits.collect()
    assert (hit.page, hit.block_id, hit.translation, hit.attempts, hit.cache_hit) == (4, "P004-B002", "second", 0, True)
    assert [(p.source, p.target) for p in hit.term_pairs] == [("a", "b")]
    assert sorted(r.page for r in misses.collect()) == [5, 6]


def test_upsert_appends_only_what_changed(spark):
    memory = log(spark, [(1, "d", None, entry("a", "A", [("x", "y")])), (2, "d", None, entry("b", "B"))])
    new = results(spark, [
        entry("a", "A", [("x", "y")], page=1),              # identical: skipped
        entry("b", "B", [("p", "q")], page=2),              # terms changed
        entry("b", "B", [("p", "q")], page=3),              # same as the row before: skipped
        entry("b", "B", page=4),                            # back to the old one: a change again
        entry("c", "C", page=5), entry("e", "", status="failed", page=6),
        entry("f", "F", page=7, cache_hit=True),
    ])
    assert sorted(r.result.page for r in m.upsert_memory(memory, new).collect()) == [2, 4, 5]


def test_term_frequencies_count_latest_entries(spark):
    memory = log(spark, [
        (1, "d", None, entry("a", "A", [("old", "1")])), (2, "d", None, entry("b", "B", [("t", "T"), ("t", "T")])),
        (3, "d", None, entry("a", "A2", [("t", "T")])),
    ])
    got = {(r.source, r.target): (r.frequency, r.first_seen.first_seq) for r in m.term_frequencies(memory).collect()}
    assert got == {("t", "T"): (3, 1)}


def contained(spark, block_rows, term_rows, **options):
    terms = spark.createDataFrame(
        [(k, s, s.upper(), f, n) for n, (k, s, f) in enumerate(term_rows)],
        "doc_key string, source string, target string, frequency long, first_seen int",
    )
    found = h.contained_terms(blocks(spark, block_rows), terms, **options)
    return found, terms


@pytest.mark.parametrize("scope", [("doc_key",), ()])
def test_containment_equals_brute_force(spark, scope):
    rng = random.Random(7)
    alphabet = ["ab", "Ba", "c", " ", "-", "ü", "电缆", "力", "+", "12", "  "]
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    block_rows = [(rng.choice("de"), p, 1, f"P{p}", text(rng.randint(0, 30))) for p in range(60)]
    term_rows = list({(rng.choice("de"), text(rng.randint(1, 4))): 1 for _ in range(80)})
    term_rows = [(k, s, rng.randint(1, 3)) for k, s in term_rows]
    term_rows += [("d", " ", 1), ("d", "+", 2), ("e", "b", 1), ("d", "电", 1)]
    term_rows = list({(k, s): (k, s, f) for k, s, f in term_rows}.values())
    found, _ = contained(spark, block_rows, term_rows, scope=scope)
    got = sorted((r.page, r.source, r.first_seen) for r in found.collect())
    expected = sorted(
        (p, s, n)
        for k, p, _b, _i, x in block_rows
        for n, (tk, s, _f) in enumerate(term_rows)
        if (tk == k or not scope) and s.lower() in x.lower()
    )
    if not scope:  # one glossary: the same pair of two documents is one term
        got, expected = ([(p, s) for p, s, _n in x] for x in (got, expected))
        got, expected = sorted(set(got)), sorted(set(expected))
    assert got == expected


@pytest.mark.parametrize("scope", [("doc_key",), ()])
def test_best_terms_are_the_top_of_all_contained(spark, scope):
    rng = random.Random(17)
    alphabet = ["ab", "Ba", "c", " ", "-", "ü", "电缆", "力", "+", "12", "  "]
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    block_rows = [(rng.choice("de"), p, 1, f"P{p}", text(rng.randint(0, 60))) for p in range(50)]
    pairs = {(rng.choice("de"), text(rng.randint(1, 5))) for _ in range(150)} | {("d", " "), ("e", "+"), ("d", "B"), ("d", "b")}
    found, terms = contained(spark, block_rows, [(k, s, rng.randint(1, 3)) for k, s in sorted(pairs)], scope=scope)
    for k in (1, 4):
        want = sorted(map(tuple, h.top_hints(found, k).select(*h.BLOCK_KEY, "source", "target", "rank").collect()))
        got = sorted(map(tuple, h.best_terms(blocks(spark, block_rows), terms, k, scope).collect()))
        assert got == want and len(got) > 40
    assert h.best_terms(blocks(spark, block_rows).limit(0), terms, 3, scope).count() == 0
    assert h.best_terms(blocks(spark, block_rows), terms.limit(0), 3, scope).count() == 0


def test_top_hints_order(spark):
    words = [f"w{i:02d}" for i in range(10)]
    term_rows = [("d", w, 1) for w in words] + [("d", "w0", 1), ("d", "w", 5)]
    found, terms = contained(spark, [("d", 1, 1, "P", " ".join(words)), ("d", 2, 1, "P", "zz")], term_rows)
    (row,) = h.hint_lists(h.top_hints(found)).collect()
    assert [x.source for x in row.hints] == ["w", *words[:7]]
    assert row.page == 1


@pytest.mark.parametrize("scope", [("doc_key",), ()])
def test_blocks_that_first_terms_do_not_settle_meet_all_terms(spark, scope, monkeypatch):
    monkeypatch.setattr(h, "LEADERS", 3, raising=False)
    rng = random.Random(23)
    alphabet = ["ab", "Ba", "c", " ", "-", "电缆", "+", "12"]
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    block_rows = [(rng.choice("de"), p, 1, f"P{p}", text(rng.randint(0, 40))) for p in range(40)]
    block_rows += [("d", 1, 1, "P1", "12 ab"), ("d", None, 1, "P", "ab c"), (None, 2, 1, "P2", "ab c"), ("d", 90, 1, "P90", None)]
    pairs = {(rng.choice("de"), text(rng.randint(1, 4))) for _ in range(60)}
    found, terms = contained(spark, block_rows, [(k, s, rng.randint(1, 3)) for k, s in sorted(pairs)], scope=scope)
    for k in (1, 3):
        want = sorted(map(repr, h.top_hints(found, k).select(*h.BLOCK_KEY, "source", "target", "rank").collect()))
        assert sorted(map(repr, h.best_terms(blocks(spark, block_rows), terms, k, scope).collect())) == want
        lists = sorted(map(repr, h.hint_lists(h.top_hints(found, k)).collect()))
        assert sorted(map(repr, h.glossary_hints(blocks(spark, block_rows), terms, k, scope).collect())) == lists


def test_settled_blocks_are_not_cut_into_words(spark, monkeypatch):
    words = [f"w{i:03d}" for i in range(300)]
    term_rows = [("d", w, 5 if i < 20 else 1) for i, w in enumerate(words)]
    rows = [("d", 1, 1, "P", " ".join(words)), ("d", 2, 1, "P", " ".join(words[5:20]))]
    _, terms = contained(spark, rows, term_rows)

    def cut(*_):
        raise AssertionError("cut into words")

    monkeypatch.setattr(h, "_block_words", cut)
    got = {r.page: [x.source for x in r.hints] for r in h.glossary_hints(blocks(spark, rows), terms).collect()}
    assert got == {1: words[:8], 2: words[5:13]}


def test_words_terms_and_entries_are_not_broadcast(spark, monkeypatch):
    """Packed tables look small to Spark; as broadcast tables they fill the driver."""
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    for module in (h, m):
        monkeypatch.setattr(
            module, "materialize", lambda df, name="table", w=module.materialize: (plans.append((name, plan(df))), w(df, name))[1]
        )
    blocks = spark.createDataFrame(
        [("d", 1, 1, "A valve and a pump ring"), ("d", 2, 1, "no such thing")], "doc_key string, page int, block_no int, source_text string"
    )
    terms = spark.createDataFrame(
        [("d", w, w.upper(), 1, i) for i, w in enumerate(["valve", "pump ring", "seal"])],
        "doc_key string, source string, target string, frequency long, first_seen int",
    )
    monkeypatch.setattr(h, "LEADERS", 1)  # so that blocks meet the terms by their words
    best = h.best_terms(blocks, terms, 1)
    plans.append(("best", plan(best)))
    assert [tuple(r) for r in best.collect()] == [("d", 1, 1, "pump ring", "PUMP RING", 1)]
    result = "page int, block_id string, source_text string, translation string, term_pairs array<struct<source:string,target:string>>"
    memory = spark.createDataFrame(
        [(0, "d", hashlib.sha1(b"no such thing").hexdigest(), (2, "b", "no such thing", "x", []))],
        f"seq long, doc_key string, source_hash string, result struct<{result.replace(' ', ':').replace(',:', ',')}>",
    )
    hits, misses = m.lookup_exact(blocks.withColumn("block_id", F.lit("b")), memory)
    assert (hits.count(), misses.count()) == (1, 1)
    assert {"several", "looked"} <= {name for name, _ in plans}
    for name, text in plans:
        # a row for each scope or partition may be broadcast, one for each word, term or block may not
        keys = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", text)
        assert all(re.fullmatch(r"(doc_key|_part)#\d+L?", k) for k in keys), (name, keys)


def test_parts_of_words_are_cut_after_the_shuffle(spark):
    """Words travel to the heads of their parts; the parts, far more, stay where they are cut."""
    rng = random.Random(5)
    made = ["".join(rng.choices("abcn", k=rng.randint(1, 30))) for _ in range(120)]
    words = spark.createDataFrame([(rng.choice("de"), w) for w in made] + [(None, "an"), ("d", None)], "doc_key string, _word string")
    units = spark.createDataFrame(
        [(rng.choice("de"), w[i : i + rng.randint(1, 9)]) for w in made for i in (0, 3, 11)] + [(None, "a"), ("d", "nbnb")],
        "doc_key string, _unit string",
    ).where("_unit <> ''")
    for scope in (["doc_key"], []):
        met = h._met(words, units, scope)
        columns = [*scope, "_word", "_unit"]
        got = sorted(map(tuple, met.select(*columns).collect()))
        pairs = {
            (*((w.doc_key,) if scope else ()), w._word, u._unit) for w in words.collect() for u in units.collect()
            if w._word and u._unit in w._word and (not scope or w.doc_key == u.doc_key is not None)
        }
        assert got == sorted(pairs) and len(got) > 500
        plan = met._jdf.queryExecution().optimizedPlan().toString().splitlines()
        (dealt,) = [i for i, x in enumerate(plan) if "RepartitionByExpression" in x]
        assert any("explode" in x and "_part" in x for x in plan[:dealt])
        # below it, a row for each character of a word at most, and one for each distinct character
        long_ = spark.createDataFrame([("d", "".join(rng.choices("abcn", k=60)))], "doc_key string, _word string")
        assert long_.select(F.explode(h._heads(F.col("_word")))).count() <= 60 + 4


@pytest.mark.parametrize("scope", [("doc_key",), ()])
def test_terms_met_by_many_words_do_not_travel_with_the_blocks(spark, scope, monkeypatch):
    seen, w = {}, h.materialize
    monkeypatch.setattr(h, "materialize", lambda df, name="table": seen.setdefault(name, w(df, name)))
    monkeypatch.setattr(h, "LEADERS", 2)
    text = " ".join(f"a{i}an" for i in range(50))
    block_rows = [("d", p, 1, f"P{p}", f"{text} only{p}") for p in range(10)]
    block_rows += [("d", 3, 1, "P3", "a0an once"), ("d", None, 1, "P", "an a0an x0 y"), (None, 5, 1, "P5", "an"), ("d", 7, 2, "P7", None)]
    term_rows = [("d", s, 1) for s in ("a", "an", "A7AN", "only", "once", "a0an x0", "x0 y", "-", "  ")]
    found, _ = contained(spark, block_rows, term_rows, scope=scope)
    got = sorted(((r.doc_key or "", r.page if r.page is not None else -1, r.source) for r in found.collect()))
    # pages without a number have their one-word terms; texts of one key count together
    want = [("d", -1, s) for s in ("a", "an")] + [("d", p, s) for p in range(10) for s in ("A7AN", "a", "an", "only")] + [("d", 3, "once")]
    want += [] if scope else [("", 5, "a"), ("", 5, "an")]
    assert got == sorted(want)
    assert {r.source for r in seen["common"].collect()} == {"a", "an"}
    sent = seen["candidates"].where("source in ('a', 'an')").count()
    assert sent == 0 and seen["candidates"].where("source = 'A7AN'").count() == 10


def test_only_scopes_with_open_blocks_put_all_their_terms_in_order(spark, monkeypatch):
    monkeypatch.setattr(h, "LEADERS", 2)
    seen, written, best, w = [], [], h._best_by_word, h.materialize
    monkeypatch.setattr(h, "_best_by_word", lambda b, units, *a: (seen.append(units), best(b, units, *a))[1])
    monkeypatch.setattr(h, "materialize", lambda df, name="table": (written.append(name), w(df, name))[1])
    block_rows = [("d", 1, 1, "P1", "one two"), ("e", 1, 1, "P1", "six"), ("f", 1, 1, "P1", "one")]
    term_rows = [("d", "one", 3), ("d", "two", 2), ("d", "six", 1), ("e", "one", 2), ("e", "two", 2), ("e", "six", 1), ("f", "one", 1)]
    _, terms = contained(spark, block_rows, term_rows)
    for stored in (False, True):
        seen.clear(), written.clear()
        hints = h.glossary_hints(blocks(spark, block_rows), terms, 2, stored=stored)
        got = {r.doc_key: [x.source for x in r.hints] for r in hints.collect()}
        assert got == {"d": ["one", "two"], "e": ["six"], "f": ["one"]}
        assert {r.doc_key for r in seen[0].collect()} == {"e"}
        assert ("units" in written) == (not stored)


@pytest.mark.parametrize("scope", [("doc_key",), ()])
def test_parts_of_words_are_looked_up_without_sorting(spark, scope, monkeypatch):
    """The parts of words, most rows of the search, are neither sorted nor dealt again by themselves."""
    plans, w = {}, h.materialize
    monkeypatch.setattr(
        h, "materialize", lambda df, name="table": (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), w(df, name))[1]
    )
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    rng = random.Random(11)
    made = ["".join(rng.choices("abn", k=rng.randint(1, 9))) for _ in range(60)] + ["banana", "--"]
    block_rows = [(rng.choice("de"), p, 1, f"P{p}", " ".join(rng.choices(made, k=12)) + " --- ") for p in range(12)]
    term_rows = [(rng.choice("de"), x, rng.randint(1, 3)) for x in {*made, "an", "a", "na b", "aN", "-", "--"}]
    found, _ = contained(spark, block_rows, term_rows, scope=scope)
    got = sorted((r.doc_key, r.page, r.source) for r in found.collect())
    assert got == sorted(
        (d, p, s) for d, p, _, _, text in block_rows for e, s, _ in term_rows if (not scope or d == e) and s.lower() in text.lower()
    )
    plan = plans["met"]
    assert "Sort" not in plan and "Window" not in plan and plan.count("ShuffledHashJoin") == 2
    assert not any("_unit" in x and "_at" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert spark.conf.get(setting) == before
