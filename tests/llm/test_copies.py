"""Exact and near copies, and the mix, against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tmloom.llm.exact import drop_exact_copies, exact_groups
from tmloom.llm.graph import components
from tmloom.llm.mix import mix, mixed_documents
from tmloom.llm.simhash import blocks, drop_near_copies, fingerprint, near_groups, trie_links

SCHEMA = "doc_id long, text string, source string, kept string, n_chars long"


def docs(spark, texts, **columns):
    rows = [(k, t, f"s{k % 3}", "clash", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + columns.get("more", []), SCHEMA)


TEXTS = ["", None, "a b c", "a b c", "a b c ", "x" * 9000, "x" * 9000, "x" * 9001, "é" * 5000 + "q",
         "é" * 5000 + "r", "ab" * 3000, " ", "one two three four five"]


@pytest.mark.parametrize("key", [None, "weak"])
@pytest.mark.parametrize("block", [3, 1000, 4096])
def test_exact_groups(spark, block, key, monkeypatch):
    if key:  # all blocks share a few hashes, so lookups are by text
        import tmloom.llm.exact as exact

        weak = lambda b: [F.length(b).cast("long") % 2, F.lit(0).cast("long")]
        monkeypatch.setattr(exact.name_documents, "__defaults__", (block, weak))
    texts = TEXTS if block > 3 else [t if t is None or len(t) < 40 else t[-30:] for t in TEXTS]
    more = [(2, "a b c", None, None, None), (None, "a b c", None, None, None), (None, "only", "z", None, None)]
    df = docs(spark, texts, more=more)
    got = exact_groups(df, block_chars=block).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.text or ""].append(r.doc_id)
    assert len(got) == df.count()
    kept = defaultdict(int)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = groups[text]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_empty_and_dropped(spark):
    assert exact_groups(docs(spark, [])).count() == 0
    df = docs(spark, TEXTS, more=[(3, "a b c", "s", "clash", 5)])
    out = drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 6, 7, 8, 9, 10, 11, 12]


def bitwise(text, n=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 50):
        text = "  ".join(rng.choice(["Aé", "b\x1fc", "DÉ", "e\u00a0f"]) for _ in range(n))
        assert fingerprint(text) == bitwise(text)
    assert fingerprint(None) == fingerprint(" \n\t") == 0
    assert fingerprint("w " * 100_000) == fingerprint("w w w w")


def test_trie_links_every_pair():
    rng = np.random.default_rng(1)
    for distance in (0, 1, 3, 4):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        rows = [base]
        for _ in range(60):
            flips = rng.integers(0, 64, (distance + 2, 40)).astype(np.uint64)
            some = base.copy()
            for k in range(rng.integers(0, distance + 3)):
                some ^= np.uint64(1) << flips[k % len(flips)]
            rows.append(some)
        bits = np.unique(np.concatenate(rows))
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
        want = np.arange(len(bits))
        while (new := np.where(near, want[None, :], len(bits)).min(axis=1)).tolist() != want.tolist():
            want = new
        cuts = blocks(distance)
        widths = np.diff(cuts)
        got = np.arange(len(bits))
        pairs = []
        for r, cut in enumerate(cuts[:-1]):
            turned = (bits << np.uint64(cut)) | (bits >> np.uint64(64 - cut)) if cut else bits
            order = np.argsort(turned)
            value = turned[order]
            key = value >> np.uint64(64 - int(widths[r])) if widths[r] < 64 else value
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            budget = np.concatenate([[0], np.repeat(np.arange(len(widths)), np.roll(widths, -r))])
            root = trie_links(value, starts, int(widths[r]), budget)
            pairs += [(order[i], order[j]) for i, j in enumerate(root)]
        for _ in range(len(bits)):
            before = got.copy()
            for i, j in pairs:
                got[i] = got[j] = min(got[i], got[j])
            if (before == got).all():
                break
        assert (got == want).all()


def test_near_groups(spark):
    rng = random.Random(5)
    texts = ["", None, " "]
    for _ in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(2, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            changed = list(words)
            changed[rng.randrange(len(changed))] = "other"
            texts.append(" ".join(changed))
    texts.append("long " * 30_000)
    df = docs(spark, texts)
    got = {r.doc_id: r for r in near_groups(df).collect()}
    prints = {k: bitwise(t) for k, t in enumerate(texts)}
    root = dict(zip(prints, prints, strict=True))
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {k: r.component_id for k, r in got.items()} == root
    assert all(r.fp % 2**64 == prints[k] for k, r in got.items())
    out = drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root.values()))
    assert near_groups(docs(spark, [])).count() == 0
    twice = drop_near_copies(df.unionByName(df))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(set(root.values()))


def test_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(15)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(300)) for _ in range(6)]
    copy = next(
        c for i in range(300)
        if (fingerprint(c := " ".join([*base[2].split()[:i], "other", *base[2].split()[i + 1 :]])) ^ fingerprint(base[2])).bit_count() <= 4
    )
    rows = [(7, base[0]), (2, base[2]), (7, copy), (None, base[3]), (None, base[4]), (None, copy), (8, base[5]), (8, base[1]),
            (None, base[4]), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(7, base[0]), (2, base[2]), (None, base[3]), (None, base[4]), (8, base[5]), (8, base[1]), (9, None)]
    for frame in (df, df.repartition(3), df.orderBy(F.desc("text"))):
        assert sorted(map(repr, map(tuple, drop_near_copies(frame).collect()))) == sorted(map(repr, want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 200: 150}
    assert components(edges.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(0, 90)), "abcdé"[rng.choice([0, 0, 0, 1, 2, 3, 4])]) for k in range(400)]
    rows += [(400, None, None), (401, "x y", None), (None, "x y z", "a"), (402, " \t", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix(df).collect()
    again = mix(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left = {}, 1.5 * sum(sizes.values())
    open_ = list(order)
    while True:  # resharing until no target is above its bound
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    assert targets == pytest.approx(want)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64
    assert mix(df.limit(0)).count() == 0


def test_mixed_documents(spark):
    rows = [(k % 50, f"{k} " + "w " * (k % 7), "ab"[k % 2]) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixed_documents(df, block_words=4, shard_rows=16)
    assert out.columns == df.columns
    words = lambda frame: sum(len(r.text.split()) for r in frame.collect())
    assert abs(words(out) - 1.5 * words(df)) < 40
    assert {r.text.split()[0] for r in out.collect()} <= {r.text.split()[0] for r in df.collect()} | {"w"}


@pytest.mark.parametrize("distance", [1, 4])
def test_a_hot_block_is_split_without_loss(spark, monkeypatch, distance):
    """Most fingerprints share their first block, and frames are small against what is joined at once."""
    import tmloom.llm.simhash as simhash

    monkeypatch.setattr(simhash, "_HOT", 50)
    monkeypatch.setattr(simhash, "_FLUSH", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**50, 150, dtype=np.uint64)  # fourteen leading zeros
    rows = [base, rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for _ in range(6):
        some = base.copy()
        for _ in range(rng.integers(1, distance + 2)):
            some ^= np.uint64(1) << rng.integers(0, 64, len(some)).astype(np.uint64)
        rows.append(some)
    bits = np.unique(np.concatenate(rows))
    df = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "fp long")
    try:
        got = {(r.a, r.b) for r in simhash.links(df, distance).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance

    def groups(pairs):
        root = {int(b): int(b) for b in bits.view(np.int64)}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(root[a], root[b])
                if root[a] != low or root[b] != low:
                    root[a] = root[b] = low
                    changed = True
        return root

    signed = bits.view(np.int64)
    want = [(int(signed[i]), int(signed[j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 64 for a, b in got)
    assert groups(got) == groups(want)


def test_quotients_of_a_million_shards(spark):
    """One group with a million rows, ties among them, beside a small one."""
    from tmloom.llm.mix import highest_quotients

    rng = np.random.default_rng(1)
    weights = rng.integers(1, 60, 1_000_000) * 1000
    small = np.array([5, 5, 3, 0, 9])
    rows = spark.createDataFrame(
        pa.table({
            "g": np.repeat([0, 1], [len(weights), len(small)]),
            "shard": np.concatenate([np.arange(len(weights)), np.arange(len(small))]),
            "weight": np.concatenate([weights, small]),
        })
    )
    totals = {0: 2_345_678, 1: 7}
    rows = rows.withColumn("total", F.when(F.col("g") == 0, totals[0]).otherwise(totals[1])).withColumn("cap", F.lit(2**62))
    got = highest_quotients(rows, ["g"], "weight", "total", "cap", ["shard"]).select("g", "shard", "seats").toPandas()
    for g, w in ((0, weights), (1, small)):
        most = int(np.ceil(w.max() / w.sum() * totals[g] * 2)) + 3
        k = np.arange(1, most + 1)
        quotient = (w[:, None] / (2 * k - 1)).ravel()
        order = np.lexsort((np.tile(k, len(w)), np.repeat(np.arange(len(w)), most), -quotient))[: totals[g]]
        want = np.bincount(order // most, minlength=len(w))
        have = got[got["g"] == g].sort_values("shard")["seats"].to_numpy()
        assert have.sum() == totals[g] and (have == want).all()
