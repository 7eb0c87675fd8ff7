"""Repairs against the best of all edits, and against a suffix table for long conversations."""

import hashlib
import itertools
import random

import duckdb
from pyspark.sql import functions as F

from tmloom.llm import repair as r
from tmloom.llm.queries import ORACLES, QUERIES, damaged

GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def by_suffix(rows):
    """Cheapest cost and least letters from every place and state, from the end back."""
    best = {0: (0, ""), 3: (0, "")}

    def closed(best):
        for _ in range(3):
            for s, ways in GRAMMAR.items():
                for x, t in ways.items():
                    if x != "s" and t in best:
                        way = (best[t][0] + 2, "I" + best[t][1])
                        best[s] = min(best.get(s, way), way)
        return best

    best = closed(best)
    for initial, fault in reversed(rows):
        here = {}
        for s, ways in GRAMMAR.items():
            options = [(best[s][0] + 3, "D" + best[s][1])]
            if fault not in (1, 2):
                more = fault == 3
                options += [(best[t][0] + more, "K" + best[t][1]) for x, t in ways.items() if x == initial]
                options += [(best[t][0] + 2 + more, "R" + best[t][1]) for x, t in ways.items() if x != "s"]
            here[s] = min(options)
        best = closed(here)
    return best[0]


def by_trying_all(rows):
    """Over all ways to keep, rerole or delete each row with up to two inserts around it."""
    best = None
    for choice in itertools.product("KRD", repeat=len(rows)):
        if any(f in (1, 2) and c != "D" for (_, f), c in zip(rows, choice, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            letters = "".join("I" * k + c for k, c in zip(inserts, choice, strict=False)) + "I" * inserts[-1]
            kept, at = [], 0
            for x in letters:
                kept += [rows[at][0]] if x == "K" else ["*"] if x in "RI" else []
                at += x != "I"
            lead = kept[:1] == ["s"]
            rest = kept[lead:]
            if len(rest) % 2 or (lead and not rest) or any(x not in ("*", "ua"[k % 2]) for k, x in enumerate(rest)):
                continue
            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[x] for x in letters)
            cost += sum(f == 3 and c != "D" for (_, f), c in zip(rows, choice, strict=True))
            best = min(best or (cost, letters), (cost, letters))
    return best


def lattice(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", " ", "x"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_cheapest_is_the_best_of_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        rows = lattice(rng, rng.randint(0, 4))
        assert r.cheapest(rows, r.BEGIN, r.ENDS) == by_trying_all(rows) == by_suffix(rows)
    for _ in range(1500):
        rows = lattice(rng, rng.randint(0, 40))
        assert r.cheapest(rows, r.BEGIN, r.ENDS) == by_suffix(rows)


def test_pieces_together_are_the_whole():
    rng = random.Random(2)
    for _ in range(60):
        rows = lattice(rng, rng.randint(3, 60))
        cuts = sorted(rng.sample(range(1, len(rows)), 2))
        tables = [r.piece_table(x, False) for x in (rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :])]
        ends = [(c, x) for s, t, c, x in r.joined_tables(tables) if s == r.BEGIN and t in r.ENDS]
        assert min(ends) == by_suffix(rows)


def expected(rows):
    """One conversation of (turn, role, text), nulls as spaces."""
    rows = [(t, " " if a is None else a, " " if x is None else x) for t, a, x in rows]
    sha = lambda row: hashlib.sha256(f"{len(row[1])}:{row[1]}{row[2]}".encode()).hexdigest()
    rows.sort(key=lambda row: (row[0] is not None, row[0] or 0, sha(row)))
    seen, marks = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        marks.append((role[:1], fault))
    cost, audit = by_suffix(marks)
    said, state, at = [], 0, 0
    for x in audit:
        role, text = ("", "") if x == "I" else rows[at][1:]
        at += x != "I"
        if x != "D":
            role = role if x == "K" else "assistant" if state == 2 else "user"
            state = GRAMMAR[state][role[:1]]
            said.append((x, role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in said).encode()).hexdigest()
    faults = [sum(f == k for _, f in marks) for k in (1, 2, 3)]
    return (gaps, *faults, illegal, cost, audit, digest), said


def conversations(rng):
    texts = ["Yes.", "No", "Why?", " ", "", None, "a\n", "Well! \n", "“Ok.”", "long " * 5000]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "umpire"]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.choice([1, 2, 4, 8, 15])):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[5:40] + [(900, k, "ua"[k % 2], f"{k % 40}.") for k in range(1300)]


def test_repairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = conversations(rng)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("key", "id", "fault", "sha", "audit", "place")])
    want = {c: expected([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}
    for bits in (9, 3, 1):  # pieces of a few rows, and bundles of bundles
        monkeypatch.setattr(r, "PIECE_BITS", bits)
        got = {x.conv_id: tuple(x)[1:] for x in r.repair(wide).collect()}
        assert got == {c: w for c, (w, _) in want.items()}
    said = {}
    for x in sorted(r.repaired_rows(df).collect(), key=lambda x: x.position):
        assert x.position == len(said.setdefault(x.conv_id, []))
        said[x.conv_id].append((x.edit, x.role, x.text))
    assert said == {c: s for c, (_, s) in want.items() if s}
    assert r.repair(df.limit(0)).count() == 0 == r.repaired_rows(df.limit(0)).count()


def test_the_query_and_its_sql(spark, tmp_path):
    rows = conversations(random.Random(4))
    path = f"{tmp_path}/conversations.parquet"
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.where("conv_id is null or conv_id < 900").coalesce(1).write.parquet(path)
    got = QUERIES["op11_repair"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == names
    want = db.execute(ORACLES["op11_repair"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert damaged(df).where("conv_id is null").count() > 0
