"""Repair of conversations: cheapest edits to alternating roles, by Dijkstra from both ends of an edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tmloom.operators.scale import materialize

PIECE_BITS = 9  # a piece of a conversation holds at most 2^9 rows, a bundle of pieces 2^9 pieces
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs; the last for a truncated row that stays
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults of a row, 0 for none
ROLES = {"u": "user", "a": "assistant"}

# The grammar (s?(ua)+)? as states: before all, after s, after u, after a.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    BEGIN: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER},
}
ENDS = (BEGIN, ASSISTANT)
LEGAL = {"su", "ua", "au"}


def _steps(state: int, initial: str, fault: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of all edits of one row."""
    out = [(DELETE, "D", state)]
    if fault in (BLANK, DUPLICATE):
        return out
    extra = TRUNCATED if fault == CUT else 0
    for role, after in NEXT[state].items():
        if role == initial:
            out.append((KEEP + extra, "K", after))
        if role in ROLES:
            out.append((REROLE + extra, "R", after))
    return out


def _inserts(state: int) -> list[tuple[int, str, int]]:
    return [(INSERT, "I", after) for role, after in NEXT[state].items() if role in ROLES]


def cheapest(rows: Sequence[tuple[str, int]], begin: int, ends: Iterable[int]) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits of ``rows`` (initial, fault) from state ``begin`` to one of ``ends``.

    The lattice has a node for each place between rows and each state.  One heap
    grows from the begin, one from the ends; both settle a node with its least
    cost and, among equal costs, the least letters up to it or from it on.  (At
    one node letters of equal cost are never the start of one another, as each
    letter has a cost by itself, so the least part stays least whatever joins
    it.)  Heaps that together pass the best cost found have settled, between
    them, some step of every cheapest path; all such steps are joined, and the
    least letters win.  None if there is no way.
    """
    n = len(rows)
    after: dict[tuple[int, int], list] = {}
    before: dict[tuple[int, int], list] = {(i, s): [] for i in range(n + 1) for s in NEXT}
    for i in range(n + 1):
        for s in NEXT:
            moves = [(c, x, (i, t)) for c, x, t in _inserts(s)]
            if i < n:
                moves += [(c, x, (i + 1, t)) for c, x, t in _steps(s, *rows[i])]
            after[i, s] = moves
            for c, x, node in moves:
                before[node].append((c, x, (i, s)))
    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str]] = {}
    # costless steps pass a row, so among equal costs the places nearer to the heap's own end come first
    forward = [(0, 0, "", begin)]
    reverse = [(0, 0, "", s) for s in sorted(ends)]
    best = None
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        if forward[0][0] <= reverse[0][0]:
            cost, i, letters, s = heappop(forward)
            if (i, s) in ahead:
                continue
            ahead[i, s] = cost, letters
            for c, x, node in after[i, s]:
                if node not in ahead:
                    heappush(forward, (cost + c, node[0], letters + x, node[1]))
            met = [cost + c + behind[node][0] for c, _, node in [(0, "", (i, s)), *after[i, s]] if node in behind]
        else:
            cost, back, letters, s = heappop(reverse)
            i = n - back
            if (i, s) in behind:
                continue
            behind[i, s] = cost, letters
            for c, x, node in before[i, s]:
                if node not in behind:
                    heappush(reverse, (cost + c, n - node[0], x + letters, node[1]))
            met = [cost + c + ahead[node][0] for c, _, node in [(0, "", (i, s)), *before[i, s]] if node in ahead]
        best = min([*met, best] if best is not None else met, default=None)
    if best is None:
        return None
    joined = []
    for node, (cost, letters) in ahead.items():
        if node in behind and cost + behind[node][0] == best:
            joined.append(letters + behind[node][1])
        joined += [
            letters + x + behind[to][1]
            for c, x, to in after[node]
            if to in behind and cost + c + behind[to][0] == best
        ]
    return best, min(joined)


def piece_table(rows: Sequence[tuple[str, int]], whole: bool) -> list[tuple[int, int, int, str]]:
    """(from state, to state, cost, letters) of a piece; of a whole conversation only its best."""
    if whole:
        found = cheapest(rows, BEGIN, ENDS)
        return [(BEGIN, BEGIN, *found)]
    ways = ((s, t, cheapest(rows, s, [t])) for s in NEXT for t in NEXT)
    return [(s, t, *found) for s, t, found in ways if found]


def joined_tables(tables: Sequence[list]) -> list[tuple[int, int, int, str]]:
    """The table of neighbouring pieces together: the cheapest way through, then least letters, of each pair of states."""
    current = {(s, t): (cost, letters) for s, t, cost, letters in tables[0]}
    for table in tables[1:]:
        found: dict[tuple[int, int], tuple[int, str]] = {}
        for (s, m), (cost, letters) in current.items():
            for s2, t, cost2, letters2 in table:
                if s2 == m:
                    way = cost + cost2, letters + letters2
                    if (s, t) not in found or way < found[s, t]:
                        found[s, t] = way
        current = found
    return [(s, t, *way) for (s, t), way in sorted(current.items())]


_TABLE = "array<struct<s: int, t: int, cost: long, letters: string>>"
_PIECE = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))


def _solved(pieces: DataFrame) -> DataFrame:
    """(``key``, ``piece``, ``ways``, ``first``, ``last``, ``illegal``) of each piece of at most 2^PIECE_BITS rows."""

    def run(batches):
        for batch in batches:
            whole, rows = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ways, first, last, illegal = [], [], [], []
            for alone, found in zip(whole, rows, strict=True):
                lattice = [(r["initial"], r["fault"]) for r in found]
                ways.append([dict(zip("st", w[:2], strict=True), cost=w[2], letters=w[3]) for w in piece_table(lattice, alone)])
                first.append(lattice[0][0])
                last.append(lattice[-1][0])
                illegal.append(sum(a[0] + b[0] not in LEGAL for a, b in zip(lattice, lattice[1:], strict=False)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ways, _PIECE), pa.array(first, pa.string()),
                 pa.array(last, pa.string()), pa.array(illegal, pa.int64())],
                ["key", "piece", "ways", "first", "last", "illegal"],
            )

    fields = f"key string, piece long, ways {_TABLE}, first string, last string, illegal long"
    return pieces.select("key", "piece", "whole", "rows").mapInArrow(run, fields)


def _bundled(pieces: DataFrame) -> DataFrame:
    """Up to 2^PIECE_BITS neighbouring pieces of a conversation made one."""
    columns = ["piece", "ways", "first", "last", "illegal"]
    groups = pieces.groupBy("key", F.shiftright("piece", PIECE_BITS).alias("bundle")).agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("parts")
    )

    def run(batches):
        for batch in batches:
            ways, first, last, illegal = [], [], [], []
            for parts in batch.column(2).to_pylist():
                tables = [[(w["s"], w["t"], w["cost"], w["letters"]) for w in p["ways"]] for p in parts]
                ways.append([dict(zip("st", w[:2], strict=True), cost=w[2], letters=w[3]) for w in joined_tables(tables)])
                first.append(parts[0]["first"])
                last.append(parts[-1]["last"])
                seams = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
                illegal.append(seams + sum(p["illegal"] for p in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ways, _PIECE), pa.array(first, pa.string()),
                 pa.array(last, pa.string()), pa.array(illegal, pa.int64())],
                ["key", *columns],
            )

    fields = f"key string, piece long, ways {_TABLE}, first string, last string, illegal long"
    return groups.mapInArrow(run, fields)


def _key(conv: Column) -> Column:
    """A text for each conversation, also for the one without an id."""
    return F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv.cast("string")))


def _sha() -> Column:
    """Of role and text together; no two different pairs are hashed as one."""
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)


_MARKS = r"[^\x20\x09-\x0D]"


def _marked(rows: DataFrame) -> DataFrame:
    """(``key``, ``turn``, ``sha``, ``id``, ``initial``, ``fault``) of each row, without its text.

    Texts and roles are compared by SHA-256.  The first row of a role and text
    is found by a minimum, which is combined before the shuffle.  ``id`` tells
    equal rows apart.
    """
    ends = F.regexp_extract("text", rf"(?s)({_MARKS})[\x20\x09-\x0D]*\z", 1)
    hashed = materialize(
        rows.select(
            "key", "turn", _sha().alias("sha"),
            F.monotonically_increasing_id().alias("id"), F.substring("role", 1, 1).alias("initial"),
            F.when(ends == "", BLANK).when(~ends.isin(".", "!", "?"), CUT).otherwise(0).alias("fault"),
        ),
        "turns",
    )
    first = hashed.groupBy("key", "sha").agg(F.min(F.struct("turn", "id")).alias("first"))
    again = F.col("id") != F.col("first.id")
    return hashed.join(first, ["key", "sha"]).withColumn(
        "fault", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault"))
    ).drop("first")


def audits(marked: DataFrame) -> DataFrame:
    """(``key``, ``cost``, ``audit``, ``illegal``) of each conversation.

    Rows are sorted by ranges, so a long conversation lies on many tasks.  Its
    pieces of at most 2^PIECE_BITS rows are solved from each state to each, then
    bundles of as many pieces are joined, until each conversation is one.
    """
    order = ["key", "turn", "sha", "id"]
    placed = materialize(
        marked.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("key", "initial", "fault", F.monotonically_increasing_id().alias("place")),
        "placed",
    )
    pieces = placed.groupBy("key", F.shiftright("place", PIECE_BITS).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("place", "initial", "fault"))).alias("rows")
    )
    single = placed.groupBy("key").agg(
        (F.shiftright(F.min("place"), PIECE_BITS) == F.shiftright(F.max("place"), PIECE_BITS)).alias("whole")
    )
    solved = materialize(_solved(pieces.join(single, "key")), "pieces")
    rest = solved.join(single.where("not whole"), "key", "left_semi")
    done = solved.join(single.where("whole"), "key", "left_semi")
    while not rest.isEmpty():
        rest = materialize(_bundled(rest), "pieces")
        several = rest.groupBy("key").count().where("count > 1").select("key")
        done = done.unionByName(rest.join(several, "key", "left_anti"))
        rest = rest.join(several, "key", "left_semi")
    ends = F.filter("ways", lambda w: (w["s"] == BEGIN) & w["t"].isin(*ENDS))
    best = F.array_min(F.transform(ends, lambda w: F.struct(w["cost"], w["letters"])))
    return done.select("key", best.alias("best"), "illegal").select(
        "key", "best.cost", F.col("best.letters").alias("audit"), "illegal"
    )


def _walk(rows: DataFrame, found: DataFrame, digest: bool) -> DataFrame:
    """The repaired rows of each conversation in order, or the SHA-256 of their ``role:text`` lines.

    A conversation's letters come first, then its rows in order, as one sorted
    stream; memory holds the letters of one conversation and a batch of rows.
    """
    stream = found.select(
        "key", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("sha"),
        F.lit("").alias("role"), F.lit("").alias("text"), "audit",
    ).unionByName(
        rows.select(
            "key", F.lit(1).alias("kind"), "turn", _sha().alias("sha"), "role", "text",
            F.lit(None).cast("string").alias("audit"),
        )
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = stream.repartition(parts, "key").sortWithinPartitions("key", "kind", "turn", "sha")

    class Walker:
        """One conversation: its letters, the place in them, the state, and what was written."""

        def __init__(self, key, audit):
            self.key, self.audit, self.at, self.state, self.n = key, audit, 0, BEGIN, 0
            self.hash = hashlib.sha256()

        def written(self, role, text, letter):
            self.state = NEXT[self.state][role[:1]]
            self.hash.update((("\n" if self.n else "") + f"{role}:{text}").encode())
            self.n += 1
            return self.key, self.n - 1, letter, role, text

        def fitting(self):
            return next(ROLES[r] for r in NEXT[self.state] if r in ROLES)

        def inserted(self):
            while self.audit[self.at : self.at + 1] == "I":
                self.at += 1
                yield self.written(self.fitting(), "", "I")

        def row(self, role, text):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter != "D":
                yield self.written(role if letter == "K" else self.fitting(), text, letter)

    names = ["key", "sha256"] if digest else ["key", "position", "edit", "role", "text"]
    kinds = [pa.string(), pa.string()] if digest else [pa.string(), pa.int64(), *[pa.string()] * 3]

    def batch_of(out):
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def ended(walker):
        if walker is None:
            return []
        rest = list(walker.inserted())
        return [(walker.key, walker.hash.hexdigest())] if digest else rest

    def run(batches):
        walker = None
        for batch in batches:
            out = []
            for key, kind, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    out += ended(walker)
                    walker = Walker(key, audit)
                    continue
                made = list(walker.row(role, text))
                if not digest:
                    out += made
            yield batch_of(out)
        yield batch_of(ended(walker))

    fields = "key string, sha256 string" if digest else "key string, position long, edit string, role string, text string"
    return stream.select("key", "kind", "role", "text", "audit").mapInArrow(run, StructType.fromDDL(fields))


def _parts(conversations: DataFrame, conv_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without nulls but in the turn, keyed; their marks; the audits."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(_key(F.col(conv_col)).alias("key"), F.col(conv_col).alias("conv"), "turn", some("role"), some("text"))
    marked = materialize(_marked(rows), "marked")
    return rows, marked, materialize(audits(marked), "audits")


def repaired_rows(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(``conv_col``, ``position``, ``edit``, ``role``, ``text``): the rows of every repaired conversation, from 0.

    See ``repair`` for what a repair is.  ``edit`` is K, R or I.
    """
    rows, _, found = _parts(conversations, conv_col)
    named = rows.select("key", F.col("conv").alias(conv_col)).distinct()
    return _walk(rows, found, False).join(named, "key").select(conv_col, "position", "edit", "role", "text")


def repair(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of (``conv_col``, turn, role, text) rows: its faults and its cheapest repair.

    Rows follow ``turn`` (nulls first); rows of one turn the SHA-256 of role and
    text; equal rows are alike.  A null role or text is one space; rows without
    conversation are one conversation.  Other columns are left out; an empty
    table gives an empty result.  A row's first fault counts: blank (no
    character but white space), duplicate (role and text seen earlier),
    truncated (its last such character is none of ``.!?``).

    Edits give roles whose initials read ``(s?(ua)+)?``.  Keep costs nothing,
    rerole (to user or assistant) 2, delete 3, insert (an empty user or
    assistant) 2, and a truncated row that stays 1 more; blank and duplicate
    rows are deleted.  Of the cheapest, the one whose initials (K, R, D, I in
    order) come first in ASCII is ``audit``.

    Columns: ``gaps`` (missing turns between least and largest, 0 without
    turns), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbouring
    rows whose initials are not su, ua or au), ``cost``, ``audit``,
    ``repaired_sha256`` (of the repaired ``role:text`` lines).
    """
    rows, marked, found = _parts(conversations, conv_col)
    turns = rows.groupBy("key", "turn").agg(F.first("conv").alias("conv"))
    spans = turns.groupBy("key").agg(
        F.first("conv").alias(conv_col),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    faults = marked.groupBy("key").agg(
        *[F.count_if(F.col("fault") == k).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))]
    )
    texts = _walk(rows, found, True).withColumnRenamed("sha256", "repaired_sha256")
    return spans.join(faults, "key").join(found, "key").join(texts, "key").select(
        conv_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
