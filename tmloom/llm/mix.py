"""Mixing sources to target weights by highest quotients and seeded blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tmloom.operators.scale import materialize

BLOCK_WORDS = 32
_BINS = 4096  # of the quotients of a group
SHARD_ROWS = 4096
SEED = 42
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
_SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "1")
    return F.length(F.translate(marked, _SPACE, "")).cast("long")


def _seeded(*parts: Column) -> Column:
    """A 32-bit number that depends on the seed and the parts alone."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def highest_quotients(
    df: DataFrame, group: Sequence[str], weight: str, total: str, cap: str, order: Sequence[str]
) -> DataFrame:
    """Add ``seats``: the ``total`` of each group apportioned by Sainte-Laguë.

    A row's k-th seat has the quotient weight / (2k - 1), and the highest
    quotients of a group get its seats, none beyond a row's ``cap``.  Seats lie
    within n * weight / (2 * all weights) + 1 of the rounded share, so only
    quotients in that range are listed: a few for each row.  They are counted in
    ``_BINS`` bins of their group, before the shuffle; the bins above the one in
    which the seats run out win whole, and only that one is put in order.  An
    empty ``group`` takes all rows for one small group.  ``group`` and ``order`` together must tell the rows apart.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranged = (
        df.withColumn("_all", F.sum(weight).over(w))
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_part", F.when(F.col("_all") > 0, F.col(weight) / F.col("_all")).otherwise(0.0))
        .withColumn("_margin", F.ceil(F.col("_n") * F.col("_part") / 2) + 2)
        .withColumn(
            "_sure",
            F.least(
                F.col(cap),
                F.greatest(
                    F.lit(0), F.floor(F.col("_part") * F.col(total) + 0.5) - F.col("_margin")
                ),
            ).cast("long"),
        )
        .withColumn("_open", F.col(total) - F.sum("_sure").over(w))
    )
    last = F.least(F.col("_sure") + 2 * F.col("_margin") + 1, F.col(cap)).cast("long")
    listed = ranged.select(
        *group, *order, weight, "_open",
        F.explode(F.when(last > F.col("_sure"), F.sequence(F.col("_sure") + 1, last))).alias("_k"),
    ).withColumn("_quotient", F.col(weight) / (2 * F.col("_k") - 1))
    by = w.orderBy(F.desc("_quotient"), *order, "_k")
    listed = listed.where("_quotient > 0")
    if group:
        winners = _highest(listed, list(group), by)
    else:  # one small group
        winners = listed.withColumn("_rank", F.row_number().over(by)).where("_rank <= _open")
    won = winners.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_won"))
    return (
        ranged.join(won, [*group, *order], "left")
        .withColumn("seats", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_all", "_n", "_part", "_margin", "_sure", "_open", "_won")
    )


def _highest(listed: DataFrame, group: list[str], by: WindowSpec) -> DataFrame:
    """Of each group the ``_open`` first rows in the order ``by``, which begins with the highest ``_quotient``."""
    listed = materialize(listed, "quotients")
    spans = listed.groupBy(*group).agg(F.min("_quotient").alias("_low"), F.max("_quotient").alias("_high"))
    width = F.col("_high") - F.col("_low")
    place = F.floor((F.col("_quotient") - F.col("_low")) / width * _BINS)
    binned = listed.join(spans, group).withColumn(
        "_bin", F.when(width > 0, F.least(F.lit(_BINS - 1), place)).otherwise(0).cast("int")
    )
    above = Window.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        binned.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_here"))
        .withColumn("_above", F.coalesce(F.sum("_here").over(above), F.lit(0)))
    )
    met = binned.join(counted, [*group, "_bin"]).where("_above < _open")
    last = met.where("_above + _here > _open").withColumn("_rank", F.row_number().over(by))
    return met.where("_above + _here <= _open").unionByName(
        last.where("_above + _rank <= _open").drop("_rank")
    )


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """One row per source with its number, size and target, from (source, size) rows.

    Sources are numbered by code point, null last; their weights repeat.  Each
    target is the smaller of ``most`` times the size and weight times a common
    level, and together they make ``share`` of all sizes.  That level is the
    highest of those found when the sources with the smallest ratio of bound to
    weight are taken as full, which is where repeated resharing ends.  Sources
    are few (one row each passes through one task).
    """
    one = Window.partitionBy(F.lit(0))
    after = one.orderBy("_ratio", "source_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = one.orderBy("_ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
        .withColumn(
            "source_no", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
        )
        .withColumn(
            "_weight",
            F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")),
        )
        .withColumn("_bound", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_bound") / F.col("_weight"))
    )
    return (
        numbered.withColumn("_total", F.sum("source_size").over(one) * share)
        .withColumn(
            "_level",
            (F.col("_total") - F.coalesce(F.sum("_bound").over(before), F.lit(0)))
            / F.sum("_weight").over(after),
        )
        .withColumn("_level", F.max("_level").over(one))
        .withColumn("target", F.least(F.col("_bound").cast("double"), F.col("_weight") * F.col("_level")))
        .select("source", "source_no", "source_size", "source_rows", "target", "_total")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Words taken from each row so that sources meet their targets.

    All targets together are a number of blocks of ``block_words`` words.
    Sainte-Laguë gives each source a whole number of blocks, and each shard of a
    source (some ``shard_rows`` rows, by a seeded hash of the id) its quota of
    them.  In a shard, rows stand in seeded order and their words form one
    stream of blocks; whole passes over the shard are taken first, then a run
    of blocks from a seeded start.  So all but two rows at the ends of the run
    are taken whole.

    Returns ``id_col``, source, ``size``, ``source_size``, ``target``, ``taken``
    and, for the rows' texts, ``copies`` (whole passes) and the word ranges
    [``from_1``, ``to_1``) and [``from_2``, ``to_2``) inside the row that the
    run covers.  Null text has size 0, null sources are one source, null ids
    are one id.  Rows that agree in id, source and size are interchangeable.
    """
    sizes = materialize(
        docs.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    targets = source_targets(sizes).withColumn(
        "_blocks", F.floor(F.col("_total") / block_words + 0.5)
    ).withColumn("_cap", F.lit(2**62))
    quotas = highest_quotients(targets, [], "target", "_blocks", "_cap", ["source_no"])
    quotas = quotas.withColumn("_shards", F.ceil(F.col("source_rows") / shard_rows)).select(
        F.col("source").alias("_source"), "source_no", "source_size", "target", "_shards",
        F.col("seats").alias("_quota"),
    )
    dealt = (
        sizes.join(quotas, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_shard", _seeded(F.lit(seed), F.lit("shard"), F.col("_id")) % F.col("_shards"))
        .drop("_source", "_shards")
    )
    place = ["source_no", "_shard"]
    shards = (
        dealt.groupBy(*place)
        .agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"))
        .withColumn("_blocks", F.ceil(F.col("_words") / block_words))
        .withColumn("_cap", MOST_REPEATS * F.col("_blocks"))
    )
    shards = highest_quotients(shards, ["source_no"], "_words", "_quota", "_cap", ["_shard"])
    some = F.greatest(F.col("_blocks"), F.lit(1))
    shards = shards.select(
        *place, "_blocks",
        F.floor(F.col("seats") / some).alias("copies"),
        (F.col("seats") % some).alias("_rest"),
        (_seeded(F.lit(seed), F.lit("start"), F.col("source_no"), F.col("_shard")) % some).alias("_at"),
    )
    order = Window.partitionBy(*place).orderBy(
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")))),
        "_id", "size",
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = [
        (F.col("_at"), F.least(F.col("_at") + F.col("_rest"), F.col("_blocks"))),
        (F.lit(0), F.col("_at") + F.col("_rest") - F.col("_blocks")),
    ]
    out = dealt.withColumn("_end", F.sum("size").over(order)).join(shards, place)
    start = F.col("_end") - F.col("size")
    for n, (low, high) in enumerate(runs, 1):
        inside = lambda x: F.least(F.greatest(x * block_words - start, F.lit(0)), F.col("size"))
        out = out.withColumn(f"from_{n}", inside(low)).withColumn(
            f"to_{n}", F.greatest(F.col(f"from_{n}"), inside(high))
        )
    taken = F.col("copies") * F.col("size") + sum(F.col(f"to_{n}") - F.col(f"from_{n}") for n in (1, 2))
    return out.withColumn("taken", taken).select(
        F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        "taken", "copies", "from_1", "to_1", "from_2", "to_2",
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: each row as often as it is taken whole,
    and the part of it that is taken once more, its words joined by spaces.

    A row of which nothing is taken is left out.  Ids should be unique; where
    they repeat, the rows of one id are told apart by their order of text.
    """
    rows = docs.select(
        F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"),
        F.struct(*docs.columns).alias("_doc"),
    )
    if not rows.groupBy("_key").count().where("count > 1").isEmpty():
        number = Window.partitionBy("_key").orderBy("_source", "_text")
        nth = F.struct("_key", F.row_number().over(number).alias("nth"))
        rows = materialize(rows.withColumn("_key", nth), "numbered")
    taken = mix(rows, "_key", "_text", "_source", **options)
    ranges = [
        F.struct(F.col(f"from_{n}").alias("a"), F.col(f"to_{n}").alias("b")) for n in (1, 2)
    ]
    whole = F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))
    parts = F.filter(
        F.concat(F.array_repeat(whole, F.col("copies").cast("int")), F.array(*ranges)), lambda x: x["b"] > x["a"]
    )
    plan = taken.select(F.col("_key").alias("_taken"), "size", parts.alias("_parts")).where(F.size("_parts") > 0)
    cut = rows.join(plan, F.col("_key").eqNullSafe(F.col("_taken"))).withColumn("_part", F.explode("_parts"))
    length = F.col("_part.b") - F.col("_part.a")
    words = F.slice(
        F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
        (F.col("_part.a") + 1).cast("int"), length.cast("int"),
    )
    doc = F.col("_doc").withField(text_col, F.array_join(words, " "))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length(F.array_join(words, " ")).cast(docs.schema["n_chars"].dataType))
    return cut.select(F.when(length < F.col("size"), doc).otherwise(F.col("_doc")).alias("_doc")).select("_doc.*")
