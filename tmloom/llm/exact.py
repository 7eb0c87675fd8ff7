"""Exact duplicates by naming blocks, then pairs of names, with integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmloom.operators.scale import materialize

BLOCK_CHARS = 4096
_ROW, _KEY = "_row", ["_k1", "_k2"]


def block_key(block: Column) -> list[Column]:
    """Two independent 64-bit hashes: the address under which a block's name is looked up."""
    return [F.xxhash64(block), F.xxhash64(F.lit(1), block)]


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Distinct rows, sorted inside their shuffle partition and numbered.

    The partition of a row follows from its values, and the order inside is
    total, so a task that runs again gives the same numbers.
    """
    return distinct.sortWithinPartitions(*order).withColumn(
        "_name", F.monotonically_increasing_id()
    )


def name_documents(
    docs: DataFrame, text_col: str, block_chars: int = BLOCK_CHARS, key=block_key
) -> tuple[DataFrame, DataFrame]:
    """Give each row an integer identity that is equal exactly for equal texts.

    Texts are cut into blocks of ``block_chars`` characters.  Distinct blocks
    are sorted and numbered; then adjacent names are paired and the distinct
    pairs numbered, until one name per row is left.  The identity is (level,
    name), level being the number of pairings.  Null counts as the empty text,
    which is one empty block.

    Names are looked up by a 128-bit hash of the block, which spares a second
    shuffle of the text.  Whether two blocks share a hash is checked on the
    names; if any do, the lookup is by the text itself.  So hashes never decide
    equality.

    Returns the rows as (``_row``, all columns of ``docs`` but the text,
    ``text_sha256``) and the identities as (``_row``, ``_level``, ``_name``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    )
    blocks = docs.withColumn("_blocks", cut)
    rest = [c for c in docs.columns if c != text_col]
    keys = F.transform("_blocks", lambda b: F.struct(*[k.alias(c) for k, c in zip(key(b), _KEY, strict=True)]))
    rows = materialize(
        blocks.select(
            F.monotonically_increasing_id().alias(_ROW),
            *rest,
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
            keys.alias("_keys"),
        ),
        "rows",
    )
    each = blocks.select(F.explode("_blocks").alias("_block"))
    each = each.select(*[k.alias(c) for k, c in zip(key(F.col("_block")), _KEY, strict=True)], "_block")
    named = _numbered(each.distinct(), *_KEY, "_block")
    names = materialize(named.select(*_KEY, "_name"), "names")
    if names.groupBy(*_KEY).count().where("count > 1").isEmpty():
        placed = rows.select(_ROW, F.posexplode("_keys").alias("_pos", "_key"))
        placed = placed.select(_ROW, "_pos", F.col("_key._k1"), F.col("_key._k2")).join(names, _KEY)
    else:
        whole = materialize(
            blocks.select(
                F.monotonically_increasing_id().alias(_ROW), *rest,
                F.sha2(text.cast("binary"), 256).alias("text_sha256"), keys.alias("_keys"), "_blocks",
            ),
            "rows",
        )
        rows = whole.drop("_blocks")
        placed = whole.select(_ROW, F.posexplode("_blocks").alias("_pos", "_block")).join(
            named.select("_block", "_name"), "_block"
        )
    placed = placed.select(_ROW, "_pos", "_name")
    rows = rows.withColumn("_n", F.size("_keys")).drop("_keys")
    sizes = rows.select(_ROW, "_n")
    longest = rows.agg(F.max("_n")).first()[0] or 0
    if longest <= 1:
        return rows.drop("_n"), placed.select(_ROW, F.lit(0).alias("_level"), "_name")
    current = materialize(placed.join(sizes, _ROW), "level")
    done, level = [], 0
    while True:
        done.append(current.where("_n = 1").select(_ROW, F.lit(level).alias("_level"), "_name"))
        if longest <= 1:
            break
        pairs = materialize(
            current.where("_n > 1")
            .groupBy(_ROW, "_n", F.expr("_pos div 2").cast("int").alias("_pos"))
            .agg(
                F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_left"),
                F.coalesce(
                    F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name"))), F.lit(-1)
                ).alias("_right"),
            ),
            "pairs",
        )
        names = _numbered(pairs.select("_left", "_right").distinct(), "_left", "_right")
        longest, level = (longest + 1) // 2, level + 1
        current = materialize(
            pairs.join(names, ["_left", "_right"]).select(
                _ROW, "_pos", F.expr("(_n + 1) div 2").cast("int").alias("_n"), "_name"
            ),
            "level",
        )
    identities = done[0]
    for part in done[1:]:
        identities = identities.unionByName(part)
    return rows.drop("_n"), identities


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Every row with its group of equal texts.

    Adds ``keep_id`` (largest id of the group), ``group_size``, ``kept`` (true
    for one row of each group, also where ids repeat or are null; null ids lose
    to all others) and ``text_sha256`` to the columns of ``docs`` without the
    text.  An empty table gives an empty result.  Other columns pass through,
    but for those named like a result.
    """
    made = {"keep_id", "group_size", "kept", "text_sha256", text_col.lower()}
    rest = [c for c in docs.columns if c.lower() not in made]
    packed = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*rest).alias("_doc")
    )
    rows, identities = name_documents(packed, "_text", block_chars)
    groups = materialize(rows.select(_ROW, "_id").join(identities, _ROW), "groups")
    best = materialize(
        groups.groupBy("_level", "_name").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct(F.col("_id").alias("id"), F.col(_ROW).alias("row"))).alias("_best"),
        ),
        "best",
    )
    placed = groups.select(_ROW, "_level", "_name").join(best, ["_level", "_name"])
    return materialize(
        rows.join(placed, _ROW).select(
            "_doc.*", "text_sha256", "group_size", F.col("_best.id").alias("keep_id"),
            (F.col("_best.row") == F.col(_ROW)).alias("kept"),
        ),
        "exact",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id.

    Rows are found again by id and text hash.  Rows equal in both are one group,
    of which one stays.
    """
    groups = exact_groups(docs.select(id_col, text_col), id_col, text_col)
    stay = groups.where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_stay"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("_key"), sha.alias("_sha"), F.struct(*docs.columns).alias("_doc"))
    kept = rows.join(stay, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_stay")), "left_semi")
    if not groups.groupBy(id_col, "text_sha256").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_key", "_sha"])
    return kept.select("_doc.*")
