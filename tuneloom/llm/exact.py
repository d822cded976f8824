"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first pass over the texts keeps a length and the hash of a short prefix per row. Rows alone in their
length, then in their length and prefix, are settled. What survives is marked in a bitmap of fixed size
(the only thing broadcast); the second pass reads full content, and hashes it, only for rows whose mark
is set. A row marked by accident is hashed needlessly and settled by its full hash.

Defined results: null counts as the empty text; of equal texts the row with the smallest id stays, null
ids last; of rows that agree in text and id one stays; an empty table gives an empty result; further
columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tuneloom.llm.common import squeeze, stored

PREFIX_CHARS = 256
BITMAP_BITS = 1 << 22  # 65,536 words of 64 bits


def normal_text(text: Column) -> Column:
    return squeeze(F.coalesce(text, F.lit("")))


def _first_keys(text: Column) -> Column:
    return F.struct(F.octet_length(text).alias("length"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"))


def _slot(keys: Column) -> Column:
    return F.pmod(F.xxhash64(keys["length"], keys["prefix"]), F.lit(BITMAP_BITS))


def survivors(docs: DataFrame, text: Column) -> DataFrame:
    """Lengths and prefix hashes that several rows share."""
    narrow = stored(docs.select(_first_keys(text).alias("k")).select("k.*"), "dedup-keys")
    # Rows that agree in both are one row from here on: a group of copies weighs no more than its count.
    keys = narrow.groupBy("length", "prefix").count()
    lengths = keys.groupBy("length").agg(F.sum("count").alias("rows")).filter("rows > 1").select("length")
    return keys.join(lengths, "length", "left_semi").filter("count > 1").drop("count")


def _bitmap(keys: DataFrame) -> DataFrame:
    slot = _slot(F.struct("length", "prefix"))
    slots = keys.select(slot.alias("s"))
    return slots.groupBy(F.expr("s div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("__bits"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, or those of ``keep``), ``keep_id, group_size, kept``.

    ``extra`` adds columns computed while the text is at hand, so that the text itself need not be kept.
    """
    body = normal_text(F.col(text))
    bitmap = stored(_bitmap(survivors(docs, body)), "dedup-bitmap")
    columns = [F.col(c) for c in (keep if keep is not None else docs.columns)]
    rows = docs.select(
        F.struct(*columns, *[c.alias(n) for n, c in (extra or {}).items()]).alias("row"),
        F.col(doc_id).alias("id"),
        body.alias("body"),
    )
    rows = rows.select("*", _slot(_first_keys(F.col("body"))).alias("__slot")).withColumn("__at", F.expr("__slot div 64"))
    # At most 65,536 rows of two longs, whatever the input.
    rows = rows.join(F.broadcast(bitmap), F.col("__at") == F.col("__word"), "left")
    marked = F.coalesce(F.expr("(shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1L) = 1L"), F.lit(False))
    rows = rows.select("row", "id", F.when(marked, F.sha2(F.col("body"), 256)).alias("full"))
    groups = stored(_groups(rows), "dedup-groups")
    # Rows settled before the full hash look for a group that isn't there, each under a key of its own.
    alone = F.concat(F.lit("-"), F.xxhash64("id").cast("string"))
    joined = rows.withColumn("__key", F.coalesce("full", alone)).join(groups.withColumnRenamed("full", "__key"), "__key", "left")
    first = F.col("__size").isNull() | F.col("id").eqNullSafe(F.col("__keep"))
    out = joined.select("row", "id", "__key", "__ties", F.when(F.col("__size").isNull(), F.col("id")).otherwise(F.col("__keep")).alias("keep_id"),
                        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), first.alias("kept"))
    if not groups.filter("__ties > 1").isEmpty():
        out = _one_of_ties(out)
    return out.select("row", "keep_id", "group_size", "kept")


def _groups(rows: DataFrame) -> DataFrame:
    """Full hashes of several rows: smallest id, rows, and rows with that id."""
    by_id = rows.filter("full is not null").groupBy("full", "id").agg(F.count(F.lit(1)).alias("n"))
    grouped = by_id.groupBy("full").agg(
        F.min("id").alias("__keep"), F.sum("n").alias("__size"),
        F.coalesce(F.min_by("n", F.col("id")), F.max("n")).alias("__ties"),
    )
    return grouped.filter("__size > 1")


def _one_of_ties(out: DataFrame) -> DataFrame:
    """Where rows agree in text and smallest id, the first stays; only those rows are ordered."""
    tied = F.col("kept") & (F.coalesce("__ties", F.lit(1)) > 1)
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("id"))
    return out.filter(~tied).unionByName(out.filter(tied).withColumn("kept", nth == 1))


def kept_rows(docs: DataFrame, **names: str) -> DataFrame:
    """``docs`` without the copies."""
    return exact_dedup(docs, **names).filter("kept").select("row.*")
