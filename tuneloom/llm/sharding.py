"""Shards of near equal bytes by histogram sort.

Rows are ordered by a 62-bit key: 40 bits of a text hash, then 22 bits of an id hash, so that equal texts
stand together and even a huge group of them can be cut. Splitters between shards are found by counting
exact bytes between candidate boundaries, ever finer ones around each target, until every splitter is
within the tolerance (or no finer boundary exists); boundaries between texts come first. Then the rows
are exchanged once, in the order of shard and key.

Defined results: a null text has no bytes but is still a row; rows that agree in text and id share a key
and a shard; with fewer rows than shards some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tuneloom.llm.common import stored

TEXT_BITS, ID_BITS, FAN_BITS = 40, 22, 10


def shard_key(text: Column, doc_id: Column) -> Column:
    of_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - TEXT_BITS)
    return F.shiftleft(of_text, ID_BITS) + F.shiftrightunsigned(F.xxhash64(doc_id), 64 - ID_BITS)


def find_splitters(rows: DataFrame, shards: int, tolerance: float, key: str = "key", size: str = "size") -> list[int]:
    """The ``shards - 1`` smallest keys of shards 1, 2, ...; at most ``shards * 1024`` counts reach the driver a pass.

    ``tolerance`` is the accepted error of a splitter in shares of a shard.
    """
    bits = TEXT_BITS + ID_BITS
    total = rows.agg(F.sum(size)).first()[0] or 0
    allowed = tolerance * total / shards
    # Per open splitter: its target in bytes, the prefix it lies in, the bytes before that, the best boundary so far.
    open_ones = {k: (total * k / shards, 0, 0, (float("inf"), 0)) for k in range(1, shards)}
    found: dict[int, int] = {}
    while open_ones:
        above, bits = bits, max(0, bits - FAN_BITS)
        prefixes = sorted({lo for _, lo, _, _ in open_ones.values()})
        inside = rows.filter(F.shiftright(key, above).isin(prefixes)) if above < TEXT_BITS + ID_BITS else rows
        counts = inside.groupBy(F.shiftright(key, bits).alias("child")).agg(F.sum(size).alias("bytes")).collect()
        children = sorted((row["child"], row["bytes"]) for row in counts)
        still = {}
        for k, (target, prefix, before, best) in open_ones.items():
            at = before
            deeper = (prefix << (above - bits), before)
            for child, size_of in children:
                if child >> (above - bits) != prefix:
                    continue
                best = min(best, (abs(at - target), child << bits), (abs(at + size_of - target), (child + 1) << bits))
                if at <= target:
                    deeper = (child, at)
                at += size_of
            if best[0] <= allowed or bits == 0:
                found[k] = best[1]
            else:
                still[k] = (target, *deeper, best)
        open_ones = still
    return [found[k] for k in range(1, shards)]


def shard_of(key: Column, splitters: list[int]) -> Column:
    shard = F.lit(0)
    for splitter in splitters:
        shard = shard + (key >= F.lit(splitter)).cast("int")
    return shard


def with_slots(rows: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("key", "doc_id")) -> DataFrame:
    """Adds ``slot``: the place of a row in its shard, counted from 0 without gaps.

    The one exchange: rows are range-partitioned by shard and key, numbered inside their partition, and
    the numbers shifted by what earlier partitions hold of the shard.
    """
    ordered = rows.repartitionByRange(shard, *order).sortWithinPartitions(shard, *order)
    placed = stored(ordered.withColumn("__row", F.monotonically_increasing_id()), "shard-rows")
    placed = placed.withColumn("__part", F.shiftrightunsigned("__row", 33))
    parts = placed.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    earlier = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    # One row per shard and shuffle partition at most (a partition holds few shards).
    joined = placed.join(F.broadcast(parts), [shard, "__part"])
    slot = F.col("__before") + F.col("__row") - F.col("__first")
    return joined.withColumn("slot", slot.cast("long")).drop("__row", "__part", "__n", "__first", "__before")


def histogram_shards(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.005, overhead: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, key, shard, slot`` of every row; sizes count UTF-8 bytes plus ``overhead``."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        shard_key(F.col(text), F.col(doc_id)).alias("key"),
    )
    narrow = stored(narrow, "shard-sizes")
    splitters = find_splitters(narrow, shards, tolerance)
    return with_slots(narrow.withColumn("shard", shard_of(F.col("key"), splitters).cast("int")))


def sharded_rows(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.005) -> DataFrame:
    """``docs`` with a column ``shard``, exchanged once so that files written from it hold one stretch of one shard."""
    sized = docs.select((F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).alias("size"), shard_key(F.col(text), F.col(doc_id)).alias("key"))
    splitters = find_splitters(stored(sized, "shard-sizes"), shards, tolerance)
    keyed = docs.withColumn("__key", shard_key(F.col(text), F.col(doc_id))).withColumn("shard", shard_of(F.col("__key"), splitters).cast("int"))
    return keyed.repartitionByRange("shard", "__key").sortWithinPartitions("shard", "__key").drop("__key")
