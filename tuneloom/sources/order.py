"""Positions in a table that has an explicit order key.

Spark tables have no row order, so every positional read names a key without nulls. Rows that
share a key have no order among them: a slice that would part them is refused, at any size of the
table; other repeated keys do no harm. A position is turned into the key found there, and the table is then read with
an ordinary range filter on the key, which reaches the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T, Window

from tuneloom.session import durable

# Key ranges are narrowed by this factor per pass over the key column.
FAN_OUT = 1024
# Ranges with at most this many keys are sorted to find the exact one.
SORTED_KEYS = 10_000
# Size of the quantile sketch, exact for as many keys; beyond, ranks are off by 0.07 % in 99 of 100 cases, and three times that is allowed.
SKETCH_SIZE = 4096
SKETCH_SLACK = 0.0022

_COUNTABLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _as_number(key: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.unix_date(key).cast("bigint")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(key.cast("timestamp"))
    return key.cast("bigint")


def _as_key(number: int, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.lit(number).cast("int"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.lit(number).cast("bigint")).cast(dtype)
    return F.lit(number).cast(dtype)


def key_bounds(df: DataFrame, key: str, positions: Sequence[int] = ()) -> Row:
    """Smallest key, largest key and number of rows; fails on null keys.

    ``brackets`` are two keys for each position, between which the key there nearly always lies: from a
    quantile sketch that is made in the same pass.
    """
    number = _as_number(F.col(key), df.schema[key].dataType)
    found = df.agg(
        F.min(number).alias("low"), F.max(number).alias("high"),
        F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys"), F.kll_sketch_agg_bigint(number, SKETCH_SIZE).alias("sketch"),
    ).head()
    if found["rows"] != found["keys"]:
        raise ValueError(f"Order key {key!r} has null values")
    inside = [p for p in positions if p < found["rows"]]
    ranks = [min(1.0, max(0.0, p / found["rows"] + slack)) for p in inside for slack in (-SKETCH_SLACK, SKETCH_SLACK)]
    brackets = []
    if ranks:
        # The sketch, some 100 KB whatever the table, is asked on the driver: no job runs.
        asked = F.kll_sketch_get_quantile_bigint(F.lit(bytes(found["sketch"])), F.array(*map(F.lit, ranks)))
        brackets = df.sparkSession.sql("select 1").select(asked.alias("keys")).head()["keys"]
    return Row(low=found["low"], high=found["high"], rows=found["rows"], brackets=list(zip(brackets[::2], brackets[1::2])))


def _cell(low: int, high: int) -> Column:
    """Which of ``FAN_OUT`` equal parts of [low, high] a key ``k`` lies in; -1 below and ``FAN_OUT`` above."""
    width = -(-(high - low + 1) // FAN_OUT)
    k = F.col("k")
    return F.when(k < low, -1).when(k > high, FAN_OUT).otherwise(F.expr(f"cast((k - {low}L) div {width}L as int)"))


def _bracketed(numbers: DataFrame, positions: Sequence[int], brackets: Sequence[tuple[int, int]]) -> list[tuple[int, int, Row]]:
    """Per position the part of its bracket that holds it, with the number of rows before that part: one pass for all.

    At most ``FAN_OUT`` counts for each position reach the driver: the parts of two brackets overlap like intervals.
    """
    cells = [_cell(*bracket).alias(f"c{i}") for i, bracket in enumerate(brackets)]
    counts = numbers.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()
    found = []
    for i, position in enumerate(positions):
        parts: dict[int, list[Row]] = {}
        for row in counts:
            parts.setdefault(row[f"c{i}"], []).append(row)
        before = 0
        for cell in sorted(parts):
            size = sum(row["n"] for row in parts[cell])
            if position < before + size:
                low, high = min(row["low"] for row in parts[cell]), max(row["high"] for row in parts[cell])
                found.append((before, cell, Row(low=low, high=high, rows=size)))
                break
            before += size
    return found


def _edges(df: DataFrame, key: str, positions: Sequence[int], bounds: Row) -> list[Column]:
    """The key that begins at each position; fails if rows before it share it.

    Two passes over the key column: the sketch's, and one that counts the keys in its brackets exactly. Only where a part of a
    bracket still holds several keys (some 10^9 rows of dense keys) is that part narrowed further.
    """
    dtype = df.schema[key].dataType
    numbers = df.select(_as_number(F.col(key), dtype).alias("k"))
    brackets = bounds["brackets"]
    narrow = all(high - low < 2**62 for low, high in brackets)
    parts = _bracketed(numbers, positions, brackets) if narrow else [(0, -1, bounds)] * len(positions)
    out = []
    for position, (before, cell, part) in zip(positions, parts):
        number = part["low"]
        if part["low"] < part["high"]:
            # Outside its bracket the sketch was wrong, which is no more than a further pass.
            inside = numbers if cell < 0 or cell == FAN_OUT else numbers.where(F.col("k").between(part["low"], part["high"]))
            start, whole = (0, bounds) if inside is numbers else (before, part)
            number = _key_at(inside, position - start, whole)
            before = numbers.where(F.col("k") < number).count()
        if before != position:
            raise ValueError(f"Order key {key!r} is not unique where position {position} begins")
        out.append(_as_key(number, dtype))
    return out


def key_at(df: DataFrame, key: str, position: int, bounds: Row) -> int:
    """The key (as a number) at a 0-based position of the ascending key order."""
    return _key_at(df.select(_as_number(F.col(key), df.schema[key].dataType).alias("k")), position, bounds)


def _key_at(numbers: DataFrame, position: int, bounds: Row) -> int:
    """The same for a column ``k``.

    Each pass reads the key column only and counts keys in equal parts of the range that
    holds the position, until few enough are left to sort. At most ``FAN_OUT`` counts
    reach the driver per pass.
    """
    low, high, size = bounds["low"], bounds["high"], bounds["rows"]
    while size > SORTED_KEYS and low < high:
        width = -(-(high - low + 1) // FAN_OUT)
        # A range close to that of 64-bit numbers is cut by its leading bits instead.
        part = F.expr(f"(k - {low}L) div {width}L") if high - low < 2**62 else F.shiftright("k", 54)
        counts = (
            numbers.where(F.col("k").between(low, high))
            .groupBy(part.alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
            .orderBy("low")
            .collect()
        )
        for row in counts:
            if position < row["n"]:
                low, high, size = row["low"], row["high"], row["n"]
                break
            position -= row["n"]
    if low == high:
        return low
    return (
        numbers.where(F.col("k").between(low, high)).orderBy("k").offset(position).limit(1).head()["k"]
    )


def positional_slice(
    df: DataFrame, key: str | Sequence[str], start: int = 0, stop: int | None = None
) -> DataFrame:
    """Rows at positions [start, stop) of the ascending key order."""
    keys = [key] if isinstance(key, str) else list(key)
    if start < 0 or (stop is not None and stop < start):
        raise ValueError(f"Not a slice: [{start}:{stop}]")
    if start == 0 and stop is None:
        return df
    if stop is not None and stop == start:
        return df.limit(0)
    if len(keys) > 1 or not isinstance(df.schema[keys[0]].dataType, _COUNTABLE):
        return _slice_by_positions(df, keys, start, stop)
    (name,) = keys
    wanted = [p for p in (start, stop) if p]
    bounds = key_bounds(df, name, wanted)
    if start >= bounds["rows"]:
        return df.limit(0)
    wanted = [p for p in wanted if p < bounds["rows"]]
    edges = dict(zip(wanted, _edges(df, name, wanted, bounds))) if wanted else {}
    out = df.where(F.col(name) >= edges[start]) if start else df
    return out.where(F.col(name) < edges[stop]) if stop in edges else out


def key_positions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with their 0-based position ``pos``, for keys of any sortable type.

    The keys alone are range-partitioned and sorted once and written to the checkpoint
    folder, so that counting the parts and numbering the rows see the same parts.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = durable(
        df.select(*keys)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*keys, F.spark_partition_id().alias("__part"), local.alias("__local"))
    )
    # One row per range partition: bounded by spark.sql.shuffle.partitions.
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part",
        (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"),
    )
    return parts.join(F.broadcast(starts), "__part").select(
        *keys, (F.col("__start") + F.col("__local")).alias("pos")
    )


def _slice_by_positions(df: DataFrame, keys: list[str], start: int, stop: int | None) -> DataFrame:
    inside = F.col("pos") >= start
    if stop is not None:
        inside = inside & (F.col("pos") < stop)
    placed = key_positions(df, keys)
    if not placed.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
        raise ValueError(f"Order key {keys} has null values")
    edges = (
        placed.where(inside)
        .agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"), F.count(F.lit(1)).alias("rows"))
        .head()
    )
    if edges["first"] is None:
        return df.limit(0)
    row = F.struct(*keys)

    def bound(edge: Row) -> Column:
        return F.struct(
            *(F.lit(edge[k]).cast(df.schema[k].dataType).alias(k) for k in keys)
        )

    # The plain filter on the first key is what the scan can use; the struct one is exact.
    lead = df.schema[keys[0]].dataType
    wanted = (
        F.col(keys[0]).between(F.lit(edges["first"][0]).cast(lead), F.lit(edges["last"][0]).cast(lead))
        & (row >= bound(edges["first"]))
        & (row <= bound(edges["last"]))
    )
    if placed.where(wanted).count() != edges["rows"]:
        raise ValueError(f"Order key {keys} is not unique where the slice begins or ends")
    return df.where(wanted)
