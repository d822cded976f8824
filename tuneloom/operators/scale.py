"""Group-wise building blocks that stay balanced when one group holds most of the rows.

A window over a group puts the whole group into one task. These three operators give the
same results without that: a tree of partial top-n cuts, a lag over bounded stretches of a
group, and a join of rows with their group whose large partitions adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from tuneloom.session import stored

# A partial cut may hand this many rows of one group to the next level.
ROWS_PER_CUT = 1_000_000
# Rows of one group handled by one task of a lag.
LAG_STRETCH = 100_000


def _shards(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cut(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    rank = "__rank"
    return (
        df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col(rank) <= n)
        .drop(rank)
    )


def _precut(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Cut every (group, shard) to n rows, so that a later task sees shards x n of a group.

    The shard is the input partition: a map task cuts each of its groups to n rows before
    the shuffle (``WindowGroupLimit``).
    """
    shard = "__shard"
    fan = _shards(df)
    while fan > 1:
        marked = df.withColumn(shard, F.pmod(F.spark_partition_id(), F.lit(fan)))
        df = _cut(marked, n, order, [*by, shard]).drop(shard)
        fan = 1 if fan * n <= ROWS_PER_CUT else math.isqrt(fan)
    return df


def top_n(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group under a total ``order``, by one path for every ``n``."""
    order, by = list(order), list(by)
    if not by:
        # Each task keeps its first n rows; nothing else is shuffled.
        return df.orderBy(*order).limit(n)
    return _cut(_precut(df, n, order, by), n, order, by)


def previous_row(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: dict[str, str],
    stretch: int = LAG_STRETCH,
) -> DataFrame:
    """Add columns of the preceding row of the same group; ``values`` maps new name -> source.

    ``order`` is a whole number, unique in its group. A group is worked on in stretches of
    that number. Which row a stretch begins after is found on the keys alone and written to
    the shared folder first: where no group has a second stretch, the texts are shuffled once
    and joined with nothing. Null keys are a group of their own. Also adds ``has_previous``.
    """
    by = list(by)
    group, part, carry, had, last = "__group", "__stretch", "__carry", "__had", "__last"
    prev = {name: f"__prev_{name}" for name in values}
    # Structs are equal where their fields are, nulls included.
    cut = df.withColumns({group: F.struct(*by), part: F.expr(f"`{order}` div {int(stretch)}L")})
    window = Window.partitionBy(group, part).orderBy(order)
    # The lag reads the columns themselves: no second copy of a text goes through the shuffle.
    inner = cut.withColumns(
        {
            had: F.lag(F.lit(True)).over(window),
            **{prev[name]: F.lag(source).over(window) for name, source in values.items()},
        }
    )
    inside = F.col(had).isNotNull()
    ends = stored(
        cut.groupBy(group, part)
        .agg(F.max(order).alias(last))
        .withColumn(last, F.lag(last).over(Window.partitionBy(group).orderBy(part)))
        .where(F.col(last).isNotNull()),
        "stretches",
    )
    if ends.isEmpty():
        return inner.select(*df.columns, inside.alias("has_previous"), *(F.col(prev[name]).alias(name) for name in values))
    picked = F.struct(F.lit(True).alias("has_previous"), *(F.col(v).alias(name) for name, v in values.items()))
    source = cut.select(group, F.col(order).alias(last), picked.alias(carry))
    carried = ends.join(source, [group, last]).groupBy(group, part).agg(F.first(carry).alias(carry))
    joined = inner.join(carried, [group, part], "left")
    return joined.select(
        *df.columns,
        (inside | F.col(carry).isNotNull()).alias("has_previous"),
        *(
            F.when(inside, F.col(prev[name])).otherwise(F.col(carry).getField(name)).alias(name)
            for name in values
        ),
    )


def dense_positions(df: DataFrame, by: Sequence[str], order: str, output: str = "pos") -> DataFrame:
    """``by`` and ``order`` of every row with its 0-based place in its group, in the order of ``order``.

    ``order`` is unique in its group. The keys alone are range-partitioned, sorted and written to the shared folder
    once; a place is then a row's number in its part, less where its group begins there, and how many rows
    of the group stand in earlier parts. A large group is as many parts as it needs; no window holds it.
    Null keys are a group of their own.
    """
    group, part, local = "__group", "__part", "__local"
    keys = stored(
        df.select(F.struct(*by).alias(group), F.col(order).alias("__order"))
        .repartitionByRange(group, "__order")
        .sortWithinPartitions(group, "__order")
        .select(group, "__order", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(local)),
        "positions",
    )
    # One row per group and part; in the window, as many rows of a group as it has parts.
    parts = keys.groupBy(group, part).agg(F.min(local).alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(group).orderBy(part)) - F.col("__n")
    placed = keys.join(parts.select(group, part, (earlier - F.col("__first")).alias("__shift")), [group, part])
    return placed.select(f"{group}.*", F.col("__order").alias(order), (F.col(local) + F.col("__shift")).alias(output))


def join_groups(rows: DataFrame, per_group: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row per group back to its member rows (null keys match each other).

    Members of a large group stand in one shuffle partition, which adaptive execution splits
    over several tasks, repeating the group's one row for each.
    """
    rename = {k: f"__group_{k}" for k in on}
    one = per_group.select(*(F.col(f"`{c}`").alias(rename.get(c, c)) for c in per_group.columns))
    match = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(one[rename[k]]) for k in on), F.lit(True))
    return rows.join(one, match, how).drop(*rename.values())
