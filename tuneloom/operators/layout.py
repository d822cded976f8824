"""Training-set layout: seeded shuffle, dense positions, micro-batches and steps.

Epochs are shuffled by sorting hashes (``step_schedule``), or by a formula that permutes the numbers of the rows
(``permuted_schedule``): there any number of epochs costs the one shuffle that numbers the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

# Buckets of the shuffle are leading hex digits of the row's hash, as many as leave about this many rows in one.
ROWS_PER_BUCKET = 50_000
# The bucket table is broadcast up to this many rows; a schedule of more epochs joins it.
MAX_BROADCAST_BUCKETS = 1_000_000


def shuffle_hash(seed: Column, key: str) -> Column:
    """Null keys have a hash like any other."""
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit("\0null"))))


def _digits(rows: int) -> int:
    return max(1, math.ceil(math.log(max(1, rows / ROWS_PER_BUCKET), 16)))


def _positions(
    df: DataFrame,
    key: str,
    by: Sequence[str],
    digits: int,
    limit: Column | None = None,
    groups: int = 1,
) -> DataFrame:
    """Dense positions from 0 in (hash, key) order within ``by``, without a global window.

    The hash spreads rows evenly over 16**digits buckets. Counts per bucket give each
    bucket its first position, which is broadcast (16**digits rows for each of the
    ``groups`` values of ``by``); rows are then numbered inside their bucket. ``limit``
    drops buckets that start beyond it before the rows are shuffled.
    """
    bucketed = df.withColumn("__bucket", F.substring("__hash", 1, digits))
    order = Window.partitionBy(*by).orderBy("__bucket")
    starts = (
        bucketed.groupBy(*by, "__bucket")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(
            *by,
            "__bucket",
            (F.sum("__rows").over(order) - F.col("__rows")).alias("__start"),
        )
    )
    if limit is not None:
        starts = starts.where(F.col("__start") < limit)
    if groups * 16**digits <= MAX_BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__hash", key)) - 1
    return (
        bucketed.join(starts, [*by, "__bucket"])
        .withColumn("pos", F.col("__start") + inside)
        .drop("__bucket", "__start")
    )


def batch_plan(
    df: DataFrame,
    key: str,
    seed: int = 42,
    batch_size: int = 2,
    accumulation: int = 4,
    digits: int | None = None,
) -> DataFrame:
    """Add ``pos``, ``micro_batch`` and ``step`` of one reproducibly shuffled epoch.

    ``key`` identifies a row. Pass a narrow table: the columns of ``df`` are shuffled.
    """
    _check(batch_size, accumulation, digits)
    placed = _positions(df.withColumn("__hash", shuffle_hash(F.lit(seed), key)), key, [], digits or _digits(df.count()))
    return placed.select(
        *df.columns,
        "pos",
        F.floor(F.col("pos") / batch_size).cast("bigint").alias("micro_batch"),
        F.floor(F.col("pos") / (batch_size * accumulation)).cast("bigint").alias("step"),
    )


def step_schedule(
    df: DataFrame,
    key: str,
    seed: int = 42,
    epochs: float = 1.0,
    batch_size: int = 2,
    accumulation: int = 4,
    max_steps: int = -1,
    digits: int | None = None,
) -> DataFrame:
    """Rows repeated per epoch (reshuffled with seed + epoch) up to the last training step.

    An epoch has ceil(rows / (batch_size * accumulation)) steps. Training has ``max_steps`` steps if
    that is positive, over as many epochs as they take; else ceil(epochs * steps of an epoch).
    """
    _check(batch_size, accumulation, digits)
    per_step, rows = batch_size * accumulation, df.count()
    steps_per_epoch, last_step, passes = _extent(rows, per_step, epochs, max_steps)
    repeated = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "__hash", shuffle_hash(F.lit(seed) + F.col("epoch"), key)
    )
    room = (F.lit(last_step) - F.col("epoch") * steps_per_epoch) * per_step
    placed = _positions(repeated, key, ["epoch"], digits or _digits(rows), limit=room, groups=passes)
    return _steps(placed, df.columns, steps_per_epoch, last_step, batch_size, per_step)


def permuted(number: Column, rows: int, seed: Column) -> Column:
    """Where ``number``, one of 0 to ``rows`` - 1, stands in a shuffled order: a bijection, another one for each ``seed``.

    The number is a cell of a grid just large enough. Four rounds move it along its row or its column by a hash of the
    other coordinate, which maps the grid onto itself. A number that lands in one of the few cells beyond ``rows``
    moves again until it is inside; it meets each of those cells once at most, so the walk ends.
    """
    height = max(1, math.isqrt(max(0, rows - 1)) + 1)
    width = max(1, -(-rows // height))
    spare = height * width - rows

    def shift(coordinate: Column, turn: int) -> Column:
        text = F.concat_ws(":", seed.cast("string"), F.lit(str(turn)), coordinate.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")

    def moved(cell: Column) -> Column:
        y, x = F.floor(cell / width).cast("bigint"), cell % width
        for turn in (0, 2):
            y = (y + shift(x, turn)) % height
            x = (x + shift(y, turn + 1)) % width
        return y * width + x

    once = moved(number.cast("bigint"))
    if not spare:
        return once
    walk = F.sequence(F.lit(1), F.lit(spare))
    inside = F.aggregate(walk, once, lambda cell, _: F.when(cell >= rows, moved(cell)).otherwise(cell))
    return F.when(once >= rows, inside).otherwise(once)


def permuted_schedule(
    df: DataFrame,
    key: str,
    seed: int = 42,
    epochs: float = 1.0,
    batch_size: int = 2,
    accumulation: int = 4,
    max_steps: int = -1,
    digits: int | None = None,
) -> DataFrame:
    """As ``step_schedule``, with each epoch's order a formula of the row's number.

    Rows are numbered once, by hash buckets; an epoch adds no shuffle and no sort. Rows that agree in ``key`` have
    numbers of their own; a null key is a key; an empty table gives an empty schedule.
    """
    _check(batch_size, accumulation, digits)
    per_step, rows = batch_size * accumulation, df.count()
    steps_per_epoch, last_step, passes = _extent(rows, per_step, epochs, max_steps)
    numbered = _positions(df.withColumn("__hash", shuffle_hash(F.lit(seed), key)), key, [], digits or _digits(rows))
    repeated = numbered.withColumnRenamed("pos", "__number").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    placed = repeated.withColumn("pos", permuted(F.col("__number"), rows, F.lit(seed) + F.col("epoch")))
    return _steps(placed, df.columns, steps_per_epoch, last_step, batch_size, per_step)


def _extent(rows: int, per_step: int, epochs: float, max_steps: int) -> tuple[int, int, int]:
    """Steps of an epoch, steps of the training, and the epochs it begins."""
    if epochs <= 0:
        raise ValueError("epochs must be positive")
    steps_per_epoch = math.ceil(rows / per_step)
    last_step = max_steps if max_steps > 0 else math.ceil(epochs * steps_per_epoch)
    return steps_per_epoch, last_step, max(1, math.ceil(last_step / max(1, steps_per_epoch)))


def _steps(placed: DataFrame, columns: Sequence[str], steps_per_epoch: int, last_step: int, batch_size: int, per_step: int) -> DataFrame:
    step = F.col("epoch") * steps_per_epoch + F.floor(F.col("pos") / per_step)
    return (
        placed.withColumn("step", step.cast("bigint"))
        .where(F.col("step") < last_step)
        .select(*columns, "epoch", "pos", F.floor(F.col("pos") / batch_size).cast("bigint").alias("micro_batch"), "step")
    )


def _check(batch_size: int, accumulation: int, digits: int | None) -> None:
    if batch_size < 1 or accumulation < 1:
        raise ValueError("batch_size and accumulation must be at least 1")
    if digits is not None and not 1 <= digits <= 32:
        raise ValueError("digits is between 1 and 32")
