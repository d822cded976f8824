"""Live bounded history per run.

The history of a run is a fold: its newest points, and where it started last. Each
micro-batch is cut to that on the map side before anything is shuffled, so a run that sends
a third of all events costs no task more than its share, and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tuneloom.operators.scale import top_n
from tuneloom.operators.telemetry import LOG, MAX_POINTS, TRAIN_BEGIN, is_point, point_columns
from tuneloom.streaming.folded import FOLD_EVERY, FoldedTable
from tuneloom.streaming.streams import batch_stream


def _fold(max_points: int):
    def fold(rows: DataFrame) -> DataFrame:
        begins = (
            rows.where(F.col("kind") == TRAIN_BEGIN)
            .groupBy("run_id", "kind")
            .agg(F.max("seq").alias("seq"))
        )
        newest = top_n(rows.where(F.col("kind") == LOG), max_points, [F.desc("seq")], ["run_id"])
        started = begins.select("run_id", F.col("seq").alias("__begin"))
        alive = newest.join(started, "run_id", "left").where(
            F.col("__begin").isNull() | (F.col("seq") > F.col("__begin"))
        )
        return alive.drop("__begin").unionByName(begins, allowMissingColumns=True)

    return fold


def history_table(path: str, max_points: int = MAX_POINTS, fold_every: int = FOLD_EVERY) -> FoldedTable:
    return FoldedTable(path, _fold(max_points), fold_every)


def history_stream(
    events: DataFrame, table: FoldedTable, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Maintain the last points of every run since its latest start, in a ``history_table``."""
    rows = events.where(is_point() | (F.col("kind") == TRAIN_BEGIN)).select(
        "run_id", "kind", "seq", *point_columns(events)
    )
    return batch_stream(rows, table.write, checkpoint, interval)


def current_history(spark: SparkSession, table: FoldedTable) -> DataFrame:
    return table.read(spark).where(F.col("kind") == LOG).drop("kind")


# A row of a run that says when it was last heard of.
SEEN = "__seen"


def expiring_table(path: str, lifetime: float, max_points: int = MAX_POINTS, fold_every: int = FOLD_EVERY) -> FoldedTable:
    """A ``history_table`` that runs leave when nothing was heard of them for ``lifetime`` seconds of event time.

    The clock is the latest time any run was heard of. A fold lets go of a run after twice its lifetime: an event that
    comes late, but by less than a lifetime, still finds what it belongs to.
    """
    newest = _fold(max_points)

    def fold(rows: DataFrame) -> DataFrame:
        seen = rows.groupBy("run_id").agg(F.max("ts").alias("ts")).withColumn("kind", F.lit(SEEN))
        heard = _lately(seen, 2 * lifetime)
        points = newest(rows.where(F.col("kind") != SEEN))
        return points.join(heard.select("run_id"), "run_id", "left_semi").unionByName(heard, allowMissingColumns=True)

    return FoldedTable(path, fold, fold_every)


def _lately(seen: DataFrame, seconds: float) -> DataFrame:
    """The runs heard of within ``seconds`` of the latest one."""
    now = seen.select(F.max(F.unix_micros("ts")).alias("now")).scalar()
    return seen.where(F.unix_micros("ts") >= now - F.lit(int(seconds * 1e6)))


def expiring_stream(events: DataFrame, table: FoldedTable, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Maintain an ``expiring_table``; events carry their time in ``ts``."""
    return history_stream(events, table, checkpoint, interval)


def current_expiring(spark: SparkSession, table: FoldedTable, lifetime: float) -> DataFrame:
    """The histories of runs that were heard of within ``lifetime`` seconds.

    After a silence longer than that a run begins a new history, whether or not it had left the table meanwhile.
    """
    rows = table.read(spark)
    seen = rows.where(F.col("kind") == SEEN)
    alive = _lately(seen, lifetime).select("run_id")
    points = rows.where(F.col("kind") == LOG).join(alive, "run_id", "left_semi")
    # At most the points of one history are in a window.
    run = Window.partitionBy("run_id").orderBy("ts", "seq")
    silence = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(run)
    begins = F.max(F.when(F.col("__silence") > int(lifetime * 1e6), F.col("ts"))).over(Window.partitionBy("run_id"))
    marked = points.withColumn("__silence", silence).withColumn("__from", begins)
    return marked.where(F.col("__from").isNull() | (F.col("ts") >= F.col("__from"))).drop("__silence", "__from", "kind")
