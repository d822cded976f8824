"""Streaming forms of formatting, scoring, capture and the latest point of a run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tuneloom.operators.capture import capture_samples
from tuneloom.operators.scale import top_n
from tuneloom.operators.telemetry import LOG, MAX_LOG_LINES, TRAIN_BEGIN, is_point, log_tail, point_columns
from tuneloom.streaming.folded import FOLD_EVERY, FoldedTable

def _trigger(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    """Every ``interval``, or everything there is and then stop."""
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def append_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    file_format: str = "parquet",
    interval: str | None = None,
) -> StreamingQuery:
    """Append the rows of a stateless stream (formatted texts, scores) to a table.

    Started again with the same ``checkpoint``, it goes on where it stopped.
    """
    writer = df.writeStream.outputMode("append").format(file_format).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start(path)


def batch_stream(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
    output_mode: str = "append",
) -> StreamingQuery:
    """Hand every micro-batch to ``write``, which must bear being called again for a batch."""
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(write), interval).start()


def first_streamed(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows a stream delivers, as a batch of at most that many rows."""
    name = f"preview_{uuid.uuid4().hex}"
    writer = df.limit(n).writeStream.outputMode("append").format("memory").queryName(name)
    _trigger(writer, None).start().awaitTermination()
    return df.sparkSession.table(name)


def latest_table(path: str, fold_every: int = FOLD_EVERY) -> FoldedTable:
    """Per run its latest point and, as a row of its own, where it started last."""

    def fold(rows: DataFrame) -> DataFrame:
        return top_n(rows, 1, [F.desc("seq")], ["run_id", "kind"])

    return FoldedTable(path, fold, fold_every)


def latest_stream(
    events: DataFrame, table: FoldedTable, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Maintain the latest point of every run since its latest start, in a ``latest_table``.

    A batch is cut to one row per run and kind; the stream itself keeps no state.
    """
    rows = events.where(is_point() | (F.col("kind") == TRAIN_BEGIN)).select("run_id", "kind", "seq", *point_columns(events))
    return batch_stream(rows, table.write, checkpoint, interval)


def current_latest(spark: SparkSession, table: FoldedTable) -> DataFrame:
    rows = table.read(spark)
    begun = rows.where(F.col("kind") == TRAIN_BEGIN).select("run_id", F.col("seq").alias("__begin"))
    points = rows.where(F.col("kind") == LOG).join(begun, "run_id", "left")
    return points.where(F.col("__begin").isNull() | (F.col("seq") > F.col("__begin"))).drop("__begin", "kind")


def capture_table(path: str, fold_every: int = FOLD_EVERY, **options) -> FoldedTable:
    """First samples of every step and reward, over all batches; ``options`` are those of ``capture_samples``."""
    return FoldedTable(path, lambda rows: capture_samples(rows, **options), fold_every)


def capture_stream(scored: DataFrame, table: FoldedTable, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the first samples of every step and reward, in a ``capture_table``.

    A query of its own beside the scoring sink: if it fails, scores still arrive, and started
    again it goes on with the batch that failed.
    """
    return batch_stream(scored, table.write, checkpoint, interval)


def log_stream(lines: DataFrame, table: FoldedTable, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the last log lines of every run, in a ``log_table``."""
    return batch_stream(lines.select("run_id", "seq", "ts", "line"), table.write, checkpoint, interval)


def log_table(path: str, max_lines: int = MAX_LOG_LINES, fold_every: int = FOLD_EVERY) -> FoldedTable:
    return FoldedTable(path, lambda rows: top_n(rows, max_lines, [F.desc("seq")], ["run_id"]), fold_every)


def current_log(spark: SparkSession, table: FoldedTable, max_lines: int = MAX_LOG_LINES) -> DataFrame:
    """The tail of every run as one text."""
    return log_tail(table.read(spark), max_lines=max_lines)


def curve_table(path: str, by: Sequence[str] = ("run_id", "step", "reward_name"), fold_every: int = FOLD_EVERY) -> FoldedTable:
    """Per point of a curve the sum, number, least and greatest of its values, as far as batches have come."""

    def fold(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*by).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    return FoldedTable(path, fold, fold_every)


def curve_stream(
    scored: DataFrame, table: FoldedTable, checkpoint: str, reward: str = "reward",
    by: Sequence[str] = ("run_id", "step", "reward_name"), interval: str | None = None,
) -> StreamingQuery:
    """Keep the mean reward curve of a stream of scored rows up to date, in a ``curve_table`` of the same ``by``.

    A batch is summed up on the map side; a row is one part of a sum, and null rewards are parts of none.
    """
    value = F.col(reward).cast("double")
    parts = scored.select(
        *by, value.alias("sum"), F.col(reward).isNotNull().cast("bigint").alias("n"), value.alias("low"), value.alias("high")
    )
    return batch_stream(parts, table.write, checkpoint, interval)


def current_curve(spark: SparkSession, table: FoldedTable) -> DataFrame:
    """The curve as of now: ``mean_reward``, ``n_rewards`` and the range of rewards at each point."""
    parts = table.read(spark)
    rest = [c for c in parts.columns if c not in ("sum", "n", "low", "high")]
    return parts.select(*rest, (F.col("sum") / F.col("n")).alias("mean_reward"), F.col("n").alias("n_rewards"), "low", "high")
