"""Run telemetry: metric points, bounded histories, curves, log tails, status.

Event tables have ``run_id``, ``seq`` (unique and rising in a run), ``kind`` (one of the
constants below), ``step``, ``logs`` (map of metric name to value) and ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tuneloom.functions.text import lines
from tuneloom.operators.scale import top_n

TRAIN_BEGIN, TRAIN_END, FAILURE, LOG = "train_begin", "train_end", "failure", "log"
MAX_POINTS = 10_000
MAX_LOG_LINES = 500
MAX_TRACE_LINES = 8


def parse_logs(df: DataFrame, column: str, output: str = "logs") -> DataFrame:
    """Read trainer logs kept as JSON text."""
    return df.withColumn(output, F.from_json(column, "map<string,double>"))


def is_point() -> Column:
    """A log event that carries values."""
    return (F.col("kind") == LOG) & (F.coalesce(F.size("logs"), F.lit(0)) > 0)


def point_columns(df: DataFrame) -> list[Column]:
    """Metrics under their usual names; 0.0 is a value, only null falls through."""
    log = F.col("logs")
    epoch = [log["epoch"], *([F.col("epoch")] if "epoch" in df.columns else [])]
    return [
        F.col("step"),
        F.coalesce(log["loss"], log["train_loss"]).alias("loss"),
        log["learning_rate"].alias("learning_rate"),
        log["grad_norm"].alias("grad_norm"),
        F.coalesce(*epoch).alias("epoch"),
        F.coalesce(log["reward"], log["rewards/mean"]).alias("reward"),
        F.col("ts"),
    ]


def metric_points(events: DataFrame) -> DataFrame:
    """One point per non-empty log event."""
    return events.where(is_point()).select("run_id", "seq", *point_columns(events))


def _last_begin(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("kind") == TRAIN_BEGIN)
        .groupBy("run_id")
        .agg(F.max("seq").alias("__begin"))
    )


def metric_history(events: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """The last points of each run since its latest start.

    The newest points are cut out first and those from before the start dropped after:
    the start never removes a point newer than one it keeps, so the order does not matter
    and the join sees at most ``max_points`` rows of a run.
    """
    newest = top_n(metric_points(events), max_points, [F.desc("seq")], ["run_id"])
    return (
        newest.join(_last_begin(events), "run_id", "left")
        .where(F.col("__begin").isNull() | (F.col("seq") > F.col("__begin")))
        .drop("__begin")
    )


def _at_last_point(events: DataFrame) -> list[Column]:
    """Aggregates for ``seq`` and the values of the newest point.

    One ``max_by`` per column: all have a fixed width, so the plan is a hash aggregate,
    where a struct of them would need a sort.
    """
    at = F.when(is_point(), F.col("seq"))
    names = ["step", "loss", "learning_rate", "grad_norm", "epoch", "reward", "ts"]
    values = zip(names, point_columns(events), strict=True)
    return [F.max(at).alias("seq"), *(F.max_by(value, at).alias(name) for name, value in values)]


def latest_state(events: DataFrame) -> DataFrame:
    """Latest point of each run since its latest start, null when there is none.

    One aggregate with a constant-size buffer per run, so it also serves as the stream form.
    """
    latest = events.groupBy("run_id").agg(
        *_at_last_point(events),
        F.max(F.when(F.col("kind") == TRAIN_BEGIN, F.col("seq"))).alias("__begin"),
    )
    alive = F.col("__begin").isNull() | (F.col("seq") > F.col("__begin"))
    kept = [name for name in latest.columns if name not in ("run_id", "__begin")]
    return latest.select("run_id", *(F.when(alive, F.col(name)).alias(name) for name in kept))


def latest_points(events: DataFrame) -> DataFrame:
    """Latest point of each run that has one."""
    return latest_state(events).where(F.col("seq").isNotNull())


def every_steps(df: DataFrame, cadence: int, step: str = "step") -> DataFrame:
    """Rows whose step falls on a logging or saving cadence."""
    if cadence < 1:
        raise ValueError("The cadence must be at least 1")
    return df.where(F.col(step) % cadence == 0)


def loss_curve(points: DataFrame) -> DataFrame:
    return points.where(F.col("loss").isNotNull()).select("run_id", "seq", "step", "loss")


def reward_curve(points: DataFrame) -> DataFrame:
    """Points with a reward; ``metric_points`` has already put ``rewards/mean`` into it."""
    return points.where(F.col("reward").isNotNull()).select("run_id", "seq", "step", "reward")


def log_tail(log_lines: DataFrame, max_lines: int = MAX_LOG_LINES) -> DataFrame:
    """The last lines of each run as one text, each stamped with its time of day."""
    last = top_n(log_lines, max_lines, [F.desc("seq")], ["run_id"])
    stamped = F.concat(
        F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), F.coalesce("line", F.lit(""))
    )
    ordered = F.sort_array(F.collect_list(F.struct("seq", stamped.alias("line"))))
    return last.groupBy("run_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("log_text")
    )


def trace_tail(df: DataFrame, column: str = "trace", max_lines: int = MAX_TRACE_LINES) -> DataFrame:
    """Keep the last lines of a trace; adds ``line_no`` (from 1) and ``line``."""
    rest = [c for c in df.columns if c != column]
    # Lines are at least as many as newlines, so the end of the text holds all of the tail.
    end = F.substring_index(F.col(column), "\n", -(max_lines + 1))
    split = df.select(*rest, lines(end).alias("__lines"))
    keep = F.least(F.size("__lines"), F.lit(max_lines))
    tail = F.slice("__lines", F.size("__lines") - keep + 1, keep)
    return split.select(*rest, F.posexplode(tail).alias("__i", "line")).select(
        *rest, (F.col("__i") + 1).cast("bigint").alias("line_no"), "line"
    )


def run_status(events: DataFrame) -> DataFrame:
    """Status per run, in this order: running, error, done, idle; with the latest point."""

    def last(*kinds: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), F.col("seq"))), F.lit(-1))

    runs = events.groupBy("run_id").agg(
        last(TRAIN_BEGIN).alias("begin"),
        last(TRAIN_END).alias("end"),
        last(FAILURE).alias("failure"),
        *_at_last_point(events),
    )
    status = (
        F.when((F.col("begin") >= 0) & (F.col("begin") > F.greatest("end", "failure")), "running")
        .when(F.col("failure") > F.col("begin"), "error")
        .when(F.col("end") > F.col("begin"), "done")
        .otherwise("idle")
    )
    alive = F.col("seq") > F.col("begin")
    return runs.select(
        "run_id",
        status.alias("status"),
        F.when(alive, F.col("step")).alias("step"),
        F.when(alive, F.col("loss")).alias("loss"),
    )


def run_summary(points: DataFrame) -> DataFrame:
    """Steps reached, final loss and number of points per run; rewards where they are named."""
    final = F.max_by("loss", F.when(F.col("loss").isNotNull(), F.struct("step", "seq")))
    rewards = (
        [F.countDistinct("reward_name").alias("num_rewards")] if "reward_name" in points.columns else []
    )
    return points.groupBy("run_id").agg(
        F.max("step").alias("steps"),
        final.alias("final_loss"),
        F.count(F.lit(1)).alias("n_points"),
        *rewards,
    )
