"""The registered queries: every operator over whole test tables."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tuneloom.functions.formats import TEMPLATES, chat_text
from tuneloom.functions.text import first_field, flat_column, parsed_shapes
from tuneloom.operators import capture, checkpoints, layout, telemetry
from tuneloom.operators.formatting import cap_tokens, format_rows
from tuneloom.operators.prompts import (
    generation_slots,
    join_completions,
    map_columns,
    prompt_column,
    zip_lists,
    zip_roles,
)
from tuneloom.operators.scoring import (
    group_advantage,
    long_rewards,
    mean_reward,
    score_group_reward,
    score_rewards,
    weighted_total,
)
from tuneloom.plans import jobs, views
from tuneloom.plans.spec import job_from_dict
from tuneloom.plans.views import REWARD_NAMES, REWARDS, table
from tuneloom.session import scratch_path
from tuneloom.sources import datasets
from tuneloom.sources.sinks import write_rows
from tuneloom.streaming import history, streams

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def _catalog(sf_dir: str) -> datasets.DatasetCatalog:
    return datasets.DatasetCatalog(
        paths={name: f"{sf_dir}/{name}.parquet" for name in ("documents", "conversations", "events")},
        layout="file",
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_events(table(spark, sf_dir, "events"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.metric_points(_events(spark, sf_dir))


# Sources -----------------------------------------------------------------------------------


@query
def split_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.load_dataset(
        spark, _catalog(sf_dir), "documents", split="train[200:500]", order_by="doc_id"
    )


@query
def split_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.load_dataset(
        spark, _catalog(sf_dir), "documents", split="train[10%:-25%]", order_by="doc_id"
    ).select("doc_id", "n_chars")


@query
def max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.load_dataset(
        spark, _catalog(sf_dir), "documents", split="train[50:]", max_samples=100, order_by="doc_id"
    )


@query
def preview_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.preview_json(_documents(spark, sf_dir), "doc_id")


@query
def preview_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.instruction_rows(_documents(spark, sf_dir))
    return datasets.preview_formatted(rows, "doc_id", "alpaca")


@query
def sink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write formatted rows; the summary is measured during the write."""
    rows = views.instruction_rows(_documents(spark, sf_dir)).transform(format_rows("alpaca", keep=["doc_id"]))
    summary = write_rows(
        rows, scratch_path(spark, "sink"), measures={"n_chars": F.sum(F.length("text").cast("bigint"))}
    )
    return spark.createDataFrame(
        [(summary["rows"], summary["n_chars"])], "n_rows bigint, n_chars bigint"
    )


@query
def sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted rows, written and read back."""
    rows = views.instruction_rows(_documents(spark, sf_dir)).transform(format_rows("alpaca", keep=["doc_id"]))
    path = scratch_path(spark, "sink")
    write_rows(rows, path, max_rows_per_file=200)
    return spark.read.parquet(path)


def _partitioned(spark: SparkSession, sf_dir: str) -> datasets.DatasetCatalog:
    """A copy of ``documents`` with languages as configs and sources as splits."""
    path = scratch_path(spark, "partitioned")
    split = F.when(F.col("source").isin("src1", "src2", "src3"), "test").otherwise("train")
    rows = _documents(spark, sf_dir).withColumn("config", F.col("lang")).withColumn("split", split)
    rows.write.partitionBy("config", "split").parquet(path)
    return datasets.DatasetCatalog(paths={"documents": path}, layout="partitions")


@query
def config_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One config and split of a partitioned dataset; the others' folders are not read."""
    rows = datasets.load_dataset(spark, _partitioned(spark, sf_dir), "documents", config="en", split="test[10:60]", order_by="doc_id")
    return rows.select("doc_id", "text", "config", "split")


@query
def stream_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named load as a stream."""
    rows = datasets.load_dataset(spark, _partitioned(spark, sf_dir), "documents", config="de", split="train", streaming=True)
    path = scratch_path(spark, "stream-named")
    streams.append_stream(rows.select("doc_id", "text"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


# Projection and formatting -----------------------------------------------------------------


@query
def column_map_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = format_rows("completion", column_map={"source": "prompt", "text": "completion"}, keep=["doc_id"])
    return _documents(spark, sf_dir).transform(step)


@query
def column_map_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns mapped onto one name: the later one stays."""
    return map_columns(_documents(spark, sf_dir), {"lang": "label", "source": "label", "text": "body"})


@query
def prompt_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_column(_documents(spark, sf_dir).select("doc_id", "text"), "text")


@query
def fmt_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.instruction_rows(_documents(spark, sf_dir))
    return rows.transform(format_rows("alpaca", keep=["doc_id"]))


@query
def fmt_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).transform(format_rows("raw_text", keep=["doc_id"]))


@query
def fmt_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null prompts and answers, and the answer column under its other name."""
    rows = _documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("prompt"),
        F.when(F.col("doc_id") % 2 != 0, F.col("text")).alias("response"),
    )
    return rows.transform(format_rows("completion", keep=["doc_id"]))


@query
def fmt_sharegpt_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.turn_lists(_turns(spark, sf_dir))
    return lists.transform(format_rows("sharegpt", keep=["conv_id"]))


@query
def fmt_sharegpt_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker names ``human`` and ``gpt`` become roles before the template is applied."""
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    lists = views.turn_lists(_turns(spark, sf_dir).withColumn("role", speaker))
    speakers = F.transform(
        "messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))
    )
    named = lists.select("conv_id", speakers.alias("conversations"))
    return named.transform(format_rows("sharegpt", template="im_tags", keep=["conv_id"]))


@query
def fmt_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.turn_lists(_turns(spark, sf_dir))
    return lists.transform(format_rows("chat_template", template=TEMPLATES["role_colon"], keep=["conv_id"]))


@query
def fmt_chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layouts with rules; conversations whose roles don't take turns are null in the two that ask for it."""
    lists = views.turn_lists(_turns(spark, sf_dir))
    names = ("inst_tags", "turn_tags", "header_tags")
    return lists.select("conv_id", *(chat_text(lists, replace(TEMPLATES[name], broken="null")).alias(name) for name in names))


@query
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_tokens(_documents(spark, sf_dir).select("doc_id", "text"), 128)


# Rewards -----------------------------------------------------------------------------------


def _score(spark: SparkSession, sf_dir: str, reward: dict) -> DataFrame:
    answers = views.answer_rows(_turns(spark, sf_dir))
    return score_rewards(answers, [reward]).drop("completion")


@query
def reward_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, REWARDS[0])


@query
def reward_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, REWARDS[1])


@query
def reward_regex_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with literal braces, open-ended counts, inline and outer flags."""
    kwargs = {"pattern": r"(?i:PURCHASE).*\{\"k\": ?\d{,3}}|^{\"k\": [0-9]{1,}}$", "flags": int(re.MULTILINE | re.DOTALL)}
    lines = views.log_lines(table(spark, sf_dir, "events")).select("seq", F.col("line").alias("completion"))
    return score_rewards(lines, [{"name": "regex_format_reward", "kwargs": kwargs}]).drop("completion")


@query
def reward_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, REWARDS[2])


@query
def reward_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rewards over the document table in one projection."""
    scored = score_rewards(_documents(spark, sf_dir).select("doc_id", "text"), REWARDS, completion="text")
    return weighted_total(scored.drop("text"), REWARDS)


@query
def reward_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = views.turn_lists(_turns(spark, sf_dir))
    return lists.select("conv_id", flat_column(lists, "messages").alias("flat"))


@query
def reward_flatten_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions whose shape differs by row and by item."""
    rows = views.mixed_completions(_turns(spark, sf_dir)).withColumn("completion", parsed_shapes(F.col("completion")))
    scored = score_rewards(rows, [REWARDS[0]])
    return scored.select("conv_id", flat_column(scored, "completion").alias("flat"), "length_reward")


@query
def fmt_mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues that name their list and its fields differently by row."""
    parsed = views.mixed_dialogues(_turns(spark, sf_dir)).withColumn("row", F.parse_json("row"))
    lists = parsed.select("conv_id", first_field(F.col("row"), "conversations", "messages").alias("conversations"))
    return lists.transform(format_rows("sharegpt", template="im_tags", keep=["conv_id"]))


@query
def reward_contains_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred keywords, some of them twice, in either case."""
    reward = {"name": "contains_reward", "kwargs": {"keywords": views.many_keywords()}}
    scored = score_rewards(_documents(spark, sf_dir).select("doc_id", "text"), [reward], completion="text")
    return scored.select("doc_id", F.round("contains_reward", 6).alias("contains_reward"))


def shared_words(prompts, completions, weight=1.0):
    """Share of the prompt's words that come back in the completion."""
    scores = []
    for asked, answered in zip(prompts, completions, strict=True):
        words = set(asked.split())
        scores.append(weight * len(words & set(answered.split())) / len(words) if words else 0.0)
    return scores


@query
def reward_user_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.pair_rows(_turns(spark, sf_dir))
    scored = score_rewards(pairs, [{"name": f"{__name__}:shared_words", "kwargs": {"weight": 2.0}}])
    return scored.select("conv_id", "turn", F.round("shared_words", 6).alias("shared_words"))


def long_for_turn(prompts, completions, turn):
    """A reward that needs another column of the row."""
    return [len(text) / (1 + at) for text, at in zip(completions, turn, strict=True)]


@query
def reward_user_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.pair_rows(_turns(spark, sf_dir))
    scored = score_rewards(pairs, [{"name": f"{__name__}:long_for_turn", "columns": ["turn"]}])
    return scored.select("conv_id", "turn", F.round("long_for_turn", 6).alias("long_for_turn"))


def share_shorter(prompts, completions):
    """Share of the group's completions that are shorter."""
    sizes = sorted(map(len, completions))
    return [bisect_left(sizes, len(text)) / len(sizes) for text in completions]


@query
def reward_group_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.pair_rows(_turns(spark, sf_dir))
    spec = {"name": "tuneloom.functions.group_rewards:distinct_share", "scope": "group"}
    scored = score_group_reward(pairs, spec, group=["conv_id"], position="turn")
    return scored.select("conv_id", "turn", F.round("distinct_share", 6).alias("distinct_share"))


@query
def reward_group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain function over the lists of each group."""
    pairs = views.pair_rows(_turns(spark, sf_dir))
    scored = score_group_reward(pairs, {"name": share_shorter, "scope": "group"}, group=["conv_id"], position="turn")
    return scored.select("conv_id", "turn", F.round("share_shorter", 6).alias("share_shorter"))


def _by_source(spark: SparkSession, sf_dir: str, reward: str) -> DataFrame:
    """Documents as completions, all of a source in one group."""
    texts = _documents(spark, sf_dir).select("doc_id", "source", F.lit("").alias("prompt"), F.col("text").alias("completion"))
    spec = {"name": f"tuneloom.functions.group_rewards:{reward}", "scope": "group"}
    return score_group_reward(texts, spec, group=["source"], position="doc_id")


@query
def reward_group_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reward that reads a source's documents once, in order, batch by batch."""
    return _by_source(spark, sf_dir, "longer_than_before").select("doc_id", "source", "longer_than_before")


@query
def reward_group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reward that sums up a source by states which merge."""
    scored = _by_source(spark, sf_dir, "relative_length")
    return scored.select("doc_id", "source", F.round("relative_length", 6).alias("relative_length"))


@query
def scored_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring job from completions to written scores: an answer counts however late in its text it comes."""
    job = job_from_dict({
        "type": "grpo", "output_dir": scratch_path(spark, "scored-job"),
        "dataset": {"name": "documents"},
        "max_completion_length": 16,
        "rewards": [
            {"name": "contains_reward", "kwargs": {"keywords": ["</answer>"]}},
            {"name": "tuneloom.functions.group_rewards:distinct_share", "scope": "group", "weight": 0.5},
        ],
    })
    texts = _documents(spark, sf_dir).select(
        "doc_id", "source", F.expr("doc_id div 100").alias("step"), F.lit("").alias("prompt"),
        F.concat("text", F.when(F.col("doc_id") % 2 == 0, "</answer>").otherwise("")).alias("completion"),
    )
    jobs.run_scoring(spark, texts, job, ["source"], "step", "doc_id")
    scores = spark.read.parquet(f"{job.output_dir}/scores")
    return scores.select("doc_id", "contains_reward", *(F.round(c, 6).alias(c) for c in ("distinct_share", "total_reward", "advantage")))


@query
def job_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that ends after its first part and is run again: every text at its steps."""
    job = job_from_dict({
        "type": "sft", "output_dir": scratch_path(spark, "resumed-job"), "seed": 42,
        "dataset": {"name": "documents", "format": "raw_text", "key": "doc_id"},
        "train": {"epochs": 1.5, "max_seq_length": 128},
    })
    next(jobs.sft_parts(spark, _catalog(sf_dir), job))
    jobs.run_sft(spark, _catalog(sf_dir), job)
    texts, plan = (spark.read.parquet(f"{job.output_dir}/{part}") for part in ("texts", "schedule"))
    return plan.join(texts, "doc_id").select("doc_id", F.col("epoch").cast("bigint").alias("epoch"), "pos", "step", F.col("n_tokens").cast("bigint").alias("n_tokens"))


# Groups ------------------------------------------------------------------------------------


@query
def prompt_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = _turns(spark, sf_dir).where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    slots = generation_slots(prompts, 4)
    return slots.withColumn("gen_idx", F.col("gen_idx").cast("bigint"))


@query
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every completion with the first user turn of its dialogue."""
    turns = _turns(spark, sf_dir)
    first = (
        turns.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("prompt"))
    )
    return join_completions(first, views.answer_rows(turns), ["conv_id"])


@query
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pair_rows(_turns(spark, sf_dir))


@query
def zip_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nth prompt and the nth completion of each dialogue, to the end of the shorter list."""
    return zip_roles(_turns(spark, sf_dir))


@query
def zip_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel lists of one row, zipped to the shorter one: the words and the lines of every document."""
    lists = _documents(spark, sf_dir).select(
        "doc_id", F.split("text", " ").alias("word"), F.split("text", "\n").alias("line")
    )
    return zip_lists(lists, "word", "line").withColumn("pos", F.col("pos").cast("bigint"))


@query
def weighted_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = weighted_total(views.scored_turns(_turns(spark, sf_dir)), REWARDS)
    return scored.select("conv_id", "turn", *REWARD_NAMES, F.round("total_reward", 6).alias("total_reward"))


@query
def group_relative_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: score every answer that has a turn before it, compare within the dialogue."""
    total = weighted_total(views.scored_turns(_turns(spark, sf_dir)), REWARDS)
    compared = group_advantage(total, ["conv_id"])
    return compared.select(
        "conv_id",
        "turn",
        *(F.round(name, 6).alias(name) for name in (*REWARD_NAMES, "total_reward", "advantage")),
    )


@query
def mean_reward_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = views.reward_rows(_turns(spark, sf_dir))
    means = mean_reward(samples, ["run_id", "step", "reward_name"])
    return means.withColumn("mean_reward", F.round("mean_reward", 6))


# Samples -----------------------------------------------------------------------------------

_SAMPLE_COLUMNS = ["step", "reward_name", "pos", "prompt", "completion", "reward"]


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs of every step: cut first, so that only the samples are scored."""
    first = capture.capture_samples(views.sample_pairs(_turns(spark, sf_dir)), by=["run_id", "step"])
    return long_rewards(score_rewards(first, REWARDS), REWARD_NAMES)


@query
def capture_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = _captured(spark, sf_dir)
    return captured.select(*_SAMPLE_COLUMNS)


@query
def recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = _captured(spark, sf_dir)
    return capture.recent_samples(captured).select(*_SAMPLE_COLUMNS)


@query
def sample_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = _captured(spark, sf_dir)
    return capture.sample_table(captured, keep=["step", "reward_name", "pos"])


# Telemetry ---------------------------------------------------------------------------------


@query
def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("run_id", "seq", "step", "loss", "reward")


@query
def metric_points_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events with empty maps make no point; a mean reward under its other name counts, the plain one first."""
    events = table(spark, sf_dir, "events")
    value, kind = F.col("value"), F.col("event_type")
    logs = (
        F.when(kind == "view", F.create_map(F.lit("rewards/mean"), value))
        .when(kind == "purchase", F.create_map(F.lit("reward"), value, F.lit("rewards/mean"), F.lit(-1.0)))
        .otherwise(F.expr("cast(map() as map<string,double>)"))
    )
    rows = events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.lit(telemetry.LOG).alias("kind"),
        F.lit(1).cast("bigint").alias("step"), logs.alias("logs"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return telemetry.metric_points(rows).select("run_id", "seq", "loss", "reward")


@query
def metric_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = telemetry.metric_history(_events(spark, sf_dir), max_points=3)
    return ring.select("run_id", "seq", "step", "loss", "reward")


@query
def metric_ring_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default length of a history, with all runs in one."""
    events = _events(spark, sf_dir).withColumn("run_id", F.col("run_id") % 3)
    ring = telemetry.metric_history(events.where(F.col("kind") != telemetry.TRAIN_BEGIN))
    return ring.select("run_id", "seq", "step", "loss", "reward")


@query
def metric_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = telemetry.latest_points(_events(spark, sf_dir))
    return latest.select("run_id", "seq", "step", "loss", "reward")


@query
def loss_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.every_steps(telemetry.loss_curve(_points(spark, sf_dir)), 5)


@query
def reward_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.reward_curve(_points(spark, sf_dir))


@query
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.log_tail(views.log_lines(table(spark, sf_dir, "events")), max_lines=20)


@query
def log_tail_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default length of a tail, with few runs."""
    lines = views.log_lines(table(spark, sf_dir, "events"))
    return telemetry.log_tail(lines.withColumn("run_id", F.col("run_id") % 3))


@query
def trace_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.col("text").alias("trace"))
    return telemetry.trace_tail(rows)


@query
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = telemetry.run_status(_events(spark, sf_dir))
    return status.withColumn("step", F.coalesce("step", F.lit(-1)))


@query
def run_status_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that can end: every purchase ends one."""
    kind = F.col("kind")
    ended = F.when(F.map_contains_key("logs", "train_loss"), F.lit(telemetry.TRAIN_END)).otherwise(kind)
    return telemetry.run_status(_events(spark, sf_dir).withColumn("kind", ended)).select("run_id", "status")


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("reward").isNotNull(), F.concat(F.lit("reward_"), F.floor(F.col("step") / 34)))
    return telemetry.run_summary(_points(spark, sf_dir).withColumn("reward_name", named))


# Saved states and layout -------------------------------------------------------------------


@query
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = checkpoints.latest_checkpoint(views.manifest(table(spark, sf_dir, "events")))
    return latest.withColumn("number", F.coalesce("number", F.lit(-1)))


@query
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.checkpoint_retention(views.manifest(table(spark, sf_dir, "events")), 2)


@query
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.batch_plan(_documents(spark, sf_dir).select("doc_id"), "doc_id", seed=42)


@query
def step_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id")
    plan = layout.step_schedule(rows, "doc_id", seed=42, epochs=1.5, batch_size=2, accumulation=4)
    return plan.withColumn("epoch", F.col("epoch").cast("bigint"))


@query
def step_schedule_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id")
    plan = layout.step_schedule(rows, "doc_id", seed=7, epochs=3, batch_size=1, accumulation=4, max_steps=20)
    return plan.withColumn("epoch", F.col("epoch").cast("bigint"))


@query
def step_schedule_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More steps than the epochs hold: the step count, here that of 2.4 epochs, decides alone."""
    rows = _documents(spark, sf_dir).select("doc_id")
    max_steps = math.ceil(2.4 * math.ceil(rows.count() / 8))
    plan = layout.step_schedule(rows, "doc_id", seed=3, epochs=1, batch_size=4, accumulation=2, max_steps=max_steps)
    return plan.withColumn("epoch", F.col("epoch").cast("bigint"))


@query
def step_schedule_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs by a permutation of the rows' numbers."""
    rows = _documents(spark, sf_dir).select("doc_id")
    plan = layout.permuted_schedule(rows, "doc_id", seed=11, epochs=3.5, batch_size=2, accumulation=4)
    return plan.withColumn("epoch", F.col("epoch").cast("bigint"))


# Streams: run to the end of the tables, then read the result back --------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of them: a glob path, as this one, may name either."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query
def stream_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.instruction_rows(_stream(spark, sf_dir, "documents"))
    formatted = rows.transform(format_rows("alpaca", keep=["doc_id"]))
    path = scratch_path(spark, "stream-format")
    streams.append_stream(formatted, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is stopped and started again, by the clock: each row arrives once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "stream-restart")
    for part in range(2):
        docs.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{path}/source")
        feed = spark.readStream.schema(docs.schema).parquet(f"{path}/source")
        running = streams.append_stream(feed, f"{path}/rows", f"{path}/checkpoint", interval="200 milliseconds")
        running.processAllAvailable()
        running.stop()
    return spark.read.parquet(f"{path}/rows")


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_rewards(views.answer_rows(_stream(spark, sf_dir, "conversations")), REWARDS)
    path = scratch_path(spark, "stream-score")
    streams.append_stream(scored.drop("completion"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.log_events(_stream(spark, sf_dir, "events"))
    path = scratch_path(spark, "stream-latest")
    live = streams.latest_table(f"{path}/rows")
    streams.latest_stream(events, live, f"{path}/checkpoint").awaitTermination()
    return streams.current_latest(spark, live).select("run_id", "seq", "step", "loss", "reward")


@query
def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.log_events(_stream(spark, sf_dir, "events"))
    path = scratch_path(spark, "stream-ring")
    live = history.history_table(f"{path}/rows", max_points=3)
    history.history_stream(events, live, f"{path}/checkpoint").awaitTermination()
    ring = history.current_history(spark, live)
    return ring.select("run_id", "seq", "step", "loss", "reward")


@query
def stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answers of every ten dialogues per reward, from four batches that share the steps."""
    turns = table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "stream-capture")
    turns.repartition(4, "turn", "text").write.parquet(f"{path}/source")
    feed = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/source")
    live = streams.capture_table(f"{path}/rows", fold_every=2)
    streams.capture_stream(views.answer_samples(feed), live, f"{path}/checkpoint").awaitTermination()
    captured = live.read(spark)
    return captured.select("step", "reward_name", "pos", "completion", "reward")


@query
def stream_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live mean reward curve, over four batches and a restart."""
    rows = views.reward_rows(_turns(spark, sf_dir))
    path = scratch_path(spark, "stream-curve")
    live = streams.curve_table(f"{path}/rows", fold_every=2)
    for half in range(2):
        part = rows.where(F.col("pos") % 2 == half).repartition(2, "pos", "reward_name")
        part.write.mode("append").parquet(f"{path}/source")
        feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/source")
        streams.curve_stream(feed, live, f"{path}/checkpoint").awaitTermination()
    curve = streams.current_curve(spark, live)
    return curve.select("run_id", "step", "reward_name", F.round("mean_reward", 6).alias("mean_reward"), "n_rewards")


@query
def stream_ring_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of the runs heard of within six hours, from batches in the order of time."""
    events = _events(spark, sf_dir)
    path, lifetime = scratch_path(spark, "stream-expiry"), 6 * 3_600
    # One file is one batch; a batch holds a stretch of time.
    events.repartitionByRange(4, "ts").write.parquet(f"{path}/source")
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/source")
    live = history.expiring_table(f"{path}/rows", lifetime, max_points=3, fold_every=2)
    history.expiring_stream(feed, live, f"{path}/checkpoint").awaitTermination()
    ring = history.current_expiring(spark, live, lifetime)
    return ring.select("run_id", "seq", "step", "loss", "reward")


@query
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live tail of every run's log."""
    lines = views.log_lines(_stream(spark, sf_dir, "events"))
    path = scratch_path(spark, "stream-log")
    live = streams.log_table(f"{path}/rows", max_lines=20)
    streams.log_stream(lines, live, f"{path}/checkpoint").awaitTermination()
    return streams.current_log(spark, live, max_lines=20)


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
