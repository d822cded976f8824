"""From a job spec to written tables."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tuneloom.functions.resolve import output_names, resolve_rewards
from tuneloom.functions.text import flat_column
from tuneloom.operators.capture import capture_rewards
from tuneloom.operators.formatting import cap_tokens, format_rows
from tuneloom.operators.layout import step_schedule
from tuneloom.operators.prompts import generation_slots, map_columns, prompt_column
from tuneloom.operators.scoring import group_advantage, score_group_reward, score_rewards, weighted_total
from tuneloom.plans.parts import CommittedParts, input_of, read_document_if_any
from tuneloom.plans.spec import JobSpec, job_from_dict
from tuneloom.sources.datasets import DatasetCatalog, load_dataset
from tuneloom.sources.sinks import read_document, write_document, write_rows
from tuneloom.streaming.streams import append_stream


def _load(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec, streaming: bool = False) -> DataFrame:
    data = job.dataset
    return load_dataset(
        spark, catalog, data.name, config=data.config, split=data.split, max_samples=data.max_samples,
        streaming=streaming, order_by=data.order_by or data.key,
    )


def training_texts(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec, streaming: bool = False) -> DataFrame:
    """Key (if named) and capped training text of every row."""
    data = job.dataset
    keep = [data.key] if data.key else []
    step = format_rows(data.format, column_map=data.column_map, template=data.template, keep=keep)
    return cap_tokens(_load(spark, catalog, job, streaming).transform(step), job.train.max_seq_length)


def prompt_table(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec) -> DataFrame:
    """Capped prompts with ``n_tokens`` and ``was_truncated``, once for each generation."""
    rows = prompt_column(map_columns(_load(spark, catalog, job), job.dataset.column_map), job.prompt_column)
    rows = rows.withColumn("prompt", flat_column(rows, "prompt"))
    return generation_slots(cap_tokens(rows, job.max_prompt_length, "prompt"), job.num_generations)


def scored_completions(completions: DataFrame, job: JobSpec, group: list[str], position: str = "gen_idx") -> DataFrame:
    """Rewards, weighted total and group-relative advantage of generated completions, over their whole text.

    ``group`` names what is compared, the round of generations included; the spec's group-scope
    rewards see exactly those completions.
    """
    rewards = _named_rewards(job)
    out = completions.withColumn("completion", flat_column(completions, "completion"))
    by_row = [r for r in rewards if r.scope == "row"]
    if by_row:
        out = score_rewards(out, by_row)
    for reward in rewards:
        if reward.scope == "group":
            out = score_group_reward(out, reward, group, position)
    return group_advantage(weighted_total(out, rewards), group)


def _named_rewards(job: JobSpec) -> list:
    rewards = resolve_rewards(job.reward_dicts())
    # Names are settled over the whole list, so that two uses of one reward do not clash.
    return [replace(r, name=n) for r, n in zip(rewards, output_names(rewards), strict=True)]


def run_scoring(
    spark: SparkSession,
    completions: DataFrame,
    job: JobSpec,
    group: list[str],
    step: str,
    position: str = "gen_idx",
) -> dict[str, Any]:
    """Score completions and write ``scores``, ``samples`` (the first of each step), the config echo and a summary.

    Run again for the same output directory, a finished part is kept and only what is missing is done.
    """
    base = job.output_dir.rstrip("/")
    names = [reward.name for reward in _named_rewards(job)]
    measured = read_document_if_any(spark, f"{base}/scores_summary")
    if measured is None:
        measures = {"mean_total": F.avg("total_reward"), **{f"mean_{n}": F.avg(n) for n in names}}
        scored = scored_completions(completions, job, group, position)
        measured = write_rows(scored, f"{base}/scores", measures=measures, mode="overwrite")
        write_document(spark, f"{base}/config", job.to_dict())
        write_document(spark, f"{base}/scores_summary", measured)
    scores = spark.read.parquet(f"{base}/scores")
    samples = capture_rewards(scored_columns(scores, names), names, by=[step], order=[*group, position])
    kept = write_rows(samples, f"{base}/samples", mode="overwrite")
    summary = {"output_dir": base, "type": job.type, "num_rewards": len(names), **measured, "samples": kept["rows"]}
    write_document(spark, f"{base}/summary", summary)
    return summary


def scored_columns(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.select(*(c for c in scores.columns if c not in names), *names)


def sft_parts(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec) -> Iterator[tuple[str, dict[str, Any]]]:
    """Write texts and, with a ``key``, the training schedule; each part's name and measures when it is there."""
    run = _begun(spark, job)
    texts = training_texts(spark, catalog, job)
    measures = {"tokens": F.sum("n_tokens"), "truncated": F.sum(F.col("was_truncated").cast("bigint"))}
    done = run.part("texts", input_of(texts), lambda: texts, measures)
    yield "texts", done
    if job.dataset.key:
        # Planned from the written keys: the texts are neither read nor formatted again.
        keys = spark.read.parquet(f"{run.base}/texts").select(job.dataset.key)
        plan = functools.partial(
            step_schedule,
            keys,
            job.dataset.key,
            seed=job.seed,
            epochs=job.train.epochs,
            batch_size=job.train.per_device_train_batch_size,
            accumulation=job.train.gradient_accumulation_steps,
            max_steps=job.train.max_steps,
        )
        yield "schedule", run.part("schedule", input_of(keys), plan, {"last": F.max("step")})


def run_sft(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec) -> dict[str, Any]:
    """Write texts, the training schedule (with a ``key``), the config echo and a summary.

    Run again for the same output directory, it keeps finished parts and does what is missing.
    """
    parts = dict(sft_parts(spark, catalog, job))
    base = job.output_dir.rstrip("/")
    summary = {"output_dir": base, "type": job.type, "format": job.dataset.format, **parts["texts"]}
    if "schedule" in parts:
        last = parts["schedule"]["last"]
        summary["steps"] = 0 if last is None else last + 1
    write_document(spark, f"{base}/summary", summary)
    return summary


def run_grpo(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec) -> dict[str, Any]:
    """Write the prompt table, the config echo and a summary; rewards are checked first. Goes on like ``run_sft``."""
    rewards = resolve_rewards(job.reward_dicts())
    run = _begun(spark, job)
    prompts = prompt_table(spark, catalog, job)
    truncated = F.sum(F.col("was_truncated").cast("bigint"))
    measured = run.part("prompts", input_of(prompts), lambda: prompts, {"truncated": truncated})
    summary = {"output_dir": run.base, "type": job.type, "num_rewards": len(rewards), **measured}
    write_document(spark, f"{run.base}/summary", summary)
    return summary


def _begun(spark: SparkSession, job: JobSpec) -> CommittedParts:
    """The output directory of ``job``, new or left by an earlier run of it; fails if it is another job's."""
    base = job.output_dir.rstrip("/")
    own = json.loads(json.dumps(job.to_dict(), default=str))
    before = read_document_if_any(spark, f"{base}/config")
    if before is not None and before != own:
        raise ValueError(f"{base} is the output of a job with other settings")
    run = CommittedParts(spark, base)
    if before is None:
        foreign = [name for name in ("texts", "schedule", "prompts") if run.holds(name)]
        if foreign:
            raise ValueError(f"{base} holds {', '.join(foreign)} that no job of this kind has begun")
        write_document(spark, f"{base}/config", own)
    return run


def run_job(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec) -> dict[str, Any]:
    return run_sft(spark, catalog, job) if job.type == "sft" else run_grpo(spark, catalog, job)


def stream_texts(spark: SparkSession, catalog: DatasetCatalog, job: JobSpec, interval: str | None = None) -> StreamingQuery:
    """Format a growing dataset; run again, it goes on after the last finished batch."""
    base = job.output_dir.rstrip("/")
    write_document(spark, f"{base}/config", job.to_dict())
    return append_stream(
        training_texts(spark, catalog, job, streaming=True), f"{base}/texts", f"{base}/checkpoint", interval=interval
    )


def resume_texts(spark: SparkSession, catalog: DatasetCatalog, output_dir: str, interval: str | None = None) -> StreamingQuery:
    """Go on with the stream whose config echo lies in ``output_dir``."""
    base = output_dir.rstrip("/")
    try:
        spec = read_document(spark, f"{base}/config")
    except AnalysisException as error:
        raise FileNotFoundError(f"{base} holds no job: {base}/config is missing") from error
    job = job_from_dict(spec)
    if job.type != "sft":
        raise ValueError(f"A job of type {job.type!r} has no text stream to resume")
    return stream_texts(spark, catalog, replace(job, output_dir=base), interval)
