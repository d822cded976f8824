"""Reward samples: per-step capture, the most recent ones, the display table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tuneloom.functions.text import flat_column
from tuneloom.operators.scale import top_n
from tuneloom.operators.scoring import long_rewards

MAX_PER_STEP = 4
MAX_SAMPLES = 20
# Widths of the display table.
PROMPT_WIDTH, COMPLETION_WIDTH, REWARD_DIGITS = 120, 160, 3


def capture_samples(
    scored: DataFrame,
    by: Sequence[str] = ("run_id", "step", "reward_name"),
    order: Sequence[str] = ("pos",),
    max_per_step: int = MAX_PER_STEP,
) -> DataFrame:
    """The first rows of every (run, step, reward), prompts and completions as text."""
    first = top_n(scored, max_per_step, [F.asc(c) for c in order], by)
    return first.withColumns(
        {c: flat_column(first, c) for c in ("prompt", "completion") if c in first.columns}
    )


def capture_rewards(
    scored: DataFrame,
    rewards: Sequence[str],
    by: Sequence[str] = ("run_id", "step"),
    order: Sequence[str] = ("pos",),
    max_per_step: int = MAX_PER_STEP,
) -> DataFrame:
    """Samples of several rewards that scored the same rows, in long form.

    Every reward captures the same first rows of a step, so they are cut out once, before
    their texts are repeated for each reward.
    """
    return long_rewards(capture_samples(scored, by, order, max_per_step), rewards)


def recent_samples(
    samples: DataFrame,
    order: Sequence[str] = ("step", "reward_index", "pos"),
    max_samples: int = MAX_SAMPLES,
    by: Sequence[str] = (),
) -> DataFrame:
    """The last samples (of each run, with ``by``), oldest first."""
    last = top_n(samples, max_samples, [F.desc(c) for c in order], by)
    return last.orderBy(*by, *order)


def sample_table(samples: DataFrame, keep: Sequence[str] = ("step", "reward_name")) -> DataFrame:
    """Cut and round samples for display."""
    return samples.select(
        *keep,
        F.substring("prompt", 1, PROMPT_WIDTH).alias("prompt"),
        F.substring("completion", 1, COMPLETION_WIDTH).alias("completion"),
        F.bround("reward", REWARD_DIGITS).alias("reward"),
    )
