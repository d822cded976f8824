"""Reward scoring, weighted totals and group-relative advantages."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tuneloom.functions.group_rewards import GroupReward, reads_batches
from tuneloom.functions.resolve import Reward, output_names, resolve_rewards
from tuneloom.functions.rewards import TextParts
from tuneloom.functions.text import flat_column
from tuneloom.operators.scale import join_groups

_PART = "__part_"
_VALUE, _STATE = "__value", "__state"
# A task hands on its states of group rewards when it holds more than this many.
MOST_STATES = 10_000


def _checked(values: Sequence[float], expected: int, name: str) -> list[float | None]:
    values = list(values)
    if len(values) != expected:
        raise ValueError(f"Reward {name!r} returned {len(values)} values for {expected} completions")
    return [None if v is None else float(v) for v in values]


def _row_function(reward: Reward, prompt: str, completion: str) -> Column:
    """A user function over Arrow batches, given plain Python lists."""
    function, name, extra = reward.function, reward.name, reward.columns

    @F.arrow_udf("double")
    def score(prompts: pa.Array, completions: pa.Array, *others: pa.Array) -> pa.Array:
        kwargs = {key: column.to_pylist() for key, column in zip(extra, others, strict=True)}
        values = function(prompts.to_pylist(), completions.to_pylist(), **kwargs)
        return pa.array(_checked(values, len(completions), name), pa.float64())

    return score(F.col(prompt), F.col(completion), *map(F.col, extra))


def score_rewards(
    df: DataFrame,
    rewards: Sequence[Any],
    prompt: str = "prompt",
    completion: str = "completion",
) -> DataFrame:
    """Add one column per reward; built-in ones in a single projection of one scan."""
    rewards = resolve_rewards(rewards)
    if any(r.scope == "group" for r in rewards):
        raise ValueError("Rewards of group scope are scored by score_group_reward")
    names = output_names(rewards)
    clash = set(names) & set(df.columns)
    if clash:
        raise ValueError(f"The table already has columns {sorted(clash)}")

    used: dict[str, Column] = {}

    def part(name: str) -> Column:
        used.setdefault(name, F.col(_PART + name))
        used.setdefault("text", F.col(_PART + "text"))
        return F.col(_PART + name)

    scored = []
    for reward, name in zip(rewards, names, strict=True):
        if reward.native is not None:
            scored.append(reward.native(TextParts(part), **reward.kwargs).alias(name))
        else:
            scored.append(_row_function(reward, prompt, completion).alias(name))
    out = df
    if used:
        out = out.withColumn(_PART + "text", flat_column(df, completion))
        derived = {
            _PART + name: TextParts.BUILDERS[name](F.col(_PART + "text")) for name in used if name != "text"
        }
        out = out.withColumns(derived) if derived else out
    return out.select(*df.columns, *scored)


def score_group_reward(
    df: DataFrame,
    reward: Any,
    group: Sequence[str],
    position: str,
    prompt: str = "prompt",
    completion: str = "completion",
) -> DataFrame:
    """Score a function that judges whole generation groups: the rows that ``group_advantage`` compares.

    Where a prompt is generated for again and again, name the round in ``group``. What a task holds
    depends on what the function offers (see ``group_rewards``): with an ``aggregate`` or as a
    ``GroupReward`` it takes groups of any size, as a generator it gets the group batch by batch in the
    order of ``position``, as a plain function it gets the group's lists in that order. Only the texts
    and the columns it names go to Python; ``position`` tells the rows of a group apart.
    """
    (reward,) = resolve_rewards([reward])
    function, name = reward.function, reward.name
    if function is None:
        raise ValueError(f"Reward {name!r} is built in and needs no group scope")
    group = list(group)
    aggregate = getattr(function, "aggregate", None)
    if aggregate is not None:
        values = aggregate(df, group, F.col(prompt), F.col(completion))
        return join_groups(df, values, group).select(*df.columns, F.col("__value").alias(name))
    if isinstance(function, GroupReward):
        return _merged_score(df, reward, group, prompt, completion)
    return _streamed_score(df, reward, group, position, prompt, completion)


def _lists(batch: pa.RecordBatch, prompt: str, completion: str, extra: Sequence[str]) -> tuple[list, list, dict[str, list]]:
    return batch.column(prompt).to_pylist(), batch.column(completion).to_pylist(), {c: batch.column(c).to_pylist() for c in extra}


def _streamed_score(df: DataFrame, reward: Reward, group: list[str], position: str, prompt: str, completion: str) -> DataFrame:
    """The group's rows as Arrow batches, sorted before they reach Python; further columns are joined back."""
    function, name, extra = reward.function, reward.name, reward.columns
    needed = list(dict.fromkeys([*group, position, prompt, completion, *extra]))
    by_batch = reads_batches(function)

    def whole_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        prompts, completions, columns = [], [], {c: [] for c in extra}
        for batch in batches:
            some = _lists(batch, prompt, completion, extra)
            prompts += some[0]
            completions += some[1]
            for c in extra:
                columns[c] += some[2][c]
        scores = _checked(function(prompts, completions, **columns), len(completions), name)
        start = 0
        for batch in batches:
            yield batch.append_column(_VALUE, pa.array(scores[start:start + batch.num_rows], pa.float64()))
            start += batch.num_rows

    def batch_by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def lists():
            for batch in batches:
                waiting.append(batch)
                yield _lists(batch, prompt, completion, extra)

        for scores in function(lists()):
            if not waiting:
                raise ValueError(f"Reward {name!r} yields more than it was given")
            batch = waiting.popleft()
            yield batch.append_column(_VALUE, pa.array(_checked(scores, batch.num_rows, name), pa.float64()))
        if waiting or next(batches, None) is not None:
            raise ValueError(f"Reward {name!r} yields scores for some batches only")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batch_by_batch(batches) if by_batch else whole_group(batches)

    # Sorted by Spark, which spills; the groups then come in the order of their rows.
    narrow = df.select(*needed).repartition(*group).sortWithinPartitions(*group, position)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in narrow.schema), T.StructField(_VALUE, T.DoubleType())])
    score.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    scored = narrow.groupBy(*group).applyInArrow(score, schema)
    if set(df.columns) <= set(needed):
        return scored.select(*df.columns, F.col(_VALUE).alias(name))
    keys = [*group, position]
    return join_groups(df, scored.select(*keys, _VALUE), keys).select(*df.columns, F.col(_VALUE).alias(name))


def _merged_score(df: DataFrame, reward: Reward, group: list[str], prompt: str, completion: str) -> DataFrame:
    """States of what each task reads of a group, merged per group and joined back to the rows."""
    function, name, extra = reward.function, reward.name, reward.columns
    needed = list(dict.fromkeys([*group, prompt, completion, *extra]))
    keys = df.select(*group).schema
    state_schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in keys), T.StructField(_STATE, T.BinaryType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            rows_of: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in group))):
                rows_of.setdefault(key, []).append(at)
            for key, rows in rows_of.items():
                prompts, completions, columns = _lists(batch.take(pa.array(rows)), prompt, completion, extra)
                state = states.pop(key) if key in states else function.init()
                states[key] = function.add(state, prompts, completions, **columns)
            if len(states) > MOST_STATES:
                yield packed(states)
                states = {}
        if states:
            yield packed(states)

    def packed(states: dict[tuple, Any]) -> pa.RecordBatch:
        columns = [pa.array(values, kind) for values, kind in zip(zip(*states), kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(map(pickle.dumps, states.values()), pa.binary())], names=[*group, _STATE])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            for one in batch.column(_STATE).to_pylist():
                one = pickle.loads(one)
                state = one if last is None else function.merge(state, one)
                last = batch.slice(0, 1)
        whole = pa.array([pickle.dumps(function.finish(state))], pa.binary())
        yield last.set_column(last.schema.get_field_index(_STATE), _STATE, whole)

    @F.arrow_udf("double")
    def score(summaries: pa.Array, prompts: pa.Array, completions: pa.Array, *others: pa.Array) -> pa.Array:
        columns = {key: column.to_pylist() for key, column in zip(extra, others, strict=True)}
        prompts, completions = prompts.to_pylist(), completions.to_pylist()
        out: list[float | None] = [None] * len(completions)
        rows_of: dict[bytes, list[int]] = {}
        for at, summary in enumerate(summaries.to_pylist()):
            rows_of.setdefault(summary, []).append(at)
        for summary, rows in rows_of.items():
            values = function.score(
                pickle.loads(summary), [prompts[i] for i in rows], [completions[i] for i in rows],
                **{key: [column[i] for i in rows] for key, column in columns.items()},
            )
            for at, value in zip(rows, _checked(values, len(rows), name)):
                out[at] = value
        return pa.array(out, pa.float64())

    kinds = [to_arrow_type(field.dataType) for field in keys]
    merged.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    states = df.select(*needed).mapInArrow(partial, state_schema)
    summaries = states.groupBy(*group).applyInArrow(merged, state_schema)
    joined = join_groups(df, summaries, group)
    return joined.select(*df.columns, score(F.col(_STATE), F.col(prompt), F.col(completion), *map(F.col, extra)).alias(name))


def weighted_total(
    df: DataFrame, rewards: Sequence[Any], output: str = "total_reward"
) -> DataFrame:
    """Add the weighted plain sum of the reward columns; a null reward adds nothing."""
    rewards = resolve_rewards(rewards)
    terms = [
        F.lit(float(r.weight)) * F.coalesce(F.col(name), F.lit(0.0))
        for r, name in zip(rewards, output_names(rewards), strict=True)
    ]
    return df.withColumn(output, reduce(lambda a, b: a + b, terms))


def long_rewards(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (row, reward): ``reward_index``, ``reward_name``, ``reward``."""
    pairs = F.array(
        *(
            F.struct(F.lit(i).alias("reward_index"), F.lit(n).alias("reward_name"), F.col(n).alias("reward"))
            for i, n in enumerate(names)
        )
    )
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.explode(pairs).alias("__r")).select(*keep, "__r.*")


def group_advantage(
    df: DataFrame,
    group: Sequence[str],
    reward: str = "total_reward",
    ddof: int = 1,
    eps: float = 0.0,
    output: str = "advantage",
) -> DataFrame:
    """(reward - mean) / spread within the row's group; 0 in groups without spread.

    The statistics are one combinable aggregate per group and are joined back, so no task
    ever holds a group.
    """
    if ddof not in (0, 1):
        raise ValueError("ddof is 0 or 1")
    spread = F.stddev_samp(reward) if ddof else F.stddev_pop(reward)
    stats = df.groupBy(*group).agg(
        F.avg(reward).alias("__mean"),
        spread.alias("__spread"),
        F.min(reward).alias("__low"),
        F.max(reward).alias("__high"),
    )
    joined = join_groups(df, stats, group)
    value = F.when(F.col("__low") == F.col("__high"), F.lit(0.0)).otherwise(
        (F.col(reward) - F.col("__mean")) / (F.col("__spread") + F.lit(float(eps)))
    )
    return joined.select(*df.columns, value.alias(output))


def mean_reward(
    df: DataFrame, by: Sequence[str] = ("run_id", "step"), reward: str = "reward"
) -> DataFrame:
    """Mean reward and number of scored rows per step."""
    return df.groupBy(*by).agg(F.avg(reward).alias("mean_reward"), F.count(reward).alias("n_rewards"))
