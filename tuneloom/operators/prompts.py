"""Prompt tables, generation slots and (prompt, completion) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tuneloom.operators.scale import dense_positions, join_groups, previous_row


def map_columns(df: DataFrame, column_map: dict[str, str] | None) -> DataFrame:
    """Rename dataset columns to canonical names in one projection.

    ``column_map`` is {dataset column: canonical name}; others pass through. When two
    columns end up with one name, the later dataset column wins, at the earlier's place.
    """
    if not column_map:
        return df
    chosen: dict[str, str] = {}
    for source in df.columns:
        chosen[column_map.get(source, source)] = source
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in chosen.items()))


def prompt_column(df: DataFrame, name: str = "prompt") -> DataFrame:
    """Make ``name`` the ``prompt`` column."""
    if name not in df.columns:
        raise ValueError(f"No column {name!r} to take prompts from; the rows have {', '.join(df.columns)}")
    if name == "prompt":
        return df
    if "prompt" in df.columns:
        raise ValueError(f"Cannot use {name!r} as the prompt: the dataset has another 'prompt' column")
    return df.withColumnRenamed(name, "prompt")


def generation_slots(df: DataFrame, num_generations: int = 4, output: str = "gen_idx") -> DataFrame:
    """Repeat each prompt once per generation, numbered from 0."""
    if num_generations < 1:
        raise ValueError("num_generations must be at least 1")
    return df.withColumn(output, F.explode(F.sequence(F.lit(0), F.lit(num_generations - 1))))


def join_completions(
    prompts: DataFrame, completions: DataFrame, on: Sequence[str] = ("prompt_id",)
) -> DataFrame:
    """Inner join of completions with their prompt; a prompt with very many is split."""
    joined = join_groups(completions, prompts, on, how="inner")
    return joined.select(*on, *(c for c in [*prompts.columns, *completions.columns] if c not in on))


def zip_lists(df: DataFrame, *lists: str) -> DataFrame:
    """One row per position of parallel lists, stopping at the shortest; adds ``pos``."""
    shortest = F.least(*(F.coalesce(F.size(c), F.lit(0)) for c in lists))
    rest = [c for c in df.columns if c not in lists]
    zipped = F.slice(F.arrays_zip(*(F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in lists)), F.lit(1), shortest)
    return df.select(*rest, F.posexplode(zipped).alias("pos", "__item")).select(
        *rest, "pos", *(F.col("__item")[str(i)].alias(c) for i, c in enumerate(lists))
    )


def dialogue_pairs(
    turns: DataFrame,
    by: Sequence[str] = ("conv_id",),
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    answer_role: str = "assistant",
) -> DataFrame:
    """Each assistant turn with the turn before it, as prompt and completion."""
    found = previous_row(turns, by, order, {"prompt": text})
    return found.where((F.col(role) == answer_role) & F.col("has_previous")).select(
        *by, order, "prompt", F.col(text).alias("completion")
    )


def zip_roles(
    turns: DataFrame,
    by: Sequence[str] = ("conv_id",),
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    roles: dict[str, str] | None = None,
) -> DataFrame:
    """The nth text of each role of a dialogue side by side, to the end of the shortest list; adds ``pos``.

    ``roles`` maps a role to the column its texts get. Places are found and matched on the keys; a text is then
    fetched by its dialogue and order, which no two rows share, so that a dialogue of any size is spread.
    """
    roles = roles or {"user": "prompt", "assistant": "completion"}
    zipped = None
    for at, name in enumerate(roles):
        places = dense_positions(turns.where(F.col(role) == name), by, order)
        places = places.select(F.struct(*by).alias("__group"), "pos", F.col(order).alias(f"__order{at}"))
        zipped = places if zipped is None else zipped.join(places, ["__group", "pos"])
    for at, (name, column) in enumerate(roles.items()):
        texts = turns.where(F.col(role) == name).select(F.struct(*by).alias("__group"), F.col(order).alias(f"__order{at}"), F.col(text).alias(column))
        zipped = zipped.join(texts, ["__group", f"__order{at}"])
    return zipped.select("__group.*", "pos", *roles.values())


def conversations(
    turns: DataFrame,
    by: Sequence[str] = ("conv_id",),
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    output: str = "messages",
) -> DataFrame:
    """Gather turn rows into one row per conversation, an array of (role, content) in turn order.

    A conversation becomes a single value, so it has to fit into one row by definition.
    """
    turn = F.struct(
        F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content")
    )
    ordered = F.sort_array(F.collect_list(turn))
    return turns.groupBy(*by).agg(
        F.transform(
            ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias(output)
    )
