"""Row formatting and length caps as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tuneloom.functions.formats import ChatTemplate, get_format, get_template
from tuneloom.functions.text import tokens
from tuneloom.operators.prompts import map_columns


def format_rows(
    format: str,
    column_map: dict[str, str] | None = None,
    template: str | ChatTemplate | None = None,
    keep: Sequence[str] = (),
    output: str = "text",
) -> Callable[[DataFrame], DataFrame]:
    """A step for ``df.transform``: the ``keep`` columns and the formatted text.

    Works alike on batch and streaming DataFrames. ``keep`` names columns of the dataset
    before the column map.
    """
    build, chat = get_format(format), get_template(template)

    def step(df: DataFrame) -> DataFrame:
        kept = [f"__keep_{i}" for i in range(len(keep))]
        carried = df.withColumns({k: F.col(f"`{name}`") for k, name in zip(kept, keep, strict=True)}) if keep else df
        mapped = map_columns(carried, column_map)
        return mapped.select(
            *(F.col(k).alias(name) for k, name in zip(kept, keep, strict=True)),
            build(mapped, chat).alias(output),
        )

    return step


def capped_text(words: Column, text: Column, limit: int) -> Column:
    short = F.array_join(F.slice(words, 1, limit), " ")
    return F.when(F.size(words) > limit, short).otherwise(text)


def cap_tokens(df: DataFrame, limit: int, column: str = "text") -> DataFrame:
    """Cut texts above ``limit`` whitespace tokens to the first ones, joined by one space.

    Texts within the limit are left as they are. Adds ``n_tokens`` (before the cut) and
    ``was_truncated``.
    """
    if limit < 1:
        raise ValueError("The token limit must be at least 1")
    words = "__words"
    counted = df.withColumn(words, tokens(F.coalesce(F.col(column), F.lit(""))))
    return counted.select(
        *(
            capped_text(F.col(words), F.col(c), limit).alias(c) if c == column else F.col(c)
            for c in df.columns
        ),
        F.size(words).cast("bigint").alias("n_tokens"),
        (F.size(words) > limit).alias("was_truncated"),
    )
