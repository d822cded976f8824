"""Rewards of group scope: what a function that judges a whole group can offer, so that no task has to hold it.

* A plain function over lists gets the group's lists, and only those: prompts, completions and named columns.
* A generator function is a reward that reads the group once, in the order of ``position``: it takes an iterator of
  ``(prompts, completions, columns)``, lists of some rows each, and yields a list of scores for each of them.
* A ``GroupReward`` says how a group is summed up: ``init``, ``add`` and ``merge`` make a state of rows and of other states
  in any order, ``finish`` turns it into what ``score`` needs to judge rows of the group by themselves.
* A function with an ``aggregate`` is a Spark aggregate joined back.

States of a ``GroupReward`` are made where the rows are read, so that a group of any size is as many states as
there are tasks. A generator holds one batch of rows and whatever it remembers.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

Batch = tuple[list, list, dict[str, list]]


class GroupReward:
    """A reward that sums up its group by states which merge; override all but ``__call__``.

    Settings belong into the constructor of the subclass; ``name`` is the reward's name.
    """

    name = "group_reward"

    def init(self) -> Any:
        """The state of no rows."""
        raise NotImplementedError

    def add(self, state: Any, prompts: list, completions: list, **columns: list) -> Any:
        """The state with some more rows."""
        raise NotImplementedError

    def merge(self, one: Any, other: Any) -> Any:
        """The state of the rows of both."""
        raise NotImplementedError

    def finish(self, state: Any) -> Any:
        """What ``score`` needs to know of the group."""
        return state

    def score(self, summary: Any, prompts: list, completions: list, **columns: list) -> list:
        """Scores of some rows of the group."""
        raise NotImplementedError

    def __call__(self, prompts: list, completions: list, **columns: list) -> list:
        """The same over a whole group in lists."""
        summary = self.finish(self.add(self.init(), prompts, completions, **columns))
        return self.score(summary, prompts, completions, **columns)


def reads_batches(function: Callable) -> bool:
    """Whether ``function`` (or what a bound one binds) is a generator over batches."""
    while hasattr(function, "func"):
        function = function.func
    return inspect.isgeneratorfunction(function)


def distinct_share(prompts, completions):
    """Same value for the whole group: the share of its completions that differ."""
    share = len(set(completions)) / len(completions)
    return [share] * len(completions)


def _distinct_share(rows: DataFrame, group: Sequence[str], prompt: Column, completion: Column) -> DataFrame:
    """The same per group, of texts told by their digests."""
    counted = rows.groupBy(*group, F.sha2(completion, 256).alias("__digest")).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*group).agg((F.count(F.lit(1)) / F.sum("__n")).alias("__value"))


#: Makes the group's columns and ``__value`` of a table; for rewards that are one value for the whole group.
distinct_share.aggregate = _distinct_share


class RelativeLength(GroupReward):
    """How long a completion is between the shortest (0) and the longest (1) of its group; 0 if all are alike."""

    name = "relative_length"

    def init(self):
        return None

    def add(self, state, prompts, completions):
        lengths = [len(text or "") for text in completions]
        return self.merge(state, (min(lengths), max(lengths)) if lengths else None)

    def merge(self, one, other):
        return (min(one[0], other[0]), max(one[1], other[1])) if one and other else one or other

    def score(self, summary, prompts, completions):
        low, high = summary
        return [(len(text or "") - low) / (high - low) if high > low else 0.0 for text in completions]


relative_length = RelativeLength()


def longer_than_before(batches: Iterator[Batch]) -> Iterator[list[float]]:
    """1 for a completion longer than all earlier ones of its group, else 0; remembers one number."""
    longest = -1
    for _, completions, _ in batches:
        scores = []
        for text in completions:
            size = len(text or "")
            scores.append(1.0 if size > longest else 0.0)
            longest = max(longest, size)
        yield scores
