"""Built-in rewards as column expressions over the flattened completion text."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, functions as F

from tuneloom.functions.patterns import to_spark_pattern
from tuneloom.functions.text import token_count

# Above this many keywords one automaton looks for all of them at once.
UNROLLED_KEYWORDS = 50


class TextParts:
    """The completion text and what several rewards share of it.

    ``score_rewards`` puts the parts that are asked for into one inner projection, so the
    text is split and lower-cased once however many rewards use it.
    """

    BUILDERS: dict[str, Callable[[Column], Column]] = {
        "n_tokens": token_count,
        "lowered": F.lower,
    }

    def __init__(self, column_of: Callable[[str], Column]):
        self._column_of = column_of

    @property
    def text(self) -> Column:
        return self._column_of("text")

    @property
    def n_tokens(self) -> Column:
        return self._column_of("n_tokens")

    @property
    def lowered(self) -> Column:
        return self._column_of("lowered")


def length_reward(parts: TextParts, *, target_tokens: int = 256) -> Column:
    """1 at the target number of tokens, falling linearly to 0 at a distance of one target."""
    target = int(target_tokens)
    distance = F.abs(parts.n_tokens - F.lit(target)).cast("double")
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(float(max(1, target))))


def regex_format_reward(parts: TextParts, *, pattern: str = ".*", flags: int = 0) -> Column:
    """1 where the pattern is found anywhere in the text, else 0."""
    return parts.text.rlike(to_spark_pattern(pattern, int(flags))).cast("double")


def contains_reward(parts: TextParts, *, keywords: Sequence[str] | None = None) -> Column:
    """Share of the keywords found in the text, ignoring case; repeated keywords count again."""
    words = [word.lower() for word in keywords or ()]
    if not words:
        return F.lit(0.0)
    if len(words) <= UNROLLED_KEYWORDS:
        hits = reduce(
            lambda total, word: total + parts.lowered.contains(F.lit(word)).cast("int"), words, F.lit(0)
        )
    else:
        hits = _keyword_hits(tuple(words))(parts.text)
    return hits.cast("double") / F.lit(float(len(words)))


@functools.lru_cache(maxsize=8)
def keyword_automaton(words: tuple[str, ...]):
    """An Aho-Corasick automaton of the words and how often each is asked for; kept by a worker between batches."""
    import ahocorasick

    asked = Counter(words)
    always = asked.pop("", 0)
    automaton = ahocorasick.Automaton()
    for at, (word, times) in enumerate(asked.items()):
        automaton.add_word(word, (at, times))
    automaton.make_automaton()
    return automaton, len(asked), always


def count_keywords(texts: list[str | None], words: tuple[str, ...]) -> list[int]:
    """How many of ``words`` each text holds, ignoring case: one pass over the text, however many there are."""
    automaton, different, always = keyword_automaton(words)
    counts = []
    for text in texts:
        seen: set[int] = set()
        hits = always
        for _, (at, times) in automaton.iter((text or "").lower()) if different else ():
            if at not in seen:
                seen.add(at)
                hits += times
                if len(seen) == different:
                    break
        counts.append(hits)
    return counts


def _keyword_hits(words: tuple[str, ...]) -> Callable[[Column], Column]:
    @F.arrow_udf("bigint")
    def hits(texts: pa.Array) -> pa.Array:
        return pa.array(count_keywords(texts.to_pylist(), words), pa.int64())

    return hits


BUILT_IN: dict[str, Callable[..., Column]] = {
    "length_reward": length_reward,
    "regex_format_reward": regex_format_reward,
    "contains_reward": contains_reward,
}


def parse_keywords(text: str | None) -> list[str]:
    """Keywords from comma-separated text, trimmed, without empty ones."""
    return [word.strip() for word in (text or "").split(",") if word.strip()]
