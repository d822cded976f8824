"""Secrets in texts: an Aho-Corasick prefilter, anchored regular expressions near its hits, embedded checksums.

One automaton runs over each whole text, as lower-cased UTF-8 bytes, and finds the words that an assignment
begins with, the prefixes of keys, and any four hexadecimal digits (a run of 24 holds one at its start).
Only at such a hit is the kind's regular expression tried, anchored there. Access tokens that carry a
checksum count only if it fits the rest of the token.

Matches of a kind are leftmost and do not overlap; those that fail the kind's test are dropped, but what
they cover is not searched again. Matches of different kinds may overlap.

Defined results: null and empty texts have no spans; offsets are code points, the end exclusive; texts of any
length are searched whole, once; repeated rows get equal results; other columns are the caller's own, this is
a column function; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F

from tuneloom.llm.common import worker_state

# Keywords of the kinds; what a match looks like from its keyword on.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
GITHUB = rb"gh[pousr]_([0-9A-Za-z]+)"
NPM = rb"npm_([0-9A-Za-z]+)"
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def base62_crc(data: bytes) -> bytes:
    """CRC-32 as six digits of base 62, highest first."""
    value, digits = zlib.crc32(data), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits))


def checksum_fits(match: re.Match) -> bool:
    """30 characters and their checksum in six."""
    body = match.group(1)
    return len(body) == 36 and base62_crc(body[:30]) == body[30:]


@dataclass(frozen=True)
class Kind:
    name: str
    words: tuple[str, ...]
    pattern: bytes
    holds: Callable[[re.Match], bool]


#: In the order in which spans of one start are listed; the first three are the base kinds.
KINDS = (
    Kind("assign", ASSIGN_WORDS, ASSIGN, lambda m: m.end(1) - m.start(1) >= 6),
    Kind("access", ("akia",), ACCESS, lambda m: m.end() - m.start() >= 20),
    Kind("hex", (), HEX, lambda m: m.end() - m.start() >= 24),
    Kind("github", GITHUB_WORDS, GITHUB, checksum_fits),
    Kind("npm", ("npm_",), NPM, checksum_fits),
)
BASE = 3
HEX_KIND = 2


class Scanner:
    """Finds the spans of one text; built once per worker."""

    def __init__(self):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for at, kind in enumerate(KINDS):
            for word in kind.words:
                self._automaton.add_word(word, (at, len(word)))
        for four in itertools.product("0123456789abcdef", repeat=4):
            self._automaton.add_word("".join(four), (HEX_KIND, 4))
        self._automaton.make_automaton()
        self._match = [re.compile(kind.pattern).match for kind in KINDS]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` in order."""
        data = text.encode()
        found: list[tuple[int, int, int]] = []
        searched = [0] * len(KINDS)
        for last, (kind, size) in self._automaton.iter(data.lower().decode("latin-1")):
            start = last + 1 - size
            if start < searched[kind]:
                continue
            match = self._match[kind](data, start)
            if match is not None:
                searched[kind] = match.end()
                if KINDS[kind].holds(match):
                    found.append((start, kind, match.end()))
        found.sort()
        return found if len(data) == len(text) else _code_points(data, found)


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with offsets of characters instead of bytes; the text is decoded once."""
    at, count, points = 0, 0, {}
    for edge in sorted({edge for start, _, end in spans for edge in (start, end)}):
        count += len(data[at:edge].decode())
        at, points[edge] = edge, count
    return [(points[start], kind, points[end]) for start, kind, end in spans]


def secret_spans(text: Column) -> Column:
    """Spans of secrets in ``text``, by start, then by kind in the order of ``KINDS``."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        state = worker_state("secrets")
        if "scanner" not in state:
            state["scanner"] = Scanner()
        spans = state["scanner"].spans
        rows = [
            [{"kind": KINDS[kind].name, "start": start, "end": end} for start, kind, end in spans(text.as_py() or "")]
            for text in texts
        ]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.list_(kind))

    return scan(text)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *names: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*names))
