"""Carry a Python regular expression and its flags over to Spark's ``rlike``."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors.exceptions.captured import CapturedException

# Python flag bits that have an inline form both sides share.
INLINE_FLAGS = {re.IGNORECASE: "i", re.MULTILINE: "m", re.DOTALL: "s", re.VERBOSE: "x"}
ALLOWED_FLAGS = re.IGNORECASE | re.MULTILINE | re.DOTALL | re.VERBOSE | re.UNICODE | re.ASCII

# Python's Unicode \\s and \\w, spelled as members of a bracket.
SPACE_MEMBERS = r"\s\x1c-\x1f"
WORD_MEMBERS = r"\p{L}\p{N}_"

# One piece of a pattern: an escape, a named-group or flag opener, a quantifier in braces, or any character.
_PIECE = re.compile(
    r"\\[\s\S]|\(\?P<\w+>|\(\?P=\w+\)|\(\?\(|\(\?[aiLmsux]*-?[aiLmsux]+[:)]|\{\d+(?:,\d*)?\}|\{,\d*\}|&&|[\s\S]"
)


class NotPortable(ValueError):
    """The pattern uses something only Python's engine has."""


def to_spark_pattern(pattern: str, flags: int = 0) -> str:
    """The same search for ``rlike``: Unicode classes, and only newline ends a line."""
    if int(flags) & ~int(ALLOWED_FLAGS):
        raise ValueError(f"Unsupported regex flags {flags}; allowed are IGNORECASE, MULTILINE, DOTALL, VERBOSE, ASCII")
    re.compile(pattern, flags)
    inline = "d" + ("" if flags & re.ASCII else "U")
    inline += "".join(letter for bit, letter in INLINE_FLAGS.items() if flags & bit)
    unicode_members = {} if flags & re.ASCII else {"s": SPACE_MEMBERS, "w": WORD_MEMBERS}
    out: list[str] = []
    in_class = negated = False
    class_start = 0
    for piece in _PIECE.findall(pattern):
        letter = piece[1:] if piece.startswith("\\") else ""
        members = unicode_members.get(letter.lower())
        if piece == "(?(" or letter in ("U", "0"):
            raise NotPortable(f"{piece!r} has no counterpart: {pattern!r}")
        if in_class:
            at_start = len(out) == class_start or (len(out) == class_start + 1 and negated)
            if len(out) == class_start and piece == "^":
                negated = True
            elif piece == "]" and not at_start:
                in_class = False
            elif piece in ("[", "]") or (piece in (" ", "#") and flags & re.VERBOSE):
                piece = "\\" + piece
            elif piece == "&&":
                piece = r"\&\&"
            elif members and letter.islower():
                piece = members
            elif members and negated:
                raise NotPortable(f"{piece!r} inside a negated bracket has no counterpart: {pattern!r}")
            elif members:
                piece = f"[^{members}]"
        elif piece == "{":
            # Braces that hold no count are themselves.
            piece = r"\{"
        elif piece.startswith("{,"):
            piece = "{0" + piece[1:]
        elif piece.startswith("(?") and piece[-1] in ":)" and set(piece) & set("aLux"):
            raise NotPortable(f"{piece!r} changes what classes mean: {pattern!r}")
        elif letter == "Z":
            piece = r"\z"
        elif members:
            piece = f"[{'' if letter.islower() else '^'}{members}]"
        elif piece.startswith(("(?P<", "(?P=")):
            name = piece[4:-1]
            if not name.isascii() or not name.isalnum():
                raise NotPortable(f"Group name {name!r} has no counterpart: {pattern!r}")
            piece = f"(?<{name}>" if piece[3] == "<" else rf"\k<{name}>"
        elif piece == "[":
            in_class, negated = True, False
            class_start = len(out) + 1
        out.append(piece)
    return _compiled(f"(?{inline})" + "".join(out))


def _compiled(pattern: str) -> str:
    """``pattern``, tried once on the driver, so that what is left over fails there and not in a task."""
    context = SparkContext._active_spark_context
    if context is not None and getattr(context, "_jvm", None) is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, CapturedException) as error:
            raise NotPortable(f"No counterpart of {pattern!r}: {error}") from error
    return pattern
