"""Texts in chunks that a byte-level tokenizer treats independently, so that each distinct chunk is encoded once.

A space that follows a character other than white space always begins a new piece of the pre-tokenizer's
pattern, so the text may be cut before it. Natural text repeats its words: most chunks are then found in
a table of encoded ones, whose size is bounded by entries and by the length of an entry. A full table becomes
the older half, from which chunks that are met again come back: frequent chunks stay, those met once go.

Defined results: the empty text is one empty chunk; texts of any length are cut whole; repeated texts give equal ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK_THEN_SPACE = re.compile(r"\s ")
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"  # of the Latin blocks
MOST_ENTRIES = 300_000
MOST_CHARS = 64


def cut(text: str) -> list[str]:
    """Chunks of ``text``; each but the first has lost the space it begins with."""
    parts = text.split(" ")
    if not BLANK_THEN_SPACE.search(text):
        return parts
    chunks = parts[:1]
    for part in parts[1:]:
        # No cut before a space that follows white space; an empty chunk but the first is a space.
        last = chunks[-1]
        if last[-1].isspace() if last else len(chunks) > 1:
            chunks[-1] += " " + part
        else:
            chunks.append(part)
    return chunks


class ChunkTable:
    """Encoded ids (little-endian unsigned 32-bit) by chunk.

    ``encode(texts, known)`` turns texts into their ids; ``known`` has the ids of the chunks of the table, under the
    text that follows their space. Either half of the table holds ``most`` entries.
    """

    def __init__(self, encode: Callable[[list[str], dict[str, bytes]], list[bytes]], most: int = MOST_ENTRIES):
        self._encode, self._most = encode, most
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        chunks = _cuts(texts)
        edges = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.flatten().dictionary_encode()
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        edges -= edges[0]
        # A text's first chunk has no space before it; the others are looked up once for all texts.
        firsts = [names[i] for i in at[edges[:-1]].tolist()]
        at[edges[:-1]] = np.arange(len(names), len(names) + len(texts))
        later = np.bincount(at, minlength=len(names))[:len(names)] > 0
        wanted = set(compress(names, later.tolist()))
        missing = wanted.difference(self._recent)
        if len(self._recent) + len(missing) > self._most:
            self._recent, self._older = {}, self._recent
            missing = wanted
        table, older = self._recent, self._older
        if older:
            back = missing.intersection(older)
            table.update(zip(back, map(older.__getitem__, back)))
            missing -= back
        new = list(missing)
        table.update(zip(new, self._encode([" " + name for name in new], table)))
        rows = [table[name] if has else b"" for name, has in zip(names, later.tolist())] + self._encode(firsts, table)
        for name in new:
            if len(name) > MOST_CHARS:
                del table[name]
        joined = pa.array(rows, pa.large_binary()).take(pa.array(at))
        _, starts, data = joined.buffers()
        bounds = np.frombuffer(starts, dtype=np.int64)[edges].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(whole[a:b]) for a, b in zip(bounds, bounds[1:])]


def _cuts(texts: list[str]) -> pa.Array:
    """A list of each text's chunks, as ``cut`` makes them."""
    rows = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    odd = [i for i, text in enumerate(texts) if BLANK_THEN_SPACE.search(text)]
    if odd:
        order = np.arange(len(texts))
        order[odd] = np.arange(len(texts), len(texts) + len(odd))
        rows = pa.concat_arrays([rows, pa.array([cut(texts[i]) for i in odd], rows.type)]).take(pa.array(order))
    return rows
