"""Byte-level BPE encoding and decoding with a segment tree.

Each match of the splitting pattern is merged on its own. The leaves of its tree are byte positions; a
leaf holds the rank of the pair that starts there together with the position, so the root is the
leftmost pair of lowest rank. A merge updates the leaves of the merged pair and its live neighbours, each
in logarithmic time: a match of n bytes takes O(n log n) however long it is. The trees of short matches
are updated together, a level at a time.

Defined results: null counts as the empty text, which has no ids; repeated rows have equal ids; texts of any length are
encoded whole; an empty table gives an empty result; the coder makes columns, so columns of any name pass through.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from tuneloom.llm.chunks import LETTERS, ChunkTable
from tuneloom.llm.common import worker_state

NO_PAIR = 1 << 62
MOST_CHUNKS = 150_000  # the ranks, their hash table and the decoder stand in a worker's memory, too
#: A space, letters of the Latin blocks and one mark, which the patterns of public vocabularies take as two matches (and the word alone as one).
PLAIN_WORD = re.compile(f" {LETTERS}+[.,;:!?]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTree:
    """Minimum of ``rank << 32 | position`` over the live pairs of a byte string."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.nodes = [NO_PAIR] * self.size + values + [NO_PAIR] * (self.size - len(values))
        for at in range(self.size - 1, 0, -1):
            left, right = self.nodes[2 * at], self.nodes[2 * at + 1]
            self.nodes[at] = left if left < right else right

    def lowest(self) -> int:
        return self.nodes[1]

    def put(self, position: int, value: int) -> None:
        nodes, at = self.nodes, self.size + position
        nodes[at] = value
        at >>= 1
        while at:
            left, right = nodes[2 * at], nodes[2 * at + 1]
            low = left if left < right else right
            if nodes[at] == low:
                return
            nodes[at] = low
            at >>= 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    after = list(range(1, n + 1)) + [n]
    before = list(range(-1, n))

    def pair(start: int) -> int:
        middle = after[start]
        if middle >= n:
            return NO_PAIR
        rank = ranks.get(piece[start:after[middle]])
        return NO_PAIR if rank is None else rank << 32 | start

    tree = PairTree([pair(start) for start in range(n)])
    while (low := tree.lowest()) != NO_PAIR:
        start = low & 0xFFFFFFFF
        gone = after[start]
        after[start] = after[gone]
        before[after[gone]] = start
        tree.put(gone, NO_PAIR)
        tree.put(start, pair(start))
        if before[start] >= 0:
            tree.put(before[start], pair(before[start]))
    ids, start = [], 0
    while start < n:
        ids.append(ranks[piece[start:after[start]]])
        start = after[start]
    return ids


class Merger:
    """Merges many matches at once: a forest of trees of one size whose updates run in step, a level at a time."""

    WIDEST = 64  # longer matches have a tree of their own

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.most = ranks, len(ranks) + 1
        halves = [(ranks[t[:i]] * self.most + ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs, pair_ranks = (np.array(x, dtype=np.int64) for x in zip(*halves))
        # An open hash table: a pair stands at its slot or one of the next few.
        self.bits = len(pairs).bit_length() + 3
        self.slots, self.slot_ranks = np.full((1 << self.bits) + 64, -1), np.zeros((1 << self.bits) + 64, dtype=np.int64)
        self.reach, at, left = 0, self._slot(pairs), np.arange(len(pairs))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.slots[at[placed]], self.slot_ranks[at[placed]] = pairs[placed], pair_ranks[placed]
            left = np.setdiff1d(left, placed)
            at[left] += 1
            self.reach += 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pairs = self._ranks(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge."""
        keys = left * self.most + right
        at, found = self._slot(keys), np.full(len(keys), -1)
        for step in range(self.reach):
            hit = self.slots[at + step] == keys
            found[hit] = self.slot_ranks[at[hit] + step]
        return found

    def _values(self, left: np.ndarray, right: np.ndarray, start: np.ndarray, live: np.ndarray) -> np.ndarray:
        rank = self._ranks(left, right)
        return np.where(live & (rank >= 0), rank << 32 | start, NO_PAIR)

    def _forest(self, pieces: list[bytes], size: int) -> list[bytes]:
        n, position = np.array([len(p) for p in pieces]), np.arange(size)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, size)
        ids, pairs = self.bytes[raw], self.byte_pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        after, before = np.tile(position + 1, (len(n), 1)), np.tile(position - 1, (len(n), 1))
        alive = position < n[:, None]
        tree = np.full((len(n), 2 * size), NO_PAIR)
        tree[:, size:-1] = np.where(alive[:, 1:] & (pairs >= 0), pairs << 32 | position[:-1], NO_PAIR)
        at = size
        while at > 1:
            at //= 2
            tree[:, at:2 * at] = np.minimum(tree[:, 2 * at:4 * at:2], tree[:, 2 * at + 1:4 * at:2])

        def put(rows: np.ndarray, leaf: np.ndarray, values) -> None:
            tree[rows, leaf + size] = values
            up = (leaf + size) >> 1
            for _ in range(size.bit_length() - 1):
                tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                up >>= 1

        rows = np.arange(len(n))
        while True:
            root = tree[rows, 1]
            rows, root = rows[root != NO_PAIR], root[root != NO_PAIR]
            if not len(rows):
                break
            start = root & 0xFFFFFFFF
            gone = after[rows, start]
            following = after[rows, gone]
            ids[rows, start], after[rows, start], alive[rows, gone] = root >> 32, following, False
            more = following < n[rows]
            before[rows[more], following[more]] = start[more]
            put(rows, gone, NO_PAIR)
            put(rows, start, self._values(ids[rows, start], ids[rows, np.minimum(following, size - 1)], start, more))
            earlier = before[rows, start]
            some = earlier >= 0
            put(rows[some], earlier[some], self._values(ids[rows[some], earlier[some]], ids[rows[some], start[some]], earlier[some], True))
        flat, ends = ids[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def all(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct match."""
        found, sized = {}, {}
        for piece in set(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                found[piece] = rank.to_bytes(4, "little")
            elif len(piece) > self.WIDEST:
                ids = merge(piece, self.ranks)
                found[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                sized.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
        for size, some in sized.items():
            found.update(zip(some, self._forest(some, size)))
        return found


def encoder(ranks: dict[bytes, int], pattern: str) -> ChunkTable:
    import regex

    split, merger = regex.compile(pattern).findall, Merger(ranks)

    def cut(text: str) -> list[str]:
        word = PLAIN_WORD.fullmatch(text)
        return split(text) if word is None else [text[:-1], text[-1]]

    def encode(texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        alone = {text for text in texts if text.isascii() and text[:1] == " " and text[1:].isalpha()}
        pieces = {text: cut(text) for text in set(texts) - alone}
        parts = set().union(*pieces.values()) - alone
        ids = {part: known[part[1:]] for part in parts if part[1:] in known and part[0] == " "}
        coded = {text: text.encode() for text in (parts - ids.keys()) | alone}
        merged = merger.all(list(coded.values()))
        ids.update(zip(coded, map(merged.__getitem__, coded.values())))
        find = ids.__getitem__
        return [find(text) if text in alone else b"".join(map(find, pieces[text])) for text in texts]

    return ChunkTable(encode, MOST_CHUNKS)


DECODED_AT_ONCE = 1 << 20  # ids; a longer row is decoded in parts


def decoder(ranks: dict[bytes, int]) -> Callable[[bytes], bytes]:
    """Bytes of a row of ids: the tokens stand in one array, and a row picks its bytes from there."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    flat, sizes = np.frombuffer(b"".join(tokens), dtype=np.uint8), np.array([len(token) for token in tokens])
    starts = np.cumsum(sizes) - sizes

    def decode(row: bytes) -> bytes:
        parts, ids = [], np.frombuffer(row, dtype="<u4")
        for first in range(0, len(ids), DECODED_AT_ONCE):
            some = ids[first:first + DECODED_AT_ONCE]
            n = sizes[some]
            ends = np.cumsum(n)
            parts.append(flat[np.repeat(starts[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)

    return decode


class ByteBpe:
    """Columns of ids and of decoded bytes; the ranks travel as one broadcast of the vocabulary's size."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self._ranks = spark.sparkContext.broadcast(load_ranks(path))
        self._key = (path, pattern)

    def encode(self, text: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        coded = self._coded

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            return pd.Series(coded(texts), dtype=object)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for."""
        plain = self._plain

        @F.pandas_udf("binary")
        def decode(rows: pd.Series) -> pd.Series:
            return pd.Series(plain(rows), dtype=object)

        return decode(ids)

    def round_trip(self, text: Column) -> Column:
        """``ids`` and, from them, ``decoded`` bytes; with a column for each, Spark would encode once for either."""
        coded, plain = self._coded, self._plain

        @F.pandas_udf("ids binary, decoded binary")
        def round_trip(texts: pd.Series) -> pd.DataFrame:
            ids = coded(texts)
            return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(plain(ids), dtype=object)})

        return round_trip(text)

    @property
    def _coded(self) -> Callable[[Iterable[str | None]], list[bytes]]:
        shared, key = self._ranks, self._key

        def coded(texts: Iterable[str | None]) -> list[bytes]:
            state = worker_state(("bpe", key))
            if "encode" not in state:
                state["encode"] = encoder(shared.value, key[1])
            table, out = state["encode"], []
            rows = ["" if text is None else text for text in texts]
            for start in range(0, len(rows), 256):
                out += table.texts(rows[start:start + 256])
            return out

        return coded

    @property
    def _plain(self) -> Callable[[Iterable[bytes | None]], list[bytes]]:
        shared, key = self._ranks, self._key

        def plain(rows: Iterable[bytes | None]) -> list[bytes]:
            state = worker_state(("bpe", key))
            if "decode" not in state:
                state["decode"] = decoder(shared.value)
            return [b"" if row is None else state["decode"](row) for row in rows]

        return plain
