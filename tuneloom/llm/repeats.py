"""Passages that repeat anywhere in the corpus, by prefix-free parsing of the texts' bytes.

Each string of ``LENGTH`` bytes has a trigger: the position of the least rolling hash among the first
``SPREAD`` of it, which depends on the string's bytes alone. Consecutive starting positions with the same
trigger are a phrase. The dictionary has a phrase's context (all bytes of the strings that start in it)
once, however often the parse uses it. What suffix arrays of dictionary and parse would be needed for here
is only to bring equal strings together; no array is built and nothing is sorted, hashes group them instead:

1. phrases are told by the hash of the ``CORE`` bytes at their trigger, which every string of the phrase holds;
   phrases whose core is nowhere else are settled, and text that never repeats ends here;
2. of the rest, contexts that occur again make all strings of their phrases repeated;
3. where one core has several contexts (at the edges of repeated passages), one phrase per context gives its bytes;
   its strings are told apart in bins of ``BIN``, by the bytes all strings of a bin hold, and where these repeat one by
   one: strings that stand under two contexts repeat.

Fingerprints have 128 bits (a core's and a string's hash of 64 bits each); rows are told apart by a 64-bit hash of id and text.

Defined results: null counts as the empty text; texts below ``LENGTH`` bytes keep all of them; rows that agree in id and
text repeat each other; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tuneloom.llm.common import discard, stored

LENGTH, CORE = 200, 64
SPREAD = LENGTH - CORE  # positions at which a core fits into a string, but for the last
BIN = 16  # strings, by their distance to the trigger
CHUNK = 1 << 20  # bytes of a text that are hashed at a time
LOW = np.uint64((1 << 30) - 1)
_MULTIPLIER = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []  # powers of the multiplier and of its inverse, per Python worker


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all substrings of a byte string in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not _POWERS or len(_POWERS[0]) <= n:
            size = max(1 << 14, 1 << n.bit_length())
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            _POWERS[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, m, dtype=np.uint64)))) for m in (_MULTIPLIER, inverse)]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(_LETTERS[data] * _POWERS[0][:n])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _POWERS[1][start])


def sliding_lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def phrases(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of ``data``: first and last start of each phrase, hash of its core, hash of its context."""
    every = np.frombuffer(data, dtype=np.uint8)
    for base in range(0, len(data) - LENGTH + 1, CHUNK):
        piece = every[base:base + CHUNK + LENGTH - 1]
        hashes, starts = Hashes(piece), len(piece) - LENGTH + 1
        at = np.arange(len(piece) - CORE + 1)
        cores = hashes.of(at, at + CORE)
        lowest = sliding_lowest(cores & ~LOW | at.astype(np.uint64), SPREAD)[:starts]
        trigger = (lowest & LOW).astype(np.int64)
        edges = np.flatnonzero(np.diff(trigger)) + 1
        first, last = np.concatenate(([0], edges)), np.concatenate((edges - 1, [starts - 1]))
        shape = ((trigger[first] - first) << 20 | (last - first)).astype(np.uint64)
        yield base + first, base + last, cores[trigger[first]], mix(hashes.of(first, last + LENGTH) ^ mix(shape + np.uint64(1)))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _parse(docs: DataFrame) -> DataFrame:
    """``rid, core, context, first, last`` of every phrase; ``docs`` has ``rid, text``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], [], []]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for first, last, core, context in phrases((text or "").encode()):
                    for column, x in zip(rows, (np.full(len(first), rid), core, context, first, last)):
                        column.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(x)) for x in rows], names=["rid", "core", "context", "first", "last"])

    return docs.select("rid", "text").mapInArrow(parse, "rid long, core long, context long, first long, last long")


def _edges(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``core, context, again, data`` of the wanted phrases: the bytes of all strings that start in one."""
    per_row = wanted.groupBy("rid").agg(F.collect_list(F.struct("core", "context", "first", "last", "again")).alias("phrases"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                rows += [(p["core"], p["context"], p["again"], data[p["first"]:p["last"] + LENGTH]) for p in listed]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["core", "context", "again", "data"])

    return docs.join(per_row, "rid").select("text", "phrases").mapInArrow(fetch, "core long, context long, again long, data binary")


def _bins(data: bytes) -> tuple[Hashes, np.ndarray, int]:
    """Hashes of a phrase's bytes, the bin of each of its strings (by distance to the trigger), and the trigger."""
    hashes, at = Hashes(np.frombuffer(data, dtype=np.uint8)), np.arange(SPREAD)
    trigger = int(at[np.argmin(hashes.of(at, at + CORE) & ~LOW | at.astype(np.uint64))])
    return hashes, (trigger - np.arange(len(data) - LENGTH + 1)) // BIN, trigger


def _binned(edges: DataFrame) -> DataFrame:
    """``core, context, bin, shared``: hash of the bytes that all strings of a bin hold, wherever the phrase begins."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], []]
            for core, context, data in zip(*(batch.column(c).to_pylist() for c in ("core", "context", "data"))):
                hashes, bins, trigger = _bins(data)
                bins = np.unique(bins)
                start = trigger - bins * BIN
                for column, x in zip(rows, (np.full(len(bins), core), np.full(len(bins), context), bins, hashes.of(start, start + LENGTH - BIN + 1))):
                    column.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(x)) for x in rows], names=["core", "context", "bin", "shared"])

    return edges.mapInArrow(spell, "core long, context long, bin long, shared long")


def _strings(edges: DataFrame) -> DataFrame:
    """``core, context, again, string, nth`` for each string in the listed ``bins``, ``nth`` from the phrase's first."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], [], []]
            for core, context, again, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("core", "context", "again", "data", "bins"))):
                hashes, bins, _ = _bins(data)
                at = np.flatnonzero(np.isin(bins, wanted))
                for column, x in zip(rows, (np.full(len(at), core), np.full(len(at), context), np.full(len(at), again), hashes.of(at, at + LENGTH), at)):
                    column.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(x)) for x in rows], names=["core", "context", "again", "string", "nth"])

    return edges.mapInArrow(spell, "core long, context long, again long, string long, nth long")


def _of_several(rows: DataFrame, *key: str) -> DataFrame:
    """Keys under which different contexts stand."""
    return rows.groupBy("core", *key).agg(F.min("context").alias("a"), F.max("context").alias("b")).filter("a <> b").select("core", *key)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``rid, starts`` (array of ``first, last``): stretches of starting positions of strings that start anywhere else as well."""
    cores = stored(_parse(docs).groupBy("core").count().filter("count > 1").select("core"), "repeats-cores")
    seen = stored(_parse(docs).join(cores, "core", "left_semi"), "repeats-phrases")
    discard(cores)
    contexts = stored(seen.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid")), "repeats-dictionary")
    several = _of_several(contexts)
    wanted = contexts.join(several, "core", "left_semi").select("core", "context", "rid", (F.col("n") > 1).cast("long").alias("again"))
    wanted = seen.join(wanted, ["core", "context", "rid"]).dropDuplicates(["core", "context"])
    edges = stored(_edges(docs, wanted), "repeats-edges")
    binned = stored(_binned(edges), "repeats-bins")
    common = binned.join(_of_several(binned, "bin", "shared"), ["core", "bin", "shared"], "left_semi")
    listed = common.groupBy("core", "context").agg(F.collect_list("bin").alias("bins"))
    strings = stored(_strings(edges.join(listed, ["core", "context"])), "repeats-strings")
    discard(edges, binned)
    same = _of_several(strings, "string")
    found = strings.filter("again = 0").join(same, ["core", "string"], "left_semi").groupBy("core", "context").agg(F.sort_array(F.collect_set("nth")).alias("nths"))
    found = stored(found, "repeats-found")
    discard(strings)
    whole = seen.join(contexts.filter("n > 1").select("core", "context"), ["core", "context"], "left_semi").select("rid", "first", "last")
    parts = seen.join(found, ["core", "context"]).select("rid", "first", F.explode("nths").alias("nth"))
    starts = whole.unionByName(parts.select("rid", (F.col("first") + F.col("nth")).alias("first"), (F.col("first") + F.col("nth")).alias("last")))
    per_row = stored(starts.distinct().groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("starts")), "repeats-starts")
    discard(seen, contexts, found)
    return per_row


def removed_spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings starting at ``starts`` cover."""
    spans: list[list[int]] = []
    for first, last in sorted(starts):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + LENGTH)
        else:
            spans.append([first, last + LENGTH])
    return [(a, b) for a, b in spans]


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns, or those of ``keep``), ``n_bytes, n_removed, n_spans, spans, kept`` (bytes)."""
    rid = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(F.struct(*[F.col(c) for c in (keep if keep is not None else docs.columns)]).alias("row"), rid.alias("rid"), F.col(text).alias("text"))
    per_row = repeated_starts(rows.select("rid", "text"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
    def cut(texts, starts):
        import pandas as pd

        out = []
        for text, listed in zip(texts, starts):
            data = ("" if text is None else text).encode()
            spans = removed_spans([(s["first"], s["last"]) for s in listed]) if listed is not None else []
            edges = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(data), len(data) - len(kept), len(spans), [{"start": a, "end": b} for a, b in spans], kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.join(per_row, "rid", "left").select("row", cut("text", "starts").alias("c")).select("row", "c.*")
