"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers encode the same bytes (a space and the text). Where a token of each ends at one byte, the
text can be cut. A common end near the middle of an interval is found by bisecting the other tokenizer's ends,
then both halves are treated alike; an interval without a common end is a leaf, a group of tokens that
belong together. The intervals of one depth, of many texts, are cut in step.

The number of documents that link a pair of ids is counted in two steps: within a block of documents, then over
blocks. What a block needs of the counts comes back to it, once per pair, however many documents hold it.

Defined results: texts that are null, empty, or not what their tokens spell have no tokens: counts of 0 and
no groups; texts of any length are encoded whole; repeated rows count as documents of their own; the kept
columns are in ``row``, so that no name clashes; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tuneloom.llm.common import stored, worker_state

BLOCK_BYTES = 8 << 20  # of texts whose pairs are counted together; a longer text is a block
SLICE_CHARS = 1 << 20  # of texts encoded together
STRETCH_CHARS = 1 << 20  # a longer text is encoded in parts
SAFE_CUT = re.compile(r"(?<=[^\s▁]) (?=\S)")
SHORT = 16  # an interval of so few tokens is cut at all its common ends at once
NONE = np.zeros(0, dtype=np.int64)
TOKENS = "ids_a binary, ids_b binary, cuts binary"


class Side:
    """One of the two tokenizers: ids of what follows a space, and the bytes of each id."""

    def __init__(self, encode: Callable[[str], np.ndarray], tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(token) for token in tokens], dtype=np.int64)
        #: Ids are kept in 16 bits where the vocabulary allows it.
        self.kind = np.dtype("<u2" if len(tokens) <= 1 << 16 else "<u4")
        self._encode = encode

    def ids(self, text: str) -> np.ndarray:
        """Ids of a space and ``text``; none if they spell something else."""
        ids = np.concatenate([self._encode(part) for part in stretches(text)])
        spelt = b"".join(map(self.tokens.__getitem__, ids.tolist()))
        return ids.astype(self.kind) if spelt == b" " + text.encode() else np.zeros(0, self.kind)


def stretches(text: str) -> list[str]:
    """Parts of a long text that follow a space each, cut where no token of either side goes on."""
    parts, start = [], 0
    while len(text) - start > STRETCH_CHARS and (found := SAFE_CUT.search(text, start + STRETCH_CHARS)):
        parts.append(text[start:found.start()])
        start = found.end()
    return [*parts, text[start:]]


def byte_level(path: str, pattern: str) -> Side:
    """A byte-level tokenizer file whose ids are in the order of its merges; special tokens' strings are plain text."""
    import json

    import tiktoken

    # Fixed values, the usual stand-ins: printable bytes are themselves, the others follow from U+0100 on, in order.
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merged = [model["vocab"][merge.replace(" ", "") if isinstance(merge, str) else "".join(merge)] for merge in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path!r} has ids in another order than its merges")
    special = {token for token in model["vocab"] if not all(c in byte_of for c in token)}
    ranks = {bytes(map(byte_of.__getitem__, token)): at for token, at in model["vocab"].items() if token not in special}
    if len(ranks) != len(merged) + 256:
        raise ValueError(f"{path!r} has tokens that no merge makes")
    encode = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, at in ranks.items():
        tokens[at] = token
    return Side(lambda text: encode(" " + text, disallowed_special=()), tokens)


def pieces(path: str) -> Side:
    """A sentence-piece model that puts a space before a text; no piece goes on over a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in piece.lstrip("▁") for piece in spelt):
        raise ValueError(f"{path!r} has pieces with a space inside")
    tokens = [
        bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        for i, piece in enumerate(spelt)
    ]
    return Side(lambda text: np.array(model.encode(text), dtype=np.int64), tokens)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Marks the tokens A that end where a token B ends.

    ``low`` and ``high`` bound intervals of tokens A whose last end is a common one.
    """
    marked = np.zeros(len(ends_a), dtype=bool)
    marked[high - 1] = True
    while True:
        size = high - low
        short = (size > 1) & (size <= SHORT)
        inner = np.repeat(low[short], size[short] - 1) + _counting(size[short] - 1)
        marked[inner] = ends_b[np.searchsorted(ends_b, ends_a[inner])] == ends_a[inner]
        low, high = low[size > SHORT], high[size > SHORT]
        if not len(low):
            return marked
        middle = (low + high - 2) // 2
        found = np.full(len(low), -1)
        seeking, step = np.arange(len(low)), 0
        while len(seeking):
            for at in (middle[seeking] + step, middle[seeking] - step):
                inside = (found[seeking] < 0) & (at >= low[seeking]) & (at <= high[seeking] - 2)
                ends = ends_a[at[inside]]
                common = ends_b[np.searchsorted(ends_b, ends)] == ends
                found[seeking[inside][common]] = at[inside][common]
            step += 1
            seeking = seeking[(found[seeking] < 0) & ((middle[seeking] + step <= high[seeking] - 2) | (middle[seeking] - step >= low[seeking]))]
        # Intervals without a common end are leaves.
        cut_at, low, high = found[found >= 0], low[found >= 0], high[found >= 0]
        marked[cut_at] = True
        low, high = np.stack([low, cut_at + 1], axis=1).ravel(), np.stack([cut_at + 1, high], axis=1).ravel()


def _ids(values: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of packed ids, and where each row's begin (and the last one's end)."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = [unpack(value.as_py()) if len(value.as_py()) else b"" for value in values]
    edges = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64) // kind.itemsize
    return np.frombuffer(b"".join(rows), dtype=kind).astype(np.int64), edges


def _tokenizers(path_a: str, path_b: str, pattern: str) -> tuple[Side, Side]:
    state = worker_state(("alignment", path_a, path_b, pattern))
    if "a" not in state:
        state["a"], state["b"] = byte_level(path_a, pattern), pieces(path_b)
    return state["a"], state["b"]


class Aligned:
    """Tokens of several texts: their ends over all texts, and the links between them."""

    def __init__(self, batch: dict[str, pa.Array], a: Side, b: Side):
        self.ids_a, self.edges_a = _ids(batch["ids_a"], a.kind)
        self.ids_b, self.edges_b = _ids(batch["ids_b"], b.kind)
        self.ends_a, self.ends_b = np.cumsum(a.sizes[self.ids_a]), np.cumsum(b.sizes[self.ids_b])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Key of the id pair of each link, and where each text's links begin: one link ends at each end."""
        ends = np.concatenate([self.ends_a, self.ends_b])
        ends.sort(kind="stable")
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
        keys = self.ids_a[np.searchsorted(self.ends_a, ends)] << 32 | self.ids_b[np.searchsorted(self.ends_b, ends)]
        last = np.concatenate([[0], self.ends_a])[self.edges_a]
        return keys, np.searchsorted(ends, last, side="right")

    def groups(self, cuts: list[bytes], names: tuple[np.ndarray, ...]) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text; ``names`` are the ids of A and B with each sign that may follow them."""
        a_comma, a_bar, b_comma, b_end = names
        marked = np.concatenate([np.zeros(0, bool), *(
            np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n)).astype(bool) for bits, n in zip(cuts, np.diff(self.edges_a))
        )])
        last_a = np.flatnonzero(marked)
        last_b = np.searchsorted(self.ends_b, self.ends_a[last_a])
        group_a = np.cumsum(marked) - marked
        closes_b = np.zeros(len(self.ids_b), dtype=bool)
        closes_b[last_b] = True
        group_b = np.cumsum(closes_b) - closes_b
        before = np.concatenate([[0], last_b + 1])
        out = np.empty(len(self.ids_a) + len(self.ids_b), dtype=object)
        out[np.arange(len(self.ids_a)) + before[group_a]] = np.where(marked, a_bar[self.ids_a], a_comma[self.ids_a])
        out[np.arange(len(self.ids_b)) + last_a[group_b] + 1] = np.where(closes_b, b_end[self.ids_b], b_comma[self.ids_b])
        edges = (self.edges_a + self.edges_b).tolist()
        return ["".join(out[low:high])[:-1] for low, high in zip(edges, edges[1:])]


def _encode_batches(files: tuple[str, str, str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(*files)
        pack = zstandard.ZstdCompressor(level=1).compress
        task, block, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            texts, sizes = batch.column(1), batch.column(2).to_pylist()
            first = 0
            while first < len(sizes):
                stop, chars = first, 0
                while stop < len(sizes) and (stop == first or chars + sizes[stop] <= SLICE_CHARS):
                    chars += sizes[stop]
                    stop += 1
                coded = []
                for text in texts.slice(first, stop - first).to_pylist():
                    ids_a, ids_b = (a.ids(text), b.ids(text)) if text else (NONE, NONE)
                    coded.append((pack(ids_a.tobytes()), pack(ids_b.tobytes())) if len(ids_a) and len(ids_b) else (b"", b""))
                columns = {name: pa.array([row[i] for row in coded], pa.binary()) for i, name in enumerate(("ids_a", "ids_b"))}
                both = Aligned(columns, a, b)
                low, high = both.edges_a[:-1], both.edges_a[1:]
                marked = shared_ends(both.ends_a, both.ends_b, low[high > low], high[high > low])
                bits = [np.packbits(marked[x:y]).tobytes() for x, y in zip(low.tolist(), high.tolist())]
                blocks = []
                for size in sizes[first:stop]:
                    if held and held + size > BLOCK_BYTES:
                        block, held = block + 1, 0
                    held += size
                    blocks.append(task << 32 | block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first), pa.array(blocks, pa.int64()), *columns.values(), pa.array(bits, pa.binary())],
                    names=["row", "block", "ids_a", "ids_b", "cuts"],
                )
                first = stop

    return encode


def _count_batches(files: tuple[str, str, str]):
    """Per block and pair of ids, how many documents hold it linked."""
    def counted(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, counts = np.unique(np.concatenate(held), return_counts=True)
        arrays = [pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "pair", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizers(*files)
        current, held = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if current is not None and current != blocks[low] and held:
                    yield counted(current, held)
                    held = []
                current = int(blocks[low])
                for start in range(low, high, 64):
                    some = batch.slice(start, min(64, high - start))
                    keys, first = Aligned({name: some.column(name) for name in ("ids_a", "ids_b")}, a, b).links()
                    # Each pair of a document once: ids take 48 bits at most, the document's number six.
                    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    held.append(np.unique(keys << 6 | document) >> 6)
        if held:
            yield counted(current, held)

    return count


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, or those of ``keep``), counts and ``groups``.

    ``path_a`` is a byte-level tokenizer file (JSON), whose texts ``pattern`` splits; ``path_b`` a sentence-piece
    model. ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and B group by group. ``n_links`` pairs of token occurrences
    overlap; ``n_best`` of them are of a pair that as many documents link as any pair of its A id, and
    ``count_sum`` is the sum of those numbers of documents over all links.
    """
    files = (path_a, path_b, pattern)
    row = F.struct(*[F.col(c) for c in (keep if keep is not None else docs.columns)]).alias("row")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(row, body.alias("text"), F.length(body).cast("long").alias("size"))
    schema = StructType([narrow.schema["row"], *StructType.fromDDL("block long, " + TOKENS).fields])
    tokens = stored(narrow.mapInArrow(_encode_batches(files), schema), "aligned-tokens")

    counted = tokens.filter(F.octet_length("ids_a") > 0).select("block", "ids_a", "ids_b")
    held = stored(counted.mapInArrow(_count_batches(files), "block long, pair long, n long"), "aligned-pairs")
    totals = held.groupBy("pair").agg(F.sum("n").alias("documents")).withColumn("a", F.shiftright("pair", 32))
    best = totals.groupBy("a").agg(F.max("documents").alias("most"))
    judged = totals.join(best, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
    known = held.select("block", "pair").join(judged, "pair")

    out = StructType([tokens.schema["row"], *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string").fields])
    return tokens.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_report(files), out)


def _report(files: tuple[str, str, str]):
    def names(a: Side, b: Side) -> tuple[np.ndarray, ...]:
        return tuple(np.array([f"{i}{sign}" for i in range(len(side.tokens))], dtype=object) for side, signs in ((a, ",|"), (b, ",;")) for sign in signs)

    def report(tokens: pa.Table, known: pa.Table) -> pa.Table:
        a, b = _tokenizers(*files)
        state = worker_state(("alignment", *files))
        if "names" not in state:
            state["names"] = names(a, b)
        pairs = known.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs = pairs[order]
        documents, best = known.column("documents").to_numpy()[order], known.column("best").to_numpy()[order]
        out = []
        for batch in tokens.to_batches(max_chunksize=256):
            columns = {name: batch.column(name) for name in ("ids_a", "ids_b")}
            both = Aligned(columns, a, b)
            keys, first = both.links()
            at = np.searchsorted(pairs, keys)
            sums = [np.concatenate([[0], np.cumsum(values[at] if len(at) else np.zeros(0, np.int64))])[first] for values in (best.astype(np.int64), documents)]
            groups = both.groups(batch.column("cuts").to_pylist(), state["names"])
            n_groups = [group.count(";") + 1 if group else 0 for group in groups]
            counts = [np.diff(both.edges_a), np.diff(both.edges_b), np.array(n_groups), np.diff(first), *map(np.diff, sums)]
            arrays = [batch.column("row"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(groups, pa.string())]
            out.append(pa.RecordBatch.from_arrays(arrays, names=["row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
        return pa.Table.from_batches(out)

    return report
