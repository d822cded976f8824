"""SimHash near copies with BK-trees.

Fingerprints are grouped into shards that agree in one of three blocks of bits: two fingerprints that
differ in at most two bits agree in a block, so a search has to ask only the trees of its own three
shards. A shard's BK-tree keys children by their Hamming distance to the parent, and a search follows
only edges within the radius of the distance at hand. A shard's tree goes to the task that searches it
and to no other, since all trees together grow with the data. Crowded shards (many near copies agree in
a block) are split by the same rule over their remaining bits, until they are small; as fingerprints are
distinct, this always ends, and no fingerprint or link is left out.

Defined results: a text without words has fingerprint zero and is linked like any other; equal
fingerprints are one node; null ids count in no minimum; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tuneloom.llm.common import stored
from tuneloom.llm.components import components

ALL_BITS = (1 << 64) - 1
MOST_IN_A_TREE = 1000
MOST_SHINGLES = 1 << 16  # hashed and counted at a time


def shingle_hashes(words: list[bytes], n: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, in pieces of bounded size."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) < n:
        yield np.array([digest(b" ".join(words), 42)], dtype=">u8")
        return
    line = b" ".join(words)
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
    for start in range(0, len(words) - n + 1, MOST_SHINGLES):
        stop = min(start + MOST_SHINGLES, len(words) - n + 1)
        yield np.array([digest(line[a:b - 1], 42) for a, b in zip(edges[start:stop], edges[start + n:stop + n])], dtype=">u8")


def fingerprint_of(text: str | None, n: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # on bytes, both know A-Z and ASCII white space only
    return voted(shingle_hashes(words, n)) if words else 0


def voted(pieces: Iterable[np.ndarray]) -> int:
    """The bits that over half the hashes have set, as a signed 64-bit integer."""
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in pieces:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprint(text: Column, n: int = 3) -> Column:
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(text, n) for text in texts], dtype="int64")

    return fingerprints(text)


def split_bits(mask: int) -> list[int]:
    """Masks that fix the bits of ``mask`` and one third of the others each."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    return [mask | sum(1 << bit for bit in free[k::3]) for k in range(3)] if len(free) >= 3 else []


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class BkTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a value that isn't in the tree; returns its number."""
        number = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while number:
            distance = (value ^ self.values[at]).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = number
                break
            at = self.children[at][distance]
        return number

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the values at most ``radius`` bits away."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect a shard as its near pairs do: each value to its component's first one."""
    tree, parent = BkTree(), list(range(len(values)))

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    for number, value in enumerate(values):
        for near in tree.within(value, radius):
            a, b = root(near), root(number)
            parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(value, values[root(number)]) for number, value in enumerate(values) if root(number) != number]


def near_links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of distinct ``fp`` within ``radius`` (at most 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("three blocks find fingerprints that differ in up to two bits")
    rows = fingerprints.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in split_bits(0)])).alias("mask"))
    masks, found = split_bits(0), []
    while masks:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = stored(rows.groupBy("mask", "value").count().filter("count > 1"), "simhash-shards")
        small = rows.join(sizes.filter(F.col("count") <= MOST_IN_A_TREE).select("mask", "value"), ["mask", "value"], "left_semi")
        found.append(stored(_ask_trees(small, radius), "simhash-links"))
        crowded = sizes.filter(F.col("count") > MOST_IN_A_TREE)
        children = {m: split_bits(m) for m in masks}
        masks = [] if crowded.isEmpty() else [m for below in children.values() for m in below]
        if masks:
            finer = F.create_map(*[x for m, below in children.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(b)) for b in below]))])
            rows = rows.join(crowded.select("mask", "value"), ["mask", "value"], "left_semi").select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
            rows = stored(rows, "simhash-crowded")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _ask_trees(rows: DataFrame, radius: int) -> DataFrame:
    """Shards stand together in a partition; one of them at a time is held in memory."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values = None, []

        def links() -> pa.RecordBatch:
            pairs = [(signed(a), signed(b)) for a, b in shard_links(values, radius)]
            columns = [pa.array(column, pa.int64()) for column in (zip(*pairs) if pairs else ([], []))]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            for mask, value, fp in zip(*(column.to_pylist() for column in batch.columns)):
                if (mask, value) != shard:
                    if len(values) > 1:
                        yield links()
                    shard, values = (mask, value), []
                values.append(fp & ALL_BITS)
        if len(values) > 1:
            yield links()

    together = rows.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return together.mapInArrow(ask, "a long, b long")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id, root`` of every row; a component is named by its smallest id (and by its smallest fingerprint)."""
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fp")), "simhash")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    return named_rows(marked, distinct, near_links(distinct, radius))


def named_rows(marked: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``marked`` (``doc_id, fp``) with the components of links between ``fp``; ``distinct`` has each ``fp`` with its smallest id."""
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def kept_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the row with the smallest id, of several such rows one."""
    named = near_copies(docs, text, doc_id, words, radius)
    return _lowest_rows(docs, named, lambda column: fingerprint(column, words), text, doc_id)


def kept_of(docs: DataFrame, marked: DataFrame, links: DataFrame, mark: Callable[[Column], Column], text: str, doc_id: str) -> DataFrame:
    """``docs`` with one row of each component of ``links``; ``marked`` has ``doc_id, fp`` of every row, ``mark`` makes ``fp`` of a text."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "copies-distinct")
    return _lowest_rows(docs, named_rows(marked, distinct, links), mark, text, doc_id)


def _lowest_rows(docs: DataFrame, named: DataFrame, mark: Callable[[Column], Column], text: str, doc_id: str) -> DataFrame:
    named = stored(named, "copies-named")
    per_id = named.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if per_id.isEmpty():
        # Ids are unique: a row stays if it names its component.
        kept = named.filter("doc_id = component_id").select(F.col("doc_id").alias("__id"))
        return docs.join(kept, F.col(doc_id) == F.col("__id"), "left_semi")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("__id"), F.col("f.fp").alias("__of"))
    rows = docs.withColumn("__fp", mark(F.col(text)))
    rows = rows.join(first, (F.col("__fp") == F.col("__of")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("__fp", doc_id).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth", "__fp")
