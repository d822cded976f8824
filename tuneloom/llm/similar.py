"""Near copies by the share of common shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's set is put in one order for all texts (by the number of sets that hold a shingle, the rest by hash), and its
first fifth and one more are its prefix: two sets that reach the similarity share a shingle of their prefixes, so
every such pair stands in a bucket of equal shingles, and no probability is involved. Where a fifth of a set is in no
other set, its prefix holds nothing else and the text takes no further part.

The numbers are counted over all texts. Chunks of texts send their shingles, cut to ``TOKEN_BITS`` bits and packed, to
buckets of equal shingles; buckets send back what is in several sets, and each chunk cuts its prefixes. What many texts
of a sample hold comes last by its number there and is not sent. Shingles that agree in their first bits count as one,
in every set alike: sets then have no less in common than before, next to their sizes, so all bounds hold.

A pair is confirmed on the whole texts, after two bounds that hold for every similar pair: of the sizes, and of the
number of shingles that the prefixes have in common.

SimHash goes first: texts whose fingerprints (of the same shingles, repeats included) are equal or found within
``RADIUS`` bits by the BK-trees meet, and what is confirmed are the first links. Fingerprints of sets of similarity 0.8
differ in some ten bits, so the buckets find the rest. Large groups do not meet pair by pair: in ``STARS`` rounds each
bucket's members that no link connects yet are compared with one of them only; then, as long as all such pairs of a
bucket are more than its rows, one member of each component with one of each other; then all such pairs. What is left out are pairs of one component, so components are those of all similar pairs.

Defined results: fewer than five words are one shingle; texts without words are one node; equal sets are one node
(told by 64 bits of hash); null ids count in no minimum; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from tuneloom.llm.common import discard, grouped, stored, stretches
from tuneloom.llm.components import components
from tuneloom.llm.simhash import kept_of, near_links, shingle_hashes, voted

WORDS, RADIUS = 5, 2
STARS, MEETINGS = 2, 2
SAMPLE_ROWS, LEAST_IN_SAMPLE, MOST_FREQUENT = 2000, 10, 100_000  # only the order depends on them, not the result
TOKEN_BITS, LOW_BITS = 40, 24  # of a shingle's hash, and of these the ones that are sent for each shingle
CHUNK_TOKENS, CHUNK_TEXTS, BUCKET_BYTES = 1 << 20, 1 << 16, 6 << 20  # bytes of text whose shingles are counted together
MOST_BUCKETS, MOST_COUNTED = 1 << TOKEN_BITS - LOW_BITS, (1 << 16) - 1


def hashes_of(text: str | None) -> list[np.ndarray]:
    """Hashes of the shingles, repeats included, in pieces."""
    words = (text or "").encode().lower().split()
    return list(shingle_hashes(words, WORDS)) if words else []


def distinct_hashes(pieces: list[np.ndarray]) -> np.ndarray:
    """In order."""
    return np.unique(np.concatenate([h.astype(np.uint64) for h in pieces])) if pieces else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes in order."""
    return distinct_hashes(hashes_of(text))


def prefix_size(n: int) -> int:
    """A set of ``n`` shares at least four fifths of its own with a similar one, so one of any so many."""
    return n - -(-4 * n // 5) + 1 if n else 0


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(shingles.tobytes()), dtype=np.uint64).view(np.int64)) if len(shingles) else 0


def node(text: Column) -> Column:
    @F.pandas_udf("long")
    def nodes(texts: pd.Series) -> pd.Series:
        return pd.Series([node_of(shingle_set(text)) for text in texts], dtype="int64")

    return nodes(text)


def tokens_of(shingles: np.ndarray) -> np.ndarray:
    """The first bits of hashes in order, each value once."""
    tokens = shingles >> np.uint64(64 - TOKEN_BITS)
    return tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))] if len(tokens) else tokens


def frequent_tokens(texts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many texts of a sample of the ``count`` texts hold, in order, and how many hold them."""
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, count // SAMPLE_ROWS))) == 0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(tokens_of(shingle_set(text)).view(np.int64))], names=["token"])

    counted = sample.select("text").mapInArrow(each, "token long").groupBy("token").count().filter(F.col("count") >= LEAST_IN_SAMPLE)
    rows = sorted(counted.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).collect())
    return np.array([r["token"] for r in rows], dtype=np.uint64), np.array([r["count"] for r in rows], dtype=np.int64)


def _packed(tokens: np.ndarray, texts: np.ndarray) -> bytes:
    """Tokens in order and the number of the text of each."""
    high, n = np.unique(tokens >> np.uint64(LOW_BITS), return_counts=True)
    low = tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return b"".join(x.tobytes() for x in (np.array([len(tokens), len(high)], "<u4"), high.astype("<u2"), n.astype("<u4"), low, texts.astype("<u2")))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(data, "<u4", 2))
    high, counts = np.frombuffer(data, "<u2", k, 8), np.frombuffer(data, "<u4", k, 8 + 2 * k)
    low = np.zeros((n, 4), dtype=np.uint8)
    low[:, :3] = np.frombuffer(data, np.uint8, 3 * n, 8 + 6 * k).reshape(n, 3)
    tokens = np.repeat(high.astype(np.uint64) << np.uint64(LOW_BITS), counts) | low.view("<u4").ravel()
    return tokens, np.frombuffer(data, "<u2", n, 8 + 6 * k + 3 * n)


def read_texts(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """``doc_id, rid, node, n, fp`` of ``doc_id, rid, text``, and besides these rows ``chunk, bucket, data`` of their shingles.

    In bucket -1 a chunk has its nodes, their sizes, how many shingles of each are counted, and of the frequent ones
    those that stand in its prefix whatever the counts are.
    """
    often, held_by = frequent

    def sides(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokens = tokens_of(shingles)
        if not len(often):
            return tokens, tokens[:0]
        at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
        late = often[at] == tokens
        last = tokens[late][np.argsort(held_by[at[late]], kind="stable")]
        return tokens[~late], last[:max(0, prefix_size(len(shingles)) - (len(tokens) - len(last)))]

    def packed(layout: pa.Schema, number: int, sets: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        sizes, early, late = zip(*sets.values())
        lengths = [[len(x) for x in each] for each in (early, late)]
        head = np.concatenate([[len(sets)], list(sets), sizes, *lengths, *[x.view(np.int64) for x in late]]).astype("<i8")
        tokens, texts = np.concatenate(early), np.repeat(np.arange(len(sets)), lengths[0])
        order = np.argsort(tokens, kind="stable")
        tokens, texts = tokens[order], texts[order]
        bucket = ((tokens >> np.uint64(LOW_BITS)) * np.uint64(buckets) // np.uint64(MOST_BUCKETS)).astype(np.int32)
        spans = list(stretches(bucket)) if len(bucket) else []
        data = [head.tobytes(), *(_packed(tokens[a:b], texts[a:b]) for a, b in spans)]
        yield batch_of(layout, len(data), chunk=pa.array([number] * len(data)), bucket=pa.array([-1, *(int(bucket[a]) for a, _ in spans)], pa.int32()), data=pa.array(data))

    def batch_of(layout: pa.Schema, height: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(height, f.type) for f in layout], schema=layout)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sets, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            layout = pa.schema([("doc_id", ids), ("rid", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
            marks = []
            for text in batch.column("text").to_pylist():
                pieces = hashes_of(text)
                found = distinct_hashes(pieces)
                marks.append((node_of(found), len(found), voted(pieces) if pieces else 0))
                if len(found) and marks[-1][0] not in sets:
                    sets[marks[-1][0]] = (len(found), *sides(found))
                    size += len(found)
                if size >= CHUNK_TOKENS or len(sets) == CHUNK_TEXTS:
                    yield from packed(layout, number, sets)
                    number, sets, size = number + 1, {}, 0
            node, n, fp = zip(*marks) if marks else ([], [], [])
            yield batch_of(layout, len(marks), doc_id=batch.column("doc_id"), rid=batch.column("rid"), node=pa.array(node, pa.int64()), n=pa.array(n, pa.int32()), fp=pa.array(fp, pa.int64()))
        if sets:
            yield from packed(layout, number, sets)

    schema = StructType().add("doc_id", rows.schema["doc_id"].dataType)
    for name, kind in {"rid": LongType(), "node": LongType(), "n": IntegerType(), "fp": LongType(), "chunk": LongType(), "bucket": IntegerType(), "data": BinaryType()}.items():
        schema = schema.add(name, kind)
    return rows.select("doc_id", "rid", "text").mapInArrow(read, schema)


REPEATED = np.dtype([("text", "<u2"), ("count", "<u2"), ("low", "<u4"), ("high", "u1")])


def repeated_tokens(packed: DataFrame) -> DataFrame:
    """``chunk, data``: of the tokens in ``chunk, bucket, data``, those that several sets hold, with their numbers (``REPEATED``)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            bucket, chunk = table.column("bucket").to_numpy(), table.column("chunk").to_numpy()
            for a, b in stretches(bucket):
                tokens, texts = zip(*map(_unpacked, table.column("data").slice(a, b - a).to_pylist()))
                of = np.repeat(np.arange(a, b), [len(x) for x in tokens])
                tokens, texts = np.concatenate(tokens), np.concatenate(texts)
                order = np.argsort(tokens, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], np.diff(tokens[order]) != 0, [True])))
                count = np.repeat(np.diff(edges), np.diff(edges))
                at = order[count > 1]
                out = np.empty(len(at), dtype=REPEATED)
                out["text"], out["count"] = texts[at], np.minimum(count[count > 1], MOST_COUNTED)
                out["low"], out["high"] = tokens[at] & np.uint64(0xFFFFFFFF), tokens[at] >> np.uint64(32)
                by_chunk = np.argsort(of[at], kind="stable")
                out, of = out[by_chunk], of[at][by_chunk]
                spans = list(stretches(of)) if len(of) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk[of[i]] for i, _ in spans], pa.int64()), pa.array([out[i:j].tobytes() for i, j in spans], pa.binary())], names=["chunk", "data"])

    return packed.select("bucket", "chunk", "data").repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(find, "chunk long, data binary")


def prefixes(heads: DataFrame, repeated: DataFrame) -> DataFrame:
    """``node, n, prefix, start``: what other sets may hold of each prefix, and how many stand before it; without the sets whose prefix has nothing of that."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches):
            data = table.column("data").to_pylist()
            for a, b in stretches(table.column("chunk").to_numpy()):
                head = np.frombuffer(data[a], "<i8")
                node, size, early, late = head[1:1 + 4 * head[0]].reshape(4, -1)
                last = head[1 + 4 * head[0]:]
                found = np.frombuffer(b"".join(data[a + 1:b]), REPEATED)
                text, token = found["text"].astype(np.int64), found["high"].astype(np.int64) << 32 | found["low"]
                order = np.lexsort((token, found["count"], text))
                text, token = text[order], token[order]
                several = np.bincount(text, minlength=len(node))
                alone = early - several
                want = np.array([prefix_size(int(n)) for n in size]) - alone
                nth = np.arange(len(text)) - np.repeat(np.cumsum(several) - several, several)
                first = nth < want[text]
                # Both parts of a prefix, the counted one before the frequent.
                text = np.concatenate((text[first], np.repeat(np.arange(len(node)), late)))
                token = np.concatenate((token[first], last))[np.argsort(text, kind="stable")]
                lengths = np.bincount(text, minlength=len(node))
                some = lengths > 0
                offsets = np.concatenate(([0], np.cumsum(lengths[some]))).astype(np.int32)
                numbers = [pa.array(x[some].astype(np.int32)) for x in (size, alone)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), numbers[0], pa.ListArray.from_arrays(pa.array(offsets), pa.array(token)), numbers[1]], names=["node", "n", "prefix", "start"])

    both = heads.select("chunk", F.lit(0).alias("kind"), "data").unionByName(repeated.select("chunk", F.lit(1).alias("kind"), "data"))
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(cut, "node long, n int, prefix array<long>, start int")


def least_shared(n: Column, m: Column) -> Column:
    """Prefix shingles that similar sets of ``n`` and ``m`` share at least.

    They have four ninths of ``n + m`` in common. Of the prefix that ends first in the order, what the other set
    holds is in that one's prefix, and only so many can be missing as are not common.
    """
    common = F.ceil((n + m) * 4 / F.lit(9.0) - 1e-6)
    own = [x - F.ceil(x * 4 / F.lit(5.0) - 1e-6) + 1 - (x - common) for x in (n, m)]
    return F.greatest(F.least(*own), F.lit(1))


def _likely(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose prefixes have as many shingles in common as similar ones have."""
    sides = [held.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.filter(F.size(F.array_intersect("shared_a.token", "shared_b.token")) >= least_shared(F.col("n_a"), F.col("n_b"))).select("a", "b")


def _confirmed(likely: DataFrame, texts: DataFrame) -> DataFrame:
    """The similar ones of the pairs ``a, b``."""
    for x in "ab":
        likely = likely.join(texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), x)

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        last, out = ("", shingle_set("")), []
        for a, b in zip(left, right):
            if a != last[0]:
                last = (a, shingle_set(a))
            found = shingle_set(b)
            common = len(np.intersect1d(last[1], found, assume_unique=True))
            out.append(5 * common >= 4 * (len(last[1]) + len(found) - common))
        return pd.Series(out, dtype=bool)

    return likely.filter(similar("text_a", "text_b")).select("a", "b")


def _possible(a: str, b: str) -> Column:
    """Whether sizes and numbers of repeated prefix shingles allow two members of a bucket to be similar."""
    n, m, most = F.col(f"{a}.n"), F.col(f"{b}.n"), F.least(F.col(f"{a}.repeated"), F.col(f"{b}.repeated"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (most >= least_shared(n, m))


def _ranges_allow(x: str, y: str) -> Column:
    """Whether two components in a bucket can have members for which ``_possible`` holds, by the ranges ``low, high, repeated`` of theirs."""
    low, high = ([F.col(f"{side}.{name}") for side in (x, y)] for name in ("low", "high"))
    sizes = (5 * high[0] >= 4 * low[1]) & (5 * high[1] >= 4 * low[0])
    # ``least_shared`` without its rounding: less, the larger the one set and the smaller the other is.
    least = F.least(*[(large + small) * 4 / F.lit(9.0) - large * 4 / F.lit(5.0) for large, small in ((high[0], low[1]), (high[1], low[0]))])
    return sizes & (F.least(F.col(f"{x}.repeated"), F.col(f"{y}.repeated")) >= least - 1e-6)


def reach(n: Column, place: Column) -> Column:
    """The size of the largest set that a set of ``n`` has to be compared with for its shingle in that ``place`` (from 0).

    Similar sets of ``n`` and ``m`` have four ninths of ``n + m`` in common, so they share one of the first of either that remain without so many.
    """
    return F.floor((5 * n - 9 * place) / F.lit(4.0)).cast("int")


def _within_reach(x: str, y: str) -> Column:
    """Whether two components in a bucket can have members that must be compared for its shingle, by the ranges ``low, reach`` of theirs."""
    return (F.col(f"{y}.low") <= F.col(f"{x}.reach")) & (F.col(f"{x}.low") <= F.col(f"{y}.reach"))


def fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """Nodes ``a, b`` that SimHash takes for near copies: a fingerprint's first node and each of its others, and the first ones of two near fingerprints."""
    nodes = stored(marked.select("fp", "node").distinct(), "similar-fingerprints")
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "similar-first")
    equal = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = near_links(first.select("fp"), RADIUS).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    for x in "ab":
        near = near.join(first.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x)), f"fp_{x}")
    return equal.unionByName(near.select("a", "b"))


def similar_links(marked: DataFrame, prefixed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` whose components are those of all similar nodes; ``marked`` has ``rid, node, fp``, ``prefixed`` ``node, n, prefix`` (stored tables that go), ``docs`` ``rid, text``."""
    tokens = prefixed.select("node", "n", "start", F.posexplode("prefix").alias("place", "token"))
    tokens = tokens.select("node", "n", "token", reach(F.col("n"), F.col("start") + F.col("place")).alias("reach"))
    several = tokens.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("token")
    shared = stored(tokens.join(several, "token", "left_semi").distinct(), "similar-shared")
    held = stored(shared.groupBy("node", "n").agg(F.collect_list(F.struct("token", "reach")).alias("shared")), "similar-held")
    discard(shared, prefixed)
    rows = held.select("node", "n", F.col("n").alias("low"), F.col("n").alias("high"), F.size("shared").alias("repeated"), F.inline("shared"))
    wanted = marked.join(held.select("node"), "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid"))
    # Rows that agree in id and text stand in one partition by the join.
    texts = stored(docs.join(wanted, "rid").dropDuplicates(["rid", "node"]).select("node", "text"), "similar-texts")

    links, tested = _more(fingerprint_pairs(marked), None, None, held, texts)
    discard(marked)
    for star in range(STARS):
        named = _rooted(rows, links)
        # One that is to be compared with sets of its own size.
        deal = F.struct(F.col("reach") < F.col("n"), F.xxhash64(F.lit(star), "node"))
        lead = named.groupBy("token").agg(F.min_by(F.struct("node", "root", "n", "low", "repeated", "reach"), deal).alias("lead")).select("token", "lead.*")
        met = lead.alias("x").join(named.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y") & _within_reach("x", "y"))
        links, tested = _more(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), links, tested, held, texts)
    # What sizes, shared shingles and their places forbid is ruled out in the joins, before anything of a pair is shuffled.
    allowed = _ranges_allow("x", "y") & _within_reach("x", "y")
    for meeting in range(MEETINGS + 1):
        named = stored(_rooted(rows, links), "similar-rooted")
        ranges = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("repeated").alias("repeated"), F.max("reach").alias("reach")]
        deal = F.struct(F.col("reach") < F.col("n"), F.xxhash64(F.lit(meeting), "node", "token"))
        lead = F.min_by(F.struct("node", "n", "low", "repeated", "reach"), deal).alias("lead")
        sorts = stored(named.groupBy("token", "root").agg(F.count(F.lit(1)).alias("members"), lead, *ranges), "similar-roots")
        mixed = sorts.groupBy("token").count().filter("count > 1").select("token")
        several = sorts.join(mixed, "token", "left_semi")
        apart = several.alias("x").join(several.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & allowed)
        names = ("low", "high", "repeated", "reach", "members", "lead")
        apart = stored(apart.select("x.token", "x.root", F.col("y.root").alias("other"), *[f"y.{x}" for x in names], *[F.col(f"x.{x}").alias(f"own_{x}") for x in names[-2:]]), "similar-apart")
        # As long as all members of the components make too many pairs, one of each is compared.
        if meeting == MEETINGS or (apart.agg(F.sum(F.col("members") * F.col("own_members"))).first()[0] or 0) <= named.count():
            break
        met = apart.filter(_possible("own_lead", "lead") & _within_reach("own_lead", "lead"))
        links, tested = _more(met.select(F.col("own_lead.node").alias("a"), F.col("lead.node").alias("b")), links, tested, held, texts)
        discard(named, sorts, apart)
    met = named.alias("x").join(apart.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") == F.col("y.root")) & allowed)
    met = met.select("x.*", "y.other").drop("root").alias("x").join(
        named.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.other") == F.col("y.root")) & _possible("x", "y") & _within_reach("x", "y"))
    links, tested = _more(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), links, tested, held, texts)
    discard(held, named, sorts, apart, texts)
    return links


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(components(links), "node", "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))


def _more(met: DataFrame, links: DataFrame | None, tested: DataFrame | None, held: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and tested pairs with those of ``met`` added."""
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = stored(pairs, "similar-pairs")
    found = stored(_confirmed(_likely(pairs, held), texts), "similar-links")
    return (found, pairs) if links is None else (links.unionByName(found), tested.unionByName(pairs))


def kept_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the row with the smallest id, of several such rows one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("rid"))
    count, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    read = stored(read_texts(rows, frequent_tokens(rows, count), min(MOST_BUCKETS, 1 + (size or 0) // BUCKET_BYTES)), "similar-read")
    marked = stored(read.filter("bucket is null").select("doc_id", "rid", "node", "fp"), "similar")
    packed = read.filter("bucket is not null").select("chunk", "bucket", "data")
    repeated = stored(repeated_tokens(packed.filter("bucket >= 0")), "similar-repeated")
    prefixed = stored(prefixes(packed.filter("bucket < 0"), repeated), "similar-prefixes")
    discard(read, repeated)
    nodes = stored(marked.select("doc_id", F.col("node").alias("fp")), "similar-nodes")
    links = similar_links(marked, prefixed, rows.select("rid", "text"))
    return kept_of(docs, nodes, links, node, text, doc_id)
