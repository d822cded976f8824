"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is the payload's length (8 bytes), the masked checksum of those bytes (4), the payload (ids as
little-endian unsigned integers, of 2 bytes where the vocabulary allows it, else of 4) and its masked checksum (4). Checksums are CRC-32 (zlib), masked
by a rotation and an offset so that checksums stored inside checksummed data stay harmless. Each task
writes one file for its stretch of ids; the index, a Parquet table, has a record's file, offset and
length. A repeated or speculative task writes a file of its own, and only the files of tasks that Spark
committed are in the index, so a lost executor leaves at worst a file nobody refers to.

Defined results: a null text is empty and has the end id only; null ids come first; rows that agree in
id stand in any order next to each other; an empty table gives an empty index.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tuneloom.llm.chunks import LETTERS, ChunkTable
from tuneloom.llm.common import worker_state

MASK_DELTA = 0xA282EAD8
#: A space, letters of the Latin blocks, marks, and letters of a next line: where one meets another, byte-level patterns begin a new piece.
MARKED = re.compile(f"( {LETTERS}+)([!-/:-@\\[-`{{-~]+)(\n{LETTERS}+)?")
#: A space and letters that stand for themselves in a byte-level vocabulary: one piece of the pattern.
LATIN_WORD = re.compile(" [A-Za-z]+")
MOST_MARKS = 10_000
INDEX_SCHEMA = "doc_id {kind}, part int, file string, offset long, bytes long, n_tokens long, before long, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of a record; raises if a length or checksum is off."""
    if len(record) < 16 or struct.unpack("<I", record[8:12])[0] != masked(record[:8]):
        raise ValueError("damaged record length")
    payload = record[12:-4]
    if struct.unpack("<Q", record[:8])[0] != len(payload) or struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def _file_system(path: str):
    """A file system that driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it, so that record files stand beside the index whatever the default file system is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def library_table(tokenizer_path: str) -> ChunkTable:
    """Encodes chunks with the tokenizers library, many per call."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer, plain = Tokenizer.from_file(tokenizer_path), Tokenizer.from_file(tokenizer_path)
    for one in (tokenizer, plain):
        if hasattr(one.model, "_resize_cache"):
            one.model._resize_cache(0)  # the chunk table is the cache; a second one only costs
    # Takes pieces that are known to be whole, in the characters that stand for their bytes.
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    sizes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=np.int64)
    for token, at in vocabulary.items():
        sizes[at] = len(token)  # one character stands for one byte
    for at, token in tokenizer.get_added_tokens_decoder().items():
        sizes[at] = len(token.content.encode())

    def batch(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in found]

    def strung(texts: list[str], words: bool = False) -> list[bytes]:
        """Ids of texts that begin with a blank and have no other: strung together they stay apart. ``words`` are one piece each."""
        out: list[bytes] = []
        groups = [texts[start:start + 256] for start in range(0, len(texts), 256)]
        lines = ["".join(group) for group in groups]
        if words:
            lines = [line.replace(" ", " \u0120") for line in lines]
        for group, joined in zip(groups, (plain if words else tokenizer).encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(joined.ids, dtype="<u4")
            ends = np.cumsum(sizes[ids])
            edges = np.cumsum([len(text) if text.isascii() else len(text.encode()) for text in group])
            at = np.searchsorted(ends, edges)
            if len(ids) and (ends[np.minimum(at, len(ends) - 1)] == edges).all():
                stops, data = (4 * at + 4).tolist(), ids.tobytes()
                out += [data[start:stop] for start, stop in zip([0, *stops], stops)]
            else:
                out += batch(group)
        return out

    marks: dict[str, bytes] = {}

    def encode(texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        # A word, marks and the first word of a next line are pieces of their own; many of the words are known.
        cuts, alone, wanted, latin = {}, {}, set(), set()
        for text in texts:
            if LATIN_WORD.fullmatch(text):
                latin.add(text)
            elif text[:1] == " " and text[1:].isalpha():
                wanted.add(text)
            elif found := MARKED.fullmatch(text):
                cuts[text] = found.groups()
            elif text[:1] == " " and text.split() == [text[1:]]:
                wanted.add(text)
            else:
                alone[text] = b""
        alone.update(zip(alone, batch(list(alone))))
        new = {mark for _, mark, _ in cuts.values()} - marks.keys()
        if len(marks) + len(new) > MOST_MARKS:
            marks.clear()
            new = {mark for _, mark, _ in cuts.values()}
        marks.update(zip(new, batch(list(new))))
        for part in {word for word, _, _ in cuts.values() if word[1:] not in known}.union(line for _, _, line in cuts.values() if line):
            (latin if LATIN_WORD.fullmatch(part) else wanted).add(part)
        coded = {}
        for some, words in ((list(latin), True), (list(wanted), False)):
            coded.update(zip(some, strung(some, words)))
        coded[None] = b""
        for text, (word, mark, line) in cuts.items():
            coded[text] = (coded.get(word) or known[word[1:]]) + marks[mark] + coded[line]
        coded.update(alone)
        return [coded[text] for text in texts]

    table = ChunkTable(encode)
    table.width = 2 if len(sizes) <= 1 << 16 else 4
    return table


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode ``docs`` into record files below ``path``, in ascending order of ``doc_id``, and index them."""
    kind = docs.schema[doc_id].dataType.simpleString()
    end = struct.pack("<I", end_id)
    root, rows = f"{qualified(docs.sparkSession, path)}/records", 1024

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        state = worker_state(("records", tokenizer_path))
        if "table" not in state:
            state["table"] = library_table(tokenizer_path)
        table, out, offset, before = state["table"], None, 0, 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    piece = batch.slice(start, rows)
                    texts = ["" if text is None else text for text in piece.column(1).to_pylist()]
                    index = []
                    for ids in table.texts(texts):
                        whole = np.frombuffer(ids + end, dtype="<u4")
                        record = frame(whole.astype(f"<u{table.width}").tobytes())
                        if out is None:
                            system, where = _file_system(root)
                            system.create_dir(where, recursive=True)
                            out = system.open_output_stream(f"{where}/{name}")
                        out.write(record)
                        n = len(whole)
                        index.append((offset, len(record), n, before))
                        offset, before = offset + len(record), before + n
                    n = piece.num_rows
                    longs = [pa.array(column, pa.int64()) for column in zip(*index)]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n, pa.string()), *longs, pa.array([table.width] * n, pa.int32())],
                        names=["doc_id", "part", "file", "offset", "bytes", "n_tokens", "before", "width"],
                    )
        finally:
            if out is not None:
                out.close()

    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, INDEX_SCHEMA.format(kind=kind)).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``start``: ids of all records before one."""
    index = spark.read.parquet(f"{path}/index")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    # One row per file, no more than the tasks that wrote.
    return index.join(F.broadcast(parts), "part").withColumn("start", F.col("__start") + F.col("before")).drop("__start", "before")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """Rows of an index, or of any selection or order of it, with the ``ids`` in their record (as unsigned 32-bit integers)."""
    root, schema = f"{qualified(index.sparkSession, path)}/records", StructType([*index.schema.fields, StructField("ids", BinaryType())])
    at = {name: index.columns.index(name) for name in ("file", "offset", "bytes", "width")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _file_system(root)
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                ids = []
                for file, offset, size, width in zip(*(piece.column(i).to_pylist() for i in at.values())):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, system.open_input_file(f"{where}/{file}")
                    ids.append(np.frombuffer(unframe(source.read_at(size, offset)), dtype=f"<u{width}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, "ids"])

    return index.mapInArrow(read, schema)
