import base64
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF, plan
from odd_rows import no_docs, odd_docs  # noqa: F401
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tuneloom.llm import bpe, records
from tuneloom.llm.chunks import _cuts, cut
from tuneloom.llm.queries import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", " ", "\n", "\t", "a", "b", "é", "1", "23", "'s", "'S", "!", "..", "中", "　", "\x1c", "\x85", "​", "🙂", "the", "ing"]


@pytest.fixture(scope="module")
def tables():
    ranks = bpe.load_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.encoder(ranks, public_tokenizers.PATTERN), own, records.library_table(LIBRARY), Tokenizer.from_file(LIBRARY)


def ids(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def agree(tables, texts):
    mine, own, theirs, library = tables
    for text, a, b in zip(texts, mine.texts(texts), theirs.texts(texts)):
        assert ids(a) == own.encode_ordinary(text)
        assert ids(b) == library.encode(text, add_special_tokens=False).ids


def test_like_the_libraries(tables):
    deal = random.Random(3)
    agree(tables, ["".join(deal.choice(PIECES) for _ in range(deal.randint(0, 14))) for _ in range(3000)])
    agree(tables, ["", " ", "  ", "   a", "a   b ", "\n \n", "x" * 5000, "ab" * 3000, "word " * 3000, "<|endoftext|> a"[:-3]])
    agree(tables, ["word " * 3 + "x" * n + "zq" * n for n in range(1, 80)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(tables, texts):
    agree(tables, texts)


@given(st.text(alphabet=" \n\ta", max_size=12))
def test_chunks_join_to_the_text(text):
    assert " ".join(cut(text)) == text


@settings(deadline=None)
@given(st.lists(st.text(alphabet=" \n\taé\u3000\x1c", max_size=12), min_size=1, max_size=6))
def test_chunks_of_many_texts_at_once(texts):
    assert _cuts(texts).to_pylist() == [cut(text) for text in texts]


def test_looks_up_a_chunk_once_for_all_texts_of_a_call(tables):
    class Counted(dict):
        def __getitem__(self, key):
            looked.append(key)
            return dict.__getitem__(self, key)

    looked, table = [], records.library_table(LIBRARY)
    table._recent = Counted()
    texts = ["the word  the\nword and the word"] * 50 + ["and the", "", "the"]
    assert [ids(data) for data in table.texts(texts)] == [tables[3].encode(text, add_special_tokens=False).ids for text in texts]
    assert len(looked) == len(set(looked)) > 3


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=90))
def test_forest_and_tree_agree(tables, piece):
    ranks = bpe.load_ranks(RANKS) if not hasattr(test_forest_and_tree_agree, "m") else None
    merger = test_forest_and_tree_agree.__dict__.setdefault("m", bpe.Merger(ranks) if ranks else None)
    assert ids(merger.all([piece])[piece]) == bpe.merge(piece, merger.ranks)


def test_tree_gives_the_leftmost_lowest():
    deal = random.Random(5)
    for n in (1, 2, 3, 8, 33):
        values = [deal.randint(0, 5) << 32 | i for i in range(n)]
        tree = bpe.PairTree(values[:])
        for _ in range(50):
            assert tree.lowest() == min(values)
            i = deal.randrange(n)
            values[i] = deal.choice([bpe.NO_PAIR, deal.randint(0, 5) << 32 | i])
            tree.put(i, values[i])


def test_round_trip_of_odd_rows(spark, odd_docs, no_docs):
    coder = byte_bpe(spark)
    for docs in (odd_docs, no_docs):
        coded = docs.withColumn("ids", coder.encode(F.col("text")))
        decoded = coded.withColumn("again", coder.decode(F.col("ids")).cast("string"))
        assert decoded.filter("again <> coalesce(text, '')").isEmpty() and decoded.count() == docs.count()


def expected(docs, library):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    return [(i, [*library.encode(text or "", add_special_tokens=False).ids, 0]) for i, text in order]


def test_records_of_odd_rows(spark, odd_docs, no_docs, tables, tmp_path):
    path = str(tmp_path / "records")
    records.write_records(odd_docs, path, LIBRARY)
    index = records.read_index(spark, path)
    rows = sorted(records.read_records(index, path).collect(), key=lambda r: r["start"])
    want = expected([(r["doc_id"], r["text"]) for r in odd_docs.collect()], tables[3])
    assert [r["doc_id"] for r in rows] == [i for i, _ in want]
    assert sorted(map(tuple, (ids(r["ids"]) for r in rows))) == sorted(tuple(x) for _, x in want)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    shuffled = records.read_records(index.orderBy(F.rand(1)).limit(5), path).collect()
    assert len(shuffled) == 5 and all(len(r["ids"]) == 4 * r["n_tokens"] for r in shuffled)
    empty = str(tmp_path / "none")
    records.write_records(no_docs, empty, LIBRARY)
    assert records.read_records(records.read_index(spark, empty), empty).collect() == []


def test_a_damaged_record_is_refused():
    record = records.frame(b"\x01\x02\x03\x04")
    assert records.unframe(record) == b"\x01\x02\x03\x04"
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))


def test_queries(spark, tables):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries()["op10_token_records"](spark, SF).collect()}
    start = 0
    for i, one in expected(docs, tables[3]):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(one), zlib.crc32(struct.pack(f"<{len(one)}I", *one)))
        start += len(one)
    texts = dict(docs)
    for row in queries()["op2_bpe_round_trip"](spark, SF).collect():
        own = tables[1].encode_ordinary(texts[row["doc_id"]] or "")
        import hashlib
        assert row["n_tokens"] == len(own) and row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((texts[row["doc_id"]] or "").encode()).hexdigest()


def test_ranks_file():
    ranks = bpe.load_ranks(RANKS)
    first = open(RANKS, "rb").readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1])


def test_a_row_is_encoded_once(spark, odd_docs):
    # Of ids and of what they decode to, Spark made two calls, of which the second encoded anew.
    assert "pythonUDF1" not in plan(queries()["op2_bpe_round_trip"](spark, SF))
    coder = byte_bpe(spark)
    for row in odd_docs.select("text", coder.round_trip(F.col("text")).alias("trip"), coder.encode(F.col("text")).alias("ids")).collect():
        assert row["trip"]["ids"] == row["ids"] and row["trip"]["decoded"] == (row["text"] or "").encode()


def test_words_marks_and_next_lines(tables):
    letters = ["ab", "Ǆé", "it", "ɏ", "ª", "中"]
    marks = [".", "%%%", "'", "'s", "<|", "|>", "×", "1", "", ".\t"]
    lines = ["", "\nThe", "\n\nThe", "\nendoftext|>", "\n", "\né.", " \nB"]
    texts = [f"a {word}{mark}{line}" for word in letters for mark in marks for line in lines]
    agree(tables, texts)
    agree(tables, texts[::-1])  # with the words in the table
