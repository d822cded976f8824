import bisect
import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd_rows import CLASHING, no_docs, odd_docs  # noqa: F401

from tuneloom.llm import alignment
from tuneloom.llm.queries import op12_shared_cuts

PATTERN = public_tokenizers.PATTERN
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "the", "Quick", "fox", " ", " ", "  ", "   ", "\n", "\t", " \n ", "é", "ß", "中文", "🙂", "don't", "123", "4567", ".", ",", "--", "<|endoftext|>", "<s>", "<0x41>",
    " ", " ", "ﬁ", "é", "ｆ", "​", "x" * 70, "naïve", "日本語のテキスト", "\r\n", "</s>", "<unk>",
]


def texts():
    deal = random.Random(12)
    made = ["".join(deal.choices(PARTS, k=deal.randrange(1, 40))) for _ in range(500)]
    return made + ["▁", "a▁b", "ends ▁", "▁ ▁x", " ", "  ", "\n", " lead", "trail ", "trail  ", "\u0000", "a\u0000b", "word " * 3000, "z" * 5000]


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import base64

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        spelt = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        return ids_a, [spelt[i] for i in ids_a], ids_b, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]

    return tokens


def by_hand(tokens, rows):
    """All overlapping pairs of each text, one by one, then counts over all texts."""
    whole = []
    for _, text in rows:
        ids_a, spelt_a, ids_b, spelt_b = tokens(text) if text else ([], [], [], [])
        data = b" " + (text or "").encode()
        if b"".join(spelt_a) != data or b"".join(spelt_b) != data:
            ids_a, spelt_a, ids_b, spelt_b = [], [], [], []
        spans = []
        for spelt in (spelt_a, spelt_b):
            ends = np.cumsum([len(t) for t in spelt]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links = [(x, y) for x, (s, e) in zip(ids_a, spans[0]) for y, (t, f) in zip(ids_b, spans[1]) if s < f and t < e]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in common:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, side) if low <= s and e <= cut) for ids, side in zip((ids_a, ids_b), spans)))
            low = cut
        whole.append((len(ids_a), len(ids_b), groups, links))
    held = Counter(pair for *_, links in whole for pair in set(links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, whole):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


def test_query_equals_all_pairs(spark, libraries, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 4000)  # several blocks a task
    rows = [*enumerate(texts()[:507]), (900, None), (901, ""), (None, "no id"), (7, "same"), (7, "same"), (902, "some words " * 40), (903, "z" * 600)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_shared_cuts(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(by_hand(libraries, rows), key=repr)


def test_ids_equal_those_of_the_libraries(libraries, monkeypatch):
    a, b = alignment.byte_level(A, PATTERN), alignment.pieces(B)
    empty = 0
    for most in (1 << 20, 30):  # whole, and in parts
        monkeypatch.setattr(alignment, "STRETCH_CHARS", most)
        for text in texts():
            ids_a, spelt_a, ids_b, spelt_b = libraries(text)
            data = b" " + text.encode()
            for side, ids, spelt in ((a, ids_a, spelt_a), (b, ids_b, spelt_b)):
                want = ids if b"".join(spelt) == data else []
                empty += not want
                assert side.ids(text).tolist() == want, repr(text[:80])
    assert empty > 6
    assert len(alignment.stretches("word " * 100)) == 15 and alignment.stretches("x" * 99) == ["x" * 99]


def test_cuts_are_the_common_ends():
    deal = np.random.default_rng(5)
    for share in (0.05, 0.5, 0.95):
        n = 4000
        a = np.union1d(np.flatnonzero(deal.random(n) < share), [n])
        b = np.union1d(np.flatnonzero(deal.random(n) < share), [n])
        marked = alignment.shared_ends(a, b, np.array([0]), np.array([len(a)]))
        assert a[marked].tolist() == np.intersect1d(a, b).tolist()
        assert all(b[bisect.bisect_left(b, end)] == end for end in a[marked])


def test_odd_rows(odd_docs, no_docs):
    found = alignment.align(odd_docs, A, B, PATTERN).collect()
    assert len(found) == odd_docs.count() and set(CLASHING) < set(found[0]["row"].asDict())
    assert all((r["n_a"] > 0) == bool(r["row"]["text"]) for r in found)
    assert alignment.align(no_docs, A, B, PATTERN).isEmpty()
