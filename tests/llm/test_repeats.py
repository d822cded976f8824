import hashlib
import random
from collections import Counter

import numpy as np
from conftest import SF
from hypothesis import given, settings, strategies as st
from odd_rows import no_docs, odd_docs  # noqa: F401

from tuneloom.llm import repeats
from tuneloom.llm.queries import queries


def brute(texts):
    """Covered bytes of each text."""
    data = [(t or "").encode() for t in texts]
    n = repeats.LENGTH
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    covered = []
    for d in data:
        mask = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                mask[i:i + n] = True
        covered.append(mask)
    return data, covered


def check(spark, texts, partitions=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = {r["doc_id"]: r for r in repeats.without_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept").collect()}
    for i, (data, mask) in enumerate(zip(*brute(texts))):
        assert got[i]["n_bytes"] == len(data) and got[i]["n_removed"] == mask.sum()
        assert bytes(got[i]["kept"]) == np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
        assert got[i]["n_spans"] == int(np.diff(np.concatenate(([0], mask.astype(int)))).clip(0).sum()) == len(got[i]["spans"])


def prose(deal, words):
    return " ".join("".join(deal.choice("etaoinsr") for _ in range(deal.randint(2, 8))) for _ in range(words))


def test_passages_edits_and_copies(spark):
    deal = random.Random(1)
    passage, other = prose(deal, 60), prose(deal, 45)
    texts = [prose(deal, 80) + passage + prose(deal, 30), passage[3:] + prose(deal, 10), "x" + passage[:199], "y" + passage[:200] + "z"]
    texts += [other + other, passage[:150] + "#" + passage[151:], prose(deal, 300), None, "", "é" * 150, "ü" + "é" * 100]
    base = prose(deal, 400)
    for _ in range(12):  # near copies with edits all over
        at = sorted(deal.sample(range(len(base)), 5))
        texts.append("".join(base[a:b] + deal.choice("QWZ") for a, b in zip([0, *at], [*at, len(base)])))
    texts += [base, base]
    check(spark, texts)


def test_runs_of_one_letter_and_short_periods(spark):
    check(spark, ["a" * 500, "a" * 199, "b" * 200, "ab" * 150, "c" + "ab" * 99 + "d", "abc" * 70])


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    deal = random.Random(2)
    long, tail = prose(deal, 900), prose(deal, 60)
    check(spark, [long + tail, prose(deal, 500), tail + prose(deal, 200) + long[1500:2900]])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1 << 30))
def test_phrases_of_equal_strings_agree(seed):
    deal = random.Random(seed)
    shared = prose(deal, 70).encode()
    found = []
    for head in (prose(deal, deal.randint(0, 30)).encode(), b"a" * deal.randint(0, 300)):
        data = head + shared
        starts = {}
        for first, last, core, _ in repeats.phrases(data):
            for a, b, c in zip(first.tolist(), last.tolist(), core.tolist()):
                starts.update((i - len(head), c) for i in range(a, b + 1) if i >= len(head))
        assert sorted(starts) == list(range(max(0, len(shared) - repeats.LENGTH + 1)))
        found.append(starts)
    assert found[0] == found[1]


def test_odd_rows(odd_docs, no_docs):
    got = repeats.without_repeats(odd_docs)
    rows = got.select("row.doc_id", "row.text", "n_removed").collect()
    want = sorted((r["doc_id"] or 0, int(m.sum())) for r, m in zip(odd_docs.collect(), brute([r["text"] for r in odd_docs.collect()])[1]))
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == want
    assert got.select("row.*").columns == odd_docs.columns
    assert repeats.without_repeats(no_docs).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries()["op7_prefix_free_repeats"](spark, SF).collect()}
    assert len(got) == len(docs)
    for row, data, mask in zip(docs, *brute([r["text"] for r in docs])):
        kept = np.frombuffer(data, dtype=np.uint8)[~mask].tobytes()
        assert got[row["doc_id"]]["n_removed"] == mask.sum() and got[row["doc_id"]]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
