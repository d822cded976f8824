import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from odd_rows import CLASHING, no_docs, odd_docs  # noqa: F401

from tuneloom.llm import periods
from tuneloom.llm.queries import op13_periodic_runs


def by_hand(words):
    """Every period on its own: maximal stretches of equal words that far apart."""
    n, smallest = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                smallest.setdefault((start, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in smallest.items()), key=lambda r: (r[0], r[2]))


def dealt(deal):
    words = [str(deal.randrange(deal.choice([1, 2, 3, 50]))) for _ in range(deal.randrange(60))]
    for _ in range(deal.randrange(4)):
        unit = [str(deal.randrange(4)) for _ in range(deal.randrange(1, 40))]
        words += (unit * 9)[:deal.randrange(1, 9 * len(unit))]
        words += [str(deal.randrange(4)) for _ in range(deal.randrange(5))]
    return words


def test_equals_every_period_on_its_own():
    deal = random.Random(13)
    texts = [dealt(deal) for _ in range(400)]
    found = periods.runs_of([[w.encode() for w in words] for words in texts])
    want = [by_hand(words) for words in texts]
    assert found == want and sum(map(len, want)) > 300


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=50), max_size=4))
def test_two_words(texts):
    assert periods.runs_of(texts) == [by_hand(words) for words in texts]


def test_long_texts_of_few_words():
    same, pair = [b"a"] * 60_000, [b"a", b"b"] * 30_000
    assert periods.runs_of([same, pair, []]) == [[(0, 60_000, 1)], [(0, 60_000, 2)], []]
    unit = [str(i).encode() for i in range(5_000)]
    assert periods.runs_of([unit * 4, unit * 3]) == [[(0, 20_000, 5_000)], []]
    fibonacci = [[b"a"], [b"a", b"b"]]
    while len(fibonacci[-1]) < 3_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert periods.runs_of(fibonacci[-1:]) == [by_hand(fibonacci[-1])]


@pytest.mark.parametrize("size", [2, 8, 64])
def test_transform_convolves(size):
    deal = np.random.default_rng(size)
    a, b = deal.integers(0, periods.PRIME, (2, 3, size))
    transform = periods.Transform(size)
    found = transform.back(transform.forward(a) * transform.forward(b) % periods.PRIME)
    want = [[sum(int(x[i]) * int(y[(k - i) % size]) for i in range(size)) % periods.PRIME for k in range(size)] for x, y in zip(a, b)]
    assert found.tolist() == want


def contract(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_hand(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


def test_query(spark, tmp_path):
    deal = random.Random(3)
    blanks = [" ", "  ", "\n", "\t", "\x0b", "\x0c\r", "  "]
    rows = [(i, deal.choice(["", " "]) + "".join(w + deal.choice(blanks) for w in dealt(deal))) for i in range(300)]
    rows += [(i, " ".join(f"w{j}" for j in range(i))) for i in range(300, 420)] + [(500, None), (501, ""), (502, " \n"), (None, "a " * 9), (7, "é " * 30), (7, "é " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((contract(*row) for row in rows), key=repr)


def test_odd_rows(odd_docs, no_docs):
    found = periods.periodic_runs(odd_docs).collect()
    assert len(found) == odd_docs.count() and set(CLASHING) < set(found[0]["row"].asDict())
    runs = {r["row"]["doc_id"]: [tuple(run) for run in r["runs"]] for r in found if r["runs"]}
    assert runs == {6: [(0, 40_000, 977)], 7: [(0, 40_000, 977)]}
    assert {r["collapsed"] for r in found if not (r["row"]["text"] or "").strip()} == {""}
    assert periods.periodic_runs(no_docs).isEmpty()
