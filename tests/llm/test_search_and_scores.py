import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from odd_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from tuneloom.llm import licences, neighbours, toxicity
from tuneloom.llm.queries import queries

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, n, is_query):
    """Nearest of each query, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x):
        if is_query(i):
            scores = x @ v
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:n]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = defaultdict(dict)
    for row in df.collect():
        out[row["query_id"]][row["rank"]] = (row["vec_id"], row["score"])
    for ranks in out.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
    return {q: [ranks[k] for k in sorted(ranks)] for q, ranks in out.items()}


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet").collect()]
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = found(queries()["op8_nn_descent"](spark, SF.replace("sf0.001", "sf0.1")))
    assert set(got) == set(want) and all(len(ranks) == 20 for ranks in got.values())
    assert recall(got, want) >= 0.95
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, ranks in got.items():
        for i, score in ranks:
            assert score == pytest.approx(vectors[i] @ vectors[q], abs=1e-12)
        assert ranks == sorted(ranks, key=lambda r: (-r[1], r[0]))


def test_unequal_lengths_and_a_vector_many_rows_share(spark):
    deal = np.random.default_rng(3)
    x = (deal.standard_normal((900, 12)) * deal.uniform(0.3, 3, (900, 1))).astype(np.float32)
    x[:300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    want = brute(rows, 10, lambda i: i % 9 == 0)
    got = found(neighbours.nearest(frame, lambda i: i % 9 == 0, 10, leaf=64, beam=150))
    assert recall(got, want) >= 0.95 and [i for i, _ in got[0]] == [i for i, _ in want[0]]


def test_few_and_useless_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (20, [0.5, 0.5]), (20, [2.0, 1.0]), (40, [-1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = neighbours.nearest(frame, lambda i: i % 20 == 0, 20).collect()
    pairs = sorted((r["query_id"], r["vec_id"]) for r in got)
    # Each row of id 20 asks for itself; the second component that row 7 lacks is zero.
    assert {q for q, _ in pairs} == {0, 20, 40} and {v for q, v in pairs if q == 0} == {1, 7, 20, 40}
    assert {r["score"] for r in got if r["query_id"] == 20 and r["vec_id"] == 7} == {0.5, 2.0}
    assert neighbours.nearest(frame.limit(0), lambda i: i % 20 == 0).collect() == []
    assert neighbours.nearest(frame.filter("vec_id in (2, 3)"), lambda i: i % 20 == 0).collect() == []


def test_repeated_rows_clashing_columns_and_lengths_that_differ(spark):
    deal = np.random.default_rng(5)
    rows = [(i, deal.standard_normal(deal.choice([6, 9, 12])).tolist()) for i in range(400)]
    rows += [(500, rows[3][1]), (501, rows[3][1])]
    schema = "vec_id long, embedding array<double>, node string, vec string, query string, block string, score string"
    frame = spark.createDataFrame([(i, v, *"abcde") for i, v in rows], schema).repartition(4)
    full = [(i, v + [0.0] * (12 - len(v))) for i, v in rows]
    got, want = found(neighbours.nearest(frame, lambda i: i % 10 == 0, 10, leaf=64)), brute(full, 10, lambda i: i % 10 == 0)
    assert set(got) == set(want) and recall(got, want) >= 0.99


def test_a_narrow_beam_is_widened(spark):
    deal = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(deal.standard_normal((3000, 24)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute(rows, 10, lambda i: i % 20 == 0)
    assert recall(found(neighbours.nearest(frame, lambda i: i % 20 == 0, 10, leaf=64, beam=12)), want) >= 0.95


def test_first_leaves_and_rounds_improve(spark):
    deal = np.random.default_rng(4)
    x = deal.standard_normal((1500, 16)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>")
    packed = neighbours.packed(nodes, float(np.linalg.norm(x, axis=1).max())).cache()
    longest = np.linalg.norm(x, axis=1).max()
    full = np.column_stack([x, np.sqrt(np.maximum(0, longest**2 - (x**2).sum(axis=1)))])
    scores = full @ full.T
    np.fill_diagonal(scores, -np.inf)
    best = {i: set(np.argsort(-row)[:10].tolist()) for i, row in enumerate(scores)}

    def quality(graph):
        return np.mean([len(set(np.frombuffer(r["nbrs"], "<i8")[:10].tolist()) & best[r["node"]]) / 10 for r in graph.collect()])

    graph = neighbours.best_lists(neighbours.first_lists(packed, 17, 10, trees=2, leaf=64), 10).cache()
    first = quality(graph)
    for _ in range(3):
        graph = neighbours.descend(graph, packed, 17, 10, 20, 6).cache()
    assert quality(graph) > max(0.8, first + 0.2)


def test_licences(spark, odd_docs, no_docs):
    mit = next(text for name, text in licences.KNOWN if name == "MIT" and len(text) > 200)
    texts = [
        mit, "Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ;"), mit + " and more", None, "",
        "Some words.\nreleased under the MIT Licence\n  Released under the MIT License.  ", "Licensed under CC BY-NC 4.0.\nLicensed under the apache license version 2.0",
        "It is released under the MIT License.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licences.licence_scan(docs).collect()}
    assert got == {0: ("MIT", ""), 1: ("MIT", ""), 2: (None, ""), 3: (None, ""), 4: (None, ""), 5: (None, "MIT"), 6: (None, "Apache-2.0,CC-BY-NC-4.0"), 7: (None, "")} | {
        k: got[k] for k in (0, 1, 2)} and got[0][0] == got[1][0] == "MIT" and got[2][0] is None
    assert licences.licence_scan(odd_docs).count() == odd_docs.count() and licences.licence_scan(no_docs).collect() == []


def test_whole_licences_and_their_clauses(spark):
    """Each text with copyright lines in between, in other case and wrapping; a text with a changed or added clause is none."""
    rows, wanted = [], {}
    for name, text in licences.known_texts():
        if len(text) > 200:
            for other in (text, "Copyright 2021 A. Body\n(c) 2020-2021 B\nAll rights reserved.\n\n" + text.upper(), "\n\n".join(text.split("\n\n")[:1] + ["  Copyright (c) C"] + text.split("\n\n")[1:])):
                wanted[len(rows)] = name
                rows.append(other)
            for other in ("(c) do not sell\n" + text, text + "\nCopyright holders may object.", text[:-150]):
                wanted[len(rows)] = None
                rows.append(other)
    wanted[len(rows)] = None
    rows.append("(c) do not sell\nReleased under the MIT License.")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.licence_scan(docs).collect()}
    assert got == wanted
    assert {"MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} == set(wanted.values()) - {None}


WORDS = "the of and to in is that for it was on are as with they be at this have from or one had by word but not what all were we when your can said there".split()
BAD = ["zorgly", "blastic", "krumpf"]


def restorer():
    text = " ".join(WORDS * 30 + BAD * 20)
    s = np.concatenate(([0, 0], toxicity.symbols(text), [0, 0]))
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return toxicity.Restorer(toxicity.CharModel(counts))


@pytest.mark.parametrize("written, meant", [
    ("z0rgly", "zorgly"), ("bl4st1c", "blastic"), ("zoooorgly", "zorgly"), ("k r u m p f", "krumpf"), ("b.l.a.s.t.i.c", "blastic"),
    ("the word", "the word"), ("Krumpf!", "krumpf"), ("", ""), ("555-0123", "555-0123"),
])
def test_restoring(written, meant):
    assert restorer().restore(written) == meant


def labelled(spark, n, deal):
    rows = []
    for i in range(n):
        words = [deal.choice(WORDS) for _ in range(deal.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(deal.randrange(len(words)), deal.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(spark):
    frame = labelled(spark, 1200, random.Random(1)).cache()
    model = toxicity.fit(frame, frame.select("doc_id", "toxic"))
    rows = toxicity.scored(frame, model).select("row.*", "score").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 150 and sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in rows) / len(rows) > 0.98
    hidden = spark.createDataFrame([(1, "you z0rgly and kruuumpf b l a s t i c"), (2, "you and the word said")], "doc_id long, text string")
    scores = {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(hidden, model).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_toxicity_of_odd_rows_and_without_labels(spark, odd_docs, no_docs):
    frame = labelled(spark, 400, random.Random(2))
    model = toxicity.fit(frame, frame.select("doc_id", "toxic"))
    rows = toxicity.scored(odd_docs, model).select("row.*", F.col("score").alias("s")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["s"] < 0.5 for r in rows)
    assert toxicity.scored(no_docs, model).collect() == []
    blank = toxicity.fit(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 1e-9 for r in toxicity.scored(odd_docs, blank).select("score").collect())


def test_trigram_counts_cover_all_rows(spark, odd_docs):
    counts = toxicity.trigram_counts(F.col("text"), odd_docs)
    want = np.zeros((toxicity.SYMBOLS,) * 3)
    for row in odd_docs.collect():
        if row["text"]:
            s = np.concatenate(([0, 0], toxicity.symbols(row["text"]), [0, 0]))
            np.add.at(want, (s[:-2], s[1:-1], s[2:]), 1)
    assert (counts == want).all()
