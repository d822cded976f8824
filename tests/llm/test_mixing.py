import re
from collections import defaultdict

import pytest
from conftest import SF
from odd_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from tuneloom.llm import mixing
from tuneloom.llm.common import squeeze, word_count
from tuneloom.llm.queries import queries


def shares(sizes, cycle=(1, 2, 3), most=3.0):
    """Targets by resharing the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, left, total = {}, set(names), float(sum(sizes.values()))
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in left}
        target |= {s: most * sizes[s] for s in full}
        left -= full
    return target


def check(rows, mixed):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for source, size in rows:
        sizes[source] += size
        largest[source] = max(largest[source], size)
    target = shares(sizes)
    for row in mixed:
        taken[row["source"]] += row["taken"]
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(target[row["source"]])
        assert row["taken"] <= 3 * row["size"] and row["taken"] == row["copies"] * row["size"]
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1e-6
    return target


def test_words_and_blanks(spark):
    texts = [None, "", " ", "a", " a ", "a\t\nb", "\x0b\x0ca  b\r", "\x1ca\x85b c", "  x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n"), squeeze(F.col("t")).alias("s")).collect()
    for row in rows:
        assert row["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", row["t"] or ""))
        assert row["t"] is None or row["s"] == re.sub(r"[\x20\x09-\x0D]+", " ", row["t"])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs).select("row.source", "size", "source_size", "target", "copies", "taken").collect()
    check([(r["source"], r["size"]) for r in mixed], mixed)
    assert len(mixed) == docs.count()


def test_caps_bind_and_excess_is_reshared(spark):
    rows = [(i, "w " * (1 + i % 50), "ab"[i % 2] if i < 600 else "tiny") for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).select("row.source", "size", "source_size", "target", "copies", "taken").collect()
    target = check([(r["source"], r["size"]) for r in mixed], mixed)
    assert target["tiny"] == 3.0 * sum(r["size"] for r in mixed if r["source"] == "tiny")


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = (sorted((r["doc_id"], r["copies"]) for r in mixing.mix(d).select("row.doc_id", "copies").collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_importance_makes_chances_unequal(spark):
    rows = [(i, "w " * 10, "a", 1.0 if i % 2 else 4.0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, worth double")
    mixed = mixing.mix(docs, importance="worth", targets=lambda s: s.withColumn("target", F.col("source_size") * 0.25))
    rates = {r["worth"]: r["rate"] for r in mixed.groupBy("row.worth").agg(F.avg("copies").alias("rate")).collect()}
    assert rates[4.0] == pytest.approx(0.4, abs=0.03) and rates[1.0] == pytest.approx(0.1, abs=0.03)
    assert mixed.agg(F.sum("taken")).first()[0] == pytest.approx(10_000, abs=5)


def test_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs)
    assert mixed.count() == odd_docs.count() and mixed.filter("size = 0 and taken > 0").isEmpty()
    assert mixed.select("row.*").columns == odd_docs.columns
    assert mixing.mix(no_docs).collect() == []


def test_registered(spark):
    assert queries()["op1_pareto_mix"](spark, SF).columns == ["doc_id", "size", "source_size", "target", "taken"]


@pytest.mark.parametrize("ids", [None, 7])
def test_source_of_repeated_rows(spark, ids):
    """The cut falls among rows that agree in everything; the others differ."""
    rows = [(ids, "s1", "w " * 10)] * 200 + [(i, "s0", "x " * (1 + i % 30)) for i in range(300)] + [(i, None, "y y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    mixed = mixing.mix(docs).select("row.*", "size", "source_size", "target", "copies", "taken")
    first = mixed.collect()
    target = check([(r["source"], r["size"]) for r in first], first)
    assert len(first) == len(rows) and target["s1"] > 0
    assert sorted(r["copies"] for r in first if r["source"] == "s1")[0] < sorted(r["copies"] for r in first if r["source"] == "s1")[-1]

    def counted(rows):
        return sorted((str(r["source"]), r["size"], r["taken"], str(r["doc_id"])) for r in rows)

    assert counted(mixing.mix(docs).select("row.*", "size", "taken").collect()) == counted(first)
