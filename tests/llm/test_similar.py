import random
from collections import Counter

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from test_near_copies import roots

import corpus_pipeline
from tuneloom import session
from tuneloom.llm import similar, simhash

STAGE = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Texts with 1 to 40 changed words, a group of copies of one text, a line that many hold, short texts."""
    deal = random.Random(4)
    line = [f"common{i}" for i in range(30)]
    texts = []
    for n in (30, 100, 300, 1000):
        for changed in (1, 2, 4, 6, 8, 10, 15, 20, 40):
            words = [f"w{deal.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for at in deal.sample(range(n), min(changed, n)):
                other[at] = "changed"
            texts += [words, other]
    base = [f"w{deal.randrange(10**6)}" for _ in range(200)]
    for _ in range(80):
        copy = list(base)
        for at in deal.sample(range(200), deal.randrange(8)):
            copy[at] = f"w{deal.randrange(10**6)}"
        texts.append(copy)
    texts += [line + [f"w{deal.randrange(10**6)}" for _ in range(n)] for n in (3, 4, 5, 6, 7, 8, 9, 60, 60, 60)]
    texts += [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d", "e"], []]
    deal.shuffle(texts)
    return [" ".join(words) for words in texts]


def test_pairs_of_all_similarities(spark):
    texts = planted()
    sets = [shingles(t) for t in texts]
    values = {(i, j): jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j]}
    assert sum(0.8 <= v < 0.95 for v in values.values()) > 20
    linked = roots(range(len(texts)), [pair for pair, v in values.items() if v >= 0.8])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in STAGE(spark, docs, SF).collect()}
    assert kept == set(linked.values())


def test_fingerprints_and_trees_find_the_nearest(spark, monkeypatch):
    deal = random.Random(6)
    base = [f"w{deal.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base[:n] + [f"x{n}"] + base[n + 1:]) for n in (10, 500, 1500, 2990)] + [" ".join(f"w{deal.randrange(10**6)}" for _ in range(50)) for _ in range(5)]
    asked, search = [], similar.near_links
    monkeypatch.setattr(similar, "near_links", lambda *given: asked.append(search(*given)) or asked[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in STAGE(spark, docs, SF).collect())
    assert kept == [0, 4, 5, 6, 7, 8]
    # The stage asks the trees, for fingerprints of its own shingles.
    marks = [simhash.fingerprint_of(text, similar.WORDS) for text in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if ((marks[i] ^ marks[j]) & simhash.ALL_BITS).bit_count() <= similar.RADIUS]
    found = [(marks.index(a), marks.index(b)) for a, b in asked[0].collect()]
    assert len(asked) == 1 and near and roots(range(len(texts)), found) == roots(range(len(texts)), near)


def test_ranges_of_components_rule_out_no_possible_pair(spark):
    deal = random.Random(8)
    members = []
    for root in range(120):
        base = deal.randrange(1, 600)
        for _ in range(deal.choice([1, 1, 1, 3])):
            n = max(1, base * deal.randrange(80, 125) // 100)
            members.append((root, n, deal.randint(1, similar.prefix_size(n))))
    rows = spark.createDataFrame(members, "root long, n int, repeated int")
    ranges = rows.groupBy("root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("repeated").alias("repeated"))
    met = rows.alias("a").crossJoin(rows.alias("b")).filter("a.root < b.root").filter(similar._possible("a", "b"))
    possible = {tuple(r) for r in met.select("a.root", F.col("b.root").alias("other")).collect()}
    both = ranges.alias("x").crossJoin(ranges.alias("y")).filter("x.root < y.root")
    allowed = {tuple(r) for r in both.filter(similar._ranges_allow("x", "y")).select("x.root", F.col("y.root").alias("other")).collect()}
    assert possible and possible <= allowed and len(allowed) < both.count() / 2


def test_tables_of_the_stage_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    assert STAGE(spark, docs, SF).count() < docs.count()
    left = {path.name.rpartition("-")[0] for path in tmp_path.iterdir()}
    # Prefixes, texts and buckets, all that grows with the words.
    assert "similar-nodes" in left and not left & {"similar", "similar-shared", "similar-held", "similar-rows", "similar-texts", "similar-rooted", "similar-roots"}


def test_prefixes_follow_the_numbers_of_all_texts(spark):
    texts = planted() + ["", None, "common0 common1"]
    sets = {similar.node_of(s): s for s in map(similar.shingle_set, texts)}
    tokens = {node: [int(t) for t in similar.tokens_of(s)] for node, s in sets.items()}
    held_by = Counter(t for each in tokens.values() for t in each)
    often = {t: n for t, n in held_by.items() if n >= 9}
    assert often
    order = sorted(often)
    frequent = (np.array(order, dtype=np.uint64), np.array([often[t] for t in order], dtype=np.int64))
    # On one partition: a node then counts once, however many texts have it.
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, rid long, text string")
    for parts, buckets in ((1, 1), (1, 7), (4, 300)):
        read = similar.read_texts(rows.dropDuplicates(["text"]).repartition(parts, "doc_id"), frequent, buckets).localCheckpoint()
        marks = read.filter("bucket is null")
        assert {r["node"]: r["n"] for r in marks.collect()} == {node: len(s) for node, s in sets.items()}
        packed = read.filter("bucket is not null").select("chunk", "bucket", "data")
        found = similar.prefixes(packed.filter("bucket < 0"), similar.repeated_tokens(packed.filter("bucket >= 0"))).collect()
        wanted = {}
        for node, each in tokens.items():
            prefix = sorted(each, key=lambda t: (t in often, held_by[t], t))[:similar.prefix_size(len(sets[node]))]
            alone = sum(held_by[t] == 1 for t in each)
            if prefix[alone:]:
                wanted[node] = (len(sets[node]), alone, prefix[alone:])
        assert {r["node"]: (r["n"], r["start"], list(r["prefix"])) for r in found} == wanted


def test_texts_that_share_passages_only_are_not_compared(spark, monkeypatch):
    deal = random.Random(9)
    passages = [[f"p{i}w{k}" for k in range(40)] for i in range(12)]
    texts = []
    for _ in range(60):  # two thirds are passages of others, and no two of them are similar
        own = [f"w{deal.randrange(10**9)}" for _ in range(60)]
        texts.append(" ".join(sum(deal.sample(passages, 3), own)))
    texts.append(texts[7] + " more")
    kept, counts, stored = None, {}, similar.stored
    monkeypatch.setattr(similar, "stored", lambda df, label: (table := stored(df, label), counts.update({label: table.count()}))[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in STAGE(spark, docs, SF).collect()}
    assert kept == set(range(60))
    assert counts["similar-texts"] == 2


def test_reach_of_a_place_leaves_out_no_similar_pair(spark):
    sizes = [(n, m) for n in (1, 2, 3, 7, 9, 10, 45, 100, 101, 250) for m in range(-(-4 * n // 5), 5 * n // 4 + 1)]
    rows = spark.createDataFrame([(n, m, place) for n, m in sizes for place in range(similar.prefix_size(n))], "n int, m int, place int")
    for n, m, place, within in rows.select("n", "m", "place", similar.reach(F.col("n"), F.col("place"))).collect():
        common = -(-4 * (n + m) // 9)
        assert (m <= within) == (place <= n - common)
