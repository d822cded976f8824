import random

import xxhash
from conftest import SF
from odd_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from tuneloom.llm import components, simhash
from tuneloom.llm.queries import queries


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def by_hand(fps, radius=2):
    fps = list(fps)
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius]


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(-5, 300), (300, -7)]
    links += [(7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({n for link in links for n in link}, links)
    assert got == {node: root for node, root in want.items() if node != root}


def test_fingerprints(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()] + ["one", "one two", "A a\x0bb", "é É  e"]
    for text in texts:
        assert simhash.fingerprint_of(text) & simhash.ALL_BITS == fingerprint(text)
    assert simhash.fingerprint_of(" \n") == 0


def test_bk_tree_finds_what_brute_force_finds():
    deal = random.Random(2)
    values = list({deal.getrandbits(64) ^ (1 << deal.randrange(64)) for _ in range(300)} | {1 << i for i in range(64)})
    tree = simhash.BkTree()
    for value in values:
        tree.add(value)
    for value in values[::7]:
        for radius in (0, 2, 5):
            assert sorted(tree.values[i] for i in tree.within(value, radius)) == sorted(v for v in values if (v ^ value).bit_count() <= radius)


def test_crowded_shards_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_IN_A_TREE", 8)
    deal = random.Random(4)
    centre = deal.getrandbits(64)
    values = {centre ^ sum(1 << b for b in deal.sample(range(64), deal.randint(0, 3))) for _ in range(250)} | {deal.getrandbits(64) for _ in range(100)}
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = [(a & simhash.ALL_BITS, b & simhash.ALL_BITS) for a, b in simhash.near_links(frame).collect()]
    assert all((a ^ b).bit_count() < 64 for a, b in links)
    assert roots(values, links) == roots(values, by_hand(values))


def test_near_copies_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    linked = roots({fingerprint(r["text"]) for r in rows}, by_hand({fingerprint(r["text"]) for r in rows}))
    lowest = {}
    for r in rows:
        root = linked[fingerprint(r["text"])]
        lowest[root] = min(filter(lambda i: i is not None, (lowest.get(root), r["doc_id"])), default=None)
    want = sorted(((r["doc_id"], lowest[linked[fingerprint(r["text"])]]) for r in rows), key=repr)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_copies(odd_docs).collect()), key=repr)
    assert got == want
    kept = simhash.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(linked[fingerprint(r["text"])] for r in kept.collect()) == sorted(set(linked.values()))
    assert simhash.near_copies(no_docs).collect() == [] and simhash.kept_rows(no_docs).collect() == []


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: fingerprint(text) for i, text in docs.items()}
    linked = roots(set(fps.values()), by_hand(set(fps.values())))
    lowest = {}
    for i in sorted(docs):
        lowest.setdefault(linked[fps[i]], i)
    rows = queries()["op9_simhash_bk_trees"](spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert row["fingerprint"] == f"{fps[row['doc_id']]:016x}" and row["component_id"] == lowest[linked[fps[row["doc_id"]]]]
    kept = simhash.kept_rows(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id")
    assert sorted(r[0] for r in kept.collect()) == sorted(lowest.values())
    assert kept.filter(F.col("doc_id").isNull()).isEmpty()
