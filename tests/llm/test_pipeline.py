import corpus_pipeline
from conftest import SF
from odd_rows import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from test_exact_and_shards import normal
from test_near_copies import roots
from test_similar import jaccard, shingles

from tuneloom.llm import mixing
from tuneloom.llm.common import stored

STAGES = dict(corpus_pipeline.STAGES)


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    clean = stored(STAGES["toxicity"](spark, docs, SF), "t")
    assert clean.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert sum(i in kept for i, toxic in labels.items() if not toxic) / sum(not t for t in labels.values()) > 0.97

    single = stored(STAGES["exact_dedup"](spark, clean, SF), "t")
    first = {}
    for row in sorted(clean.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(normal(row["text"]), row["doc_id"])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    apart = stored(STAGES["simhash_near_dedup"](spark, single, SF), "t")
    rows = single.collect()
    sets = {r["doc_id"]: shingles(normal(r["text"]).lower()) for r in rows}
    linked = roots(sorted(sets), [(i, j) for i in sets for j in sets if j < i and sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8])
    assert apart.columns == columns and {r["doc_id"] for r in apart.collect()} == set(linked.values())

    mixed = stored(STAGES["pareto_mix"](spark, apart, SF), "t")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(apart).select("row.doc_id", "copies").filter("copies > 0").collect()}
    assert mixed.columns == columns and {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want

    coded = STAGES["byte_level_bpe"](spark, mixed, SF)
    assert coded.count() == mixed.count() and coded.filter("not decodes").isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("not decodes or n_tokens * 4 <> octet_length(ids)").isEmpty()


def test_odd_rows_through_all_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
        docs.collect()
