"""Registered queries of the package: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuneloom.llm import alignment, bpe, exact, licences, mixing, neighbours, periods, records, repeats, secrets, sharding, simhash, toxicity
from tuneloom.llm.common import squeeze, table
from tuneloom.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


@query
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document; sources weigh 1, 2, 3, repeating, at most three times their size."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe(spark: SparkSession) -> bpe.ByteBpe:
    import public_tokenizers

    return bpe.ByteBpe(spark, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids, and the ids as bytes again."""
    coded = table(spark, sf_dir, "documents").select("doc_id", byte_bpe(spark).round_trip(F.col("text")).alias("trip")).select("doc_id", "trip.*")
    tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes."""
    placed = sharding.histogram_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every whole text, and of its lines."""
    return licences.licence_scan(table(spark, sf_dir, "documents"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(exact.normal_text(F.col("text")), 256)
    marked = exact.exact_dedup(docs, keep=["doc_id"], extra={"text_sha256": digest})
    return marked.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


@query
def op7_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of 200-byte strings that start anywhere else as well."""
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others, by inner product."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


@query
def op9_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near copies of every document."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text from record files: where they start, how many they are, their checksum."""
    path = scratch_path(spark, "token-records")
    records.write_records(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    read = records.read_records(records.read_index(spark, path), path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op11_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text, and how many of each base kind."""
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.secret_spans(F.col("text")).alias("all"))
    base = [kind.name for kind in secrets.KINDS[:secrets.BASE]]
    counts = [F.size(secrets.of_kinds(F.col("all"), name)).cast("long").alias(f"n_{name}") for name in base]
    digest = F.sha2(secrets.listed(secrets.of_kinds(F.col("all"), *base)), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.listed(F.col("all")).alias("spans"))


@query
def op12_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-level and sentence-piece tokens of every text, and how usual their links are."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents")
    files = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), public_tokenizers.PATTERN
    found = alignment.align(documents, *files, keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def with_repetition(text: Column, doc_id: Column) -> Column:
    """Every tenth text, by its id's checksum, with its words repeated from one of them on."""
    def repeated(words: Column, n: Column, seed: Column) -> Column:
        a = seed % n
        p = 1 + F.floor((n - a) / (3 + seed % 8))
        picked = F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.array_join(picked, " ")

    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(squeeze(text), " "), lambda word: word != "")
    # Bound by a lambda, the words are cut once however often they are referred to.
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w, F.size(w).cast("long"), F.floor(h / 10))).otherwise(""))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), made).otherwise(text)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every text, the strongest of them, and the text without repetitions."""
    documents = table(spark, sf_dir, "documents").select("doc_id", with_repetition(F.col("text"), F.col("doc_id")).alias("text"))
    found = periods.periodic_runs(documents, keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    best = F.col("strongest")
    exponent = F.expr("strongest.length * 1000 div strongest.period")
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)
