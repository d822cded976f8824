import random
import statistics

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.operators import scale
from tuneloom.operators.scale import join_groups, previous_row, top_n


def skewed(n=600, seed=3):
    """(group, seq, value): one group holds more than a third of the rows; one group is null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", "c", None]), i, rng.randint(0, 9)) for i in range(n)]


def frame(spark, data, parts=7):
    return spark.createDataFrame(data, "g string, seq int, v int").repartition(parts)


@pytest.mark.parametrize("n", [1, 3, 50, 70])
@pytest.mark.parametrize("parts", [1, 40])
def test_top_n_equals_brute_force(spark, n, parts):
    data = skewed()
    expected = []
    for g in {d[0] for d in data}:
        expected += sorted((d for d in data if d[0] == g), key=lambda d: -d[1])[:n]
    assert rows(top_n(frame(spark, data, parts), n, [F.desc("seq")], ["g"])) == sorted(expected, key=repr)
    whole = sorted(data, key=lambda d: -d[1])[:n]
    assert rows(top_n(frame(spark, data, parts), n, [F.desc("seq")])) == sorted(whole, key=repr)


def test_top_n_goes_through_more_levels_when_cuts_are_large(spark, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_CUT", 20)
    data = skewed()
    df = top_n(frame(spark, data, 40), 10, [F.desc("seq")], ["g"])
    assert plan(df).count("row_number()") > plan(top_n(frame(spark, data, 40), 1, [F.desc("seq")], ["g"])).count("row_number()")
    expected = []
    for g in {d[0] for d in data}:
        expected += sorted((d for d in data if d[0] == g), key=lambda d: -d[1])[:10]
    assert rows(df) == sorted(expected, key=repr)


def test_top_n_cuts_before_the_shuffle(spark):
    for n in (4, 10_000):
        text = plan(top_n(frame(spark, skewed()), n, [F.desc("seq")], ["g"]))
        assert text.count(", Final") == text.count(", Partial") == 2


@pytest.mark.parametrize("stretch", [1, 2, 7, 50, 10_000])
def test_previous_row_equals_lag(spark, stretch):
    rng = random.Random(stretch)
    data = [(g, s, rng.choice([None, s * 10])) for g in ("hot", "a", "b") for s in rng.sample(range(-40, 300), 30 if g != "hot" else 150)]
    got = rows(previous_row(frame(spark, data), ["g"], "seq", {"prev_v": "v", "prev_seq": "seq"}, stretch))
    expected = []
    for g in ("hot", "a", "b"):
        before = None
        for d in sorted(d for d in [(x[1], x) for x in data if x[0] == g]):
            row = d[1]
            expected.append((*row, before is not None, before[2] if before else None, before[1] if before else None))
            before = row
    assert got == sorted(expected, key=repr)


def test_previous_row_with_null_groups_and_repeated_numbers(spark):
    data = [(g, i, i) for g in (None, "a") for i in range(25)] + [("b", 9, 1), ("b", 9, 2), ("b", 12, 3), (None, 30, 30)]
    got = previous_row(frame(spark, data), ["g"], "seq", {"before": "v"}, 10).collect()
    assert len(got) == len(data)
    for row in got:
        if row["g"] != "b":
            assert row["before"] == (24 if row["seq"] == 30 else row["seq"] - 1 if row["seq"] else None)
            assert row["has_previous"] == (row["seq"] > 0)
    assert [r["before"] in (1, 2) for r in got if r["g"] == "b" and r["seq"] == 12] == [True]


def test_texts_of_pairs_are_shuffled_once(spark):
    from pyspark.sql.types import StringType

    text = "t" * 1000
    turns = spark.createDataFrame([(c, t, "user" if t % 2 else "assistant", text) for c in range(50) for t in range(8)], "conv_id int, turn int, role string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = tl.dialogue_pairs(turns)
        pairs.collect()
        final = plan(pairs).split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert final.count("Exchange hashpartitioning") == 1 and isinstance(pairs.schema["prompt"].dataType, StringType)


@pytest.mark.parametrize("broadcast", [True, False])
def test_join_groups_with_null_keys(spark, broadcast):
    data = skewed(300) + [(f"g{i % 1500}", i, 1) for i in range(3000)]
    sums = {}
    for g, _, v in data:
        sums[g] = sums.get(g, 0) + v
    df = frame(spark, data)
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_group = df.groupBy("g").agg(F.sum("v").alias("s"))
        assert rows(join_groups(df, per_group, ["g"])) == sorted(((*d, sums[d[0]]) for d in data), key=repr)
        some = per_group.where("g = 'hot' or g is null")
        inner = rows(join_groups(df, some, ["g"], how="inner"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert inner == sorted(((*d, sums[d[0]]) for d in data if d[0] in ("hot", None)), key=repr)


def test_adaptive_execution_splits_a_large_group_of_equal_rows(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    data = [("hot", 1, 1)] * 20_000 + [(f"g{i}", i, 0) for i in range(50)]
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = frame(spark, data, 20)
        joined = join_groups(df, df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), ["g"])
        assert joined.where("g = 'hot' and n = 20000").count() == 20_000
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.mark.parametrize("ddof", [0, 1])
def test_group_advantage(spark, ddof):
    data = skewed(200) + [("single", 0, 5), ("flat", 0, 3), ("flat", 1, 3)]
    df = frame(spark, data).withColumn("total_reward", F.col("v").cast("double"))
    got = {(r["g"], r["seq"]): r["advantage"] for r in tl.group_advantage(df, ["g"], ddof=ddof, eps=0.5).collect()}
    for g in {d[0] for d in data}:
        values = [d[2] for d in data if d[0] == g]
        for d in (d for d in data if d[0] == g):
            if min(values) == max(values):
                expected = 0.0
            else:
                spread = statistics.stdev(values) if ddof else statistics.pstdev(values)
                expected = (d[2] - statistics.mean(values)) / (spread + 0.5)
            assert got[(g, d[1])] == pytest.approx(expected)
    assert len(got) == len(data)
    with pytest.raises(ValueError):
        tl.group_advantage(df, ["g"], ddof=2)


def test_prompt_column(spark):
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert tl.prompt_column(df, "question").columns == ["prompt", "answer"]
    with pytest.raises(ValueError, match="No column 'missing'"):
        tl.prompt_column(df, "missing")
    with pytest.raises(ValueError, match="another 'prompt'"):
        tl.prompt_column(df.withColumn("prompt", F.lit("x")), "question")
    same = tl.prompt_column(df, "question")
    assert tl.prompt_column(same) is same


def test_generation_slots(spark):
    df = spark.createDataFrame([("p",), ("q",)], "prompt string")
    assert rows(tl.generation_slots(df, 3)) == [(p, i) for p in ("p", "q") for i in range(3)]
    assert tl.generation_slots(df).count() == 8
    with pytest.raises(ValueError):
        tl.generation_slots(df, 0)


def test_join_completions(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "q"), (3, "unused")], "prompt_id int, prompt string")
    completions = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (9, 0, "lost")], "prompt_id int, gen_idx int, completion string")
    got = tl.join_completions(prompts, completions)
    assert got.columns == ["prompt_id", "prompt", "gen_idx", "completion"]
    assert rows(got) == [(1, "p", 0, "a"), (1, "p", 1, "b"), (2, "q", 0, "c")]


def test_zip_lists_stops_at_the_shortest(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b", None], ["x", "y"], [0.1, 0.2, 0.3]), (2, [], ["x"], [1.0]), (3, None, ["x"], [1.0])],
        "id int, p array<string>, c array<string>, r array<double>",
    )
    assert rows(tl.zip_lists(df, "p", "c", "r")) == [(1, 0, "a", "x", 0.1), (1, 1, "b", "y", 0.2)]


def test_dialogue_pairs(spark):
    data = [(1, 0, "assistant", "no prompt"), (1, 3, "user", "q"), (1, 4, "assistant", "a"), (1, 9, "assistant", "b"), (2, 0, "user", None), (2, 1, "assistant", "c")]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string").repartition(4)
    assert rows(tl.dialogue_pairs(df)) == [(1, 4, "q", "a"), (1, 9, "a", "b"), (2, 1, None, "c")]


def test_flagship_reads_texts_once_and_shuffles_only_rewards(spark):
    from conftest import SF
    from tuneloom.plans.catalog import queries

    df = queries()["group_relative_advantage"](spark, SF)
    text = plan(df)
    assert "Python" not in text
    for exchange in text.split("Exchange hashpartitioning")[1:]:
        above_scan = exchange.split("FileScan")[0]
        assert "SinglePartition" not in above_scan
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line and "text:string" in line]
    assert len(scans) == 1
