import functools
import resource

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tuneloom.functions.group_rewards import RelativeLength, distinct_share, longer_than_before, relative_length
from tuneloom.operators import scoring
from tuneloom.operators.scoring import score_group_reward
from tuneloom.plans import catalog, jobs

SCHEMA = "g long, position long, prompt string, completion string"


def table(spark, extra=False):
    data = [(g, i, "", None if i % 7 == 3 else f"{g} " * (i * 5 % 11)) for g in (1, 2, None) for i in range(20)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    return df.withColumn("other", F.concat(F.lit("o"), "position")) if extra else df


def test_distinct_share_by_aggregate_and_by_function(spark):
    df = table(spark)

    def plain(prompts, completions):
        return distinct_share(prompts, completions)

    scored = score_group_reward(df, {"name": distinct_share, "scope": "group"}, ["g"], "position")
    called = score_group_reward(df, {"name": plain, "scope": "group"}, ["g"], "position")
    assert scored.columns == [*df.columns, "distinct_share"]
    assert rows(scored) == rows(called)
    assert "collect_list" not in plan(called) + plan(scored)


def by_group(df):
    groups = {}
    for row in sorted(df.collect(), key=lambda r: r["position"]):
        groups.setdefault(row["g"], []).append(row)
    return groups


@pytest.mark.parametrize("extra", [False, True])
def test_plain_function_sees_groups_in_order(spark, extra):
    df = table(spark, extra)

    def place(prompts, completions, position):
        assert position == sorted(position) and len(position) == 20
        return [None if c is None else float(at * 100 + len(c)) for at, c in enumerate(completions)]

    scored = score_group_reward(df, {"name": place, "scope": "group", "columns": ["position"]}, ["g"], "position")
    assert scored.columns == [*df.columns, "place"] and scored.count() == 60
    for members in by_group(scored).values():
        assert [r["place"] for r in members] == place([], [r["completion"] for r in members], list(range(20)))


def test_two_keys_and_a_plain_function_of_wrong_length(spark):
    df = table(spark).withColumn("h", F.col("position") % 2)

    def short(prompts, completions):
        return [1.0]

    with pytest.raises(Exception, match="returned 1 values for 10"):
        score_group_reward(df, {"name": short, "scope": "group"}, ["g", "h"], "position").collect()


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("records", ["3", "1000"])
def test_generator_reads_batches_in_order(spark, monkeypatch, extra, records):
    df = table(spark, extra)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        scored = score_group_reward(df, {"name": longer_than_before, "scope": "group"}, ["g"], "position")
        groups = by_group(scored)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for members in groups.values():
        sizes = [len(r["completion"] or "") for r in members]
        assert [r["longer_than_before"] for r in members] == [float(all(s > t for t in sizes[:i])) for i, s in enumerate(sizes)]


def test_generator_with_columns_and_settings(spark):
    def shifted(batches, by=0.0):
        for _, _, columns in batches:
            yield [p + by for p in columns["position"]]

    spec = {"name": functools.partial(shifted, by=0.5), "scope": "group", "columns": ["position"]}
    scored = score_group_reward(table(spark), spec, ["g"], "position")
    assert scored.filter("partial <> position + 0.5").isEmpty() and scored.count() == 60


def test_generator_that_stops_early(spark):
    def early(batches):
        yield [0.0] * len(next(batches)[0])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        with pytest.raises(Exception, match="some batches only"):
            score_group_reward(table(spark), {"name": early, "scope": "group"}, ["g"], "position").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@pytest.mark.parametrize("states", [1, 10_000])
def test_merged_states(spark, monkeypatch, states):
    monkeypatch.setattr(scoring, "MOST_STATES", states)
    df = table(spark, extra=True)
    scored = score_group_reward(df, {"name": relative_length, "scope": "group"}, ["g"], "position")
    assert scored.columns == [*df.columns, "relative_length"] and scored.count() == 60
    for members in by_group(scored).values():
        want = relative_length([], [r["completion"] for r in members])
        assert [r["relative_length"] for r in members] == want and {0.0, 1.0} <= set(want)
    assert score_group_reward(df.limit(0), {"name": relative_length, "scope": "group"}, ["g"], "position").isEmpty()


class Spread(RelativeLength):
    """Needs another column."""

    name = "spread"

    def add(self, state, prompts, completions, position):
        return super().add(state, prompts, completions)

    def score(self, summary, prompts, completions, position):
        return [p + v for p, v in zip(position, super().score(summary, prompts, completions))]


def test_merged_states_with_columns(spark):
    scored = score_group_reward(table(spark), {"name": Spread(), "scope": "group", "columns": ["position"]}, ["g"], "position")
    assert scored.filter("spread < position or spread > position + 1").isEmpty()


def resident():
    """Megabytes this process has in memory now."""
    with open("/proc/self/statm") as pages:
        return int(pages.read().split()[1]) * resource.getpagesize() >> 20


def largest(batches):
    """Fails if the worker grows beyond what some batches take."""
    before = resident()
    for _, completions, _ in batches:
        if resident() > before + 500:
            raise MemoryError("the worker holds the group")
        yield [float(len(c)) for c in completions]


class Total(RelativeLength):
    """The longest of the group; ``before`` is what a worker had when it saw its first rows."""

    before = None

    def score(self, summary, prompts, completions):
        Total.before = Total.before or resident()
        if resident() > Total.before + 500:
            raise MemoryError("the worker holds the group")
        return [float(summary[1])] * len(completions)


@pytest.mark.parametrize("reward", [largest, Total()])
def test_group_larger_than_a_worker_may_hold(spark, reward):
    """One group of 1.2 GB; a worker may grow by 500 MB."""
    wide = spark.range(0, 12_000, numPartitions=16).select(
        F.lit(1).alias("g"), F.col("id").alias("position"), F.lit("").alias("prompt"),
        F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 100_000)).alias("completion"),
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        scored = score_group_reward(wide, {"name": reward, "scope": "group"}, ["g"], "position")
        value = F.col(scored.columns[-1])
        assert scored.agg(F.count(value), F.max(value)).head()[:] == (12_000, 100_005.0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_scored_job_gathers_no_group(spark, monkeypatch):
    plans = []

    def kept(df, path, **options):
        plans.append(plan(df))
        return write_rows(df, path, **options)

    write_rows = jobs.write_rows
    monkeypatch.setattr(jobs, "write_rows", kept)
    catalog.scored_job(spark, "/root/testdata/sf0.001")
    assert plans and "collect_list" not in plans[0]
