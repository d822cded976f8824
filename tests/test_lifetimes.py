"""Live curves, runs that leave their table, and jobs that go on."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.operators.scoring import mean_reward
from tuneloom.operators.telemetry import LOG, TRAIN_BEGIN
from tuneloom.plans import jobs
from tuneloom.plans.spec import job_from_dict
from tuneloom.streaming import history, streams

SCORED = "run_id string, step long, reward_name string, reward double"


def test_curve_over_restarts_and_repeated_batches(spark, tmp_path):
    data = [(f"r{i % 2}", i % 5, "a" if i % 3 else "b", None if i % 7 == 0 else i / 4) for i in range(90)]
    live = streams.curve_table(f"{tmp_path}/rows", fold_every=2)
    for part in range(5):
        spark.createDataFrame(data[part::5], SCORED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        if part % 2:
            continue
        feed = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source")
        streams.curve_stream(feed, live, f"{tmp_path}/checkpoint").awaitTermination()
    whole = spark.createDataFrame(data, SCORED)
    columns = ["run_id", "step", "reward_name", F.round("mean_reward", 9), "n_rewards"]
    want = rows(mean_reward(whole, ["run_id", "step", "reward_name"]).select(*columns))
    assert rows(streams.current_curve(spark, live).select(*columns)) == want
    # A batch that runs again, folded or not, counts once.
    parts = sorted(glob.glob(f"{tmp_path}/rows/batch=*"), key=lambda p: int(p.split("=")[1]))
    again = int(parts[-1].split("=")[1])
    kept = spark.read.parquet(parts[-1])
    live.write(spark.createDataFrame(kept.collect(), kept.schema), again)
    assert rows(streams.current_curve(spark, live).select(*columns)) == want
    low, high = streams.current_curve(spark, live).agg(F.min("low"), F.max("high")).head()
    assert (low, high) == (0.25, 89 / 4)


EVENTS = "run_id string, kind string, seq long, step long, loss double, ts timestamp"
NOON = datetime(2024, 5, 1, 12)


def event(run, seq, minute, kind=LOG):
    return (run, kind, seq, seq, float(seq), NOON + timedelta(minutes=minute))


def shown(spark, live, lifetime=600):
    return [(r["run_id"], r["seq"]) for r in history.current_expiring(spark, live, lifetime).orderBy("run_id", "seq").collect()]


def write(spark, live, batch_id, *events):
    live.write(spark.createDataFrame(list(events), EVENTS), batch_id)


@pytest.mark.parametrize("fold_every", [1, 2, 50])
def test_silent_runs_leave_and_late_events_count(spark, tmp_path, fold_every):
    live = history.expiring_table(f"{tmp_path}/t", 600, max_points=3, fold_every=fold_every)
    write(spark, live, 0, event("a", 1, 0), event("a", 2, 1), event("b", 1, 1), event("c", 1, 0, TRAIN_BEGIN), event("c", 2, 1))
    assert shown(spark, live) == [("a", 1), ("a", 2), ("b", 1), ("c", 2)]
    write(spark, live, 1, event("b", 2, 9))
    assert shown(spark, live) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2)]
    write(spark, live, 2, event("b", 3, 16))
    # Nothing of a and c for more than ten minutes; b keeps its last three.
    assert shown(spark, live) == [("b", 1), ("b", 2), ("b", 3)]
    # An event of a that comes late by less than ten minutes: a is back, with all of its history.
    write(spark, live, 3, event("a", 3, 8))
    assert shown(spark, live) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]
    write(spark, live, 4, event("d", 1, 90))
    assert shown(spark, live) == [("d", 1)]
    # After such a silence a run begins a new history.
    write(spark, live, 5, event("b", 4, 91), event("c", 3, 89))
    assert shown(spark, live) == [("b", 4), ("c", 3), ("d", 1)]


def test_table_stays_bounded(spark, tmp_path):
    live = history.expiring_table(f"{tmp_path}/t", 600, max_points=2, fold_every=4)
    sizes = []
    for batch in range(32):
        write(spark, live, batch, *(event(f"run{batch}-{i}", n, 10 * batch + n) for i in range(3) for n in range(4)))
        if batch % 4 == 3:
            sizes.append((live.read(spark).count(), len(os.listdir(f"{tmp_path}/t"))))
    # What three to four batches hold, whether eight or thirty-two have come.
    assert max(sizes[2:]) <= max(sizes[1], sizes[2]) and sizes[-1][0] <= 4 * 3 * 3


SFT = {
    "type": "sft", "seed": 3, "dataset": {"name": "poems", "format": "raw_text", "key": "id"},
    "train": {"epochs": 2, "max_seq_length": 4},
}
GRPO = {
    "type": "grpo", "dataset": {"name": "poems", "key": "id"}, "prompt_column": "text", "num_generations": 2,
    "rewards": [{"name": "length_reward"}],
}


@pytest.fixture
def poems(spark, tmp_path):
    spark.range(40).select("id", F.concat(F.lit("a poem of some words "), "id").alias("text")).repartition(3).write.parquet(f"{tmp_path}/data/poems/train")
    return tl.DatasetCatalog(root=f"{tmp_path}/data")


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*.parquet")}


@pytest.mark.parametrize("spec, parts", [(SFT, ["texts", "schedule"]), (GRPO, ["prompts"])])
@pytest.mark.parametrize("when", ["before", "after"])
def test_job_killed_around_each_part(spark, poems, tmp_path, monkeypatch, spec, parts, when):
    from tuneloom.plans import parts as parts_module

    plain = job_from_dict({**spec, "output_dir": f"{tmp_path}/plain"})
    want = jobs.run_job(spark, poems, plain)
    real = parts_module.write_document
    for killed in range(len(parts)):
        job = job_from_dict({**spec, "output_dir": f"{tmp_path}/killed-{when}-{killed}"})
        seen = []

        def dying(session, path, document):
            if "/_parts/" in path:
                seen.append(path)
                if len(seen) == killed + 1:
                    if when == "after":
                        real(session, path, document)
                    raise KeyboardInterrupt("killed")
            real(session, path, document)

        monkeypatch.setattr(parts_module, "write_document", dying)
        with pytest.raises(KeyboardInterrupt):
            jobs.run_job(spark, poems, job)
        monkeypatch.setattr(parts_module, "write_document", real)
        finished = parts[:killed + (when == "after")]
        before = {part: stamps(f"{job.output_dir}/{part}") for part in finished}
        again = jobs.run_job(spark, poems, job)
        assert {**again, "output_dir": ""} == {**want, "output_dir": ""}
        for part in parts:
            assert rows(spark.read.parquet(f"{job.output_dir}/{part}")) == rows(spark.read.parquet(f"{plain.output_dir}/{part}"))
        assert all(stamps(f"{job.output_dir}/{part}") == before[part] != {} for part in finished)


def test_job_leaves_what_is_not_its_own(spark, poems, tmp_path):
    job = job_from_dict({**SFT, "output_dir": f"{tmp_path}/out"})
    spark.range(3).write.parquet(f"{tmp_path}/out/texts")
    for _ in range(2):
        with pytest.raises(ValueError, match="no job of this kind"):
            jobs.run_job(spark, poems, job)
    assert spark.read.parquet(f"{tmp_path}/out/texts").count() == 3
    first = job_from_dict({**SFT, "output_dir": f"{tmp_path}/other"})
    jobs.run_job(spark, poems, first)
    kept = stamps(f"{tmp_path}/other/texts")
    with pytest.raises(ValueError, match="other settings"):
        jobs.run_job(spark, poems, job_from_dict({**SFT, "seed": 4, "output_dir": f"{tmp_path}/other"}))
    assert stamps(f"{tmp_path}/other/texts") == kept


def test_job_sees_that_its_input_has_changed(spark, poems, tmp_path):
    job = job_from_dict({**SFT, "output_dir": f"{tmp_path}/out"})
    jobs.run_job(spark, poems, job)
    spark.range(40, 44).select("id", F.lit("new").alias("text")).write.mode("append").parquet(f"{tmp_path}/data/poems/train")
    again = jobs.run_job(spark, poems, job)
    assert again["rows"] == 44 and spark.read.parquet(f"{tmp_path}/out/schedule").count() == 88
