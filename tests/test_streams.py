from datetime import datetime, timedelta

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.operators import telemetry as tm
from tuneloom.plans import catalog
from tuneloom.streaming import history, streams
from tuneloom.streaming.folded import FoldedTable

SCHEMA = "run_id string, seq bigint, kind string, step bigint, logs map<string,double>, ts timestamp"


class Feed:
    """A folder of event files; every ``add`` becomes one micro-batch."""

    def __init__(self, spark, root):
        self.spark, self.path, self.parts = spark, f"{root}/in", 0
        self.all = []

    def add(self, data):
        start = datetime(2024, 1, 1)
        full = [(r, s, k, st, lo, start + timedelta(seconds=s)) for r, s, k, st, lo in data]
        self.all += full
        self.spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)

    def batch(self):
        return self.spark.createDataFrame(self.all, SCHEMA)


BATCHES = [
    [("a", 1, "train_begin", 0, None), ("a", 2, "log", 1, {"loss": 1.0}), ("b", 1, "log", 1, {"loss": 5.0})],
    [("a", 5, "log", 4, {"loss": 0.4}), ("a", 3, "log", 2, {"loss": 0.8}), ("c", 1, "train_begin", 0, None)],
    [("a", 4, "log", 3, {"loss": 0.6}), ("b", 2, "train_begin", 0, None), ("c", 2, "log", 0, {})],
    [("a", 6, "log", 5, {"loss": 0.0}), ("b", 3, "log", 1, {"train_loss": 2.0})],
    [("a", 7, "train_begin", 0, None), ("d", 9, "log", 1, {"reward": 1.0})],
    # Late: older than the start that is already known.
    [("b", 1, "log", 9, {"loss": 9.0}), ("d", 8, "log", 2, {"loss": 3.0})],
]


@pytest.mark.parametrize("fold_every, stops", [(2, (1, 3, 5)), (100, (5,))])
def test_history_equals_batch_after_restarts(spark, tmp_path, fold_every, stops):
    feed = Feed(spark, tmp_path)
    live = history.history_table(f"{tmp_path}/ring", max_points=3, fold_every=fold_every)
    for i, batch in enumerate(BATCHES):
        feed.add(batch)
        if i not in stops:
            continue
        # Started anew each time: it goes on from the checkpoint.
        history.history_stream(feed.stream(), live, f"{tmp_path}/checkpoint").awaitTermination()
        got = rows(history.current_history(spark, live), "run_id", "seq", "step", "loss", "reward")
        assert got == rows(tm.metric_history(feed.batch(), 3), "run_id", "seq", "step", "loss", "reward")
    if fold_every == 2:
        assert live._parts(spark, "fold") == [3, 5]
        assert live._parts(spark, "batch") == [4, 5] or live._parts(spark, "batch") == [2, 3, 4, 5]


def test_latest_equals_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    live = streams.latest_table(f"{tmp_path}/latest", fold_every=2)
    for i, batch in enumerate(BATCHES[:5]):
        feed.add(batch)
        if i % 2:
            continue
        streams.latest_stream(feed.stream(), live, f"{tmp_path}/checkpoint").awaitTermination()
        got = rows(streams.current_latest(spark, live), "run_id", "seq", "loss")
        assert got == rows(tm.latest_points(feed.batch()), "run_id", "seq", "loss")


def test_folded_table_counts_a_repeated_batch_once(spark, tmp_path):
    live = FoldedTable(f"{tmp_path}/t", lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), fold_every=2)
    with pytest.raises(ValueError, match="No finished batch"):
        live.read(spark)
    for batch_id in (0, 0, 1, 1, 2, 2, 3):
        live.write(spark.createDataFrame([("x", 1)], "k string, v bigint"), batch_id)
    assert rows(live.read(spark)) == [("x", 4)]
    assert rows(live.read(spark, upto=2)) == [("x", 3)]


def test_formatting_stream_continues_from_its_checkpoint(spark, tmp_path):
    def write(*texts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        df = spark.readStream.schema("text string").parquet(f"{tmp_path}/in").transform(tl.format_rows("raw_text"))
        streams.append_stream(df, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    write("a", "b")
    assert run() == [("a",), ("b",)]
    assert run() == [("a",), ("b",)]
    write("c")
    assert run() == [("a",), ("b",), ("c",)]


def test_preview_of_a_stream(spark, tmp_path):
    spark.range(0, 30).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
    assert streams.first_streamed(stream, 4).count() == 4
    assert streams.first_streamed(stream, 99).count() == 30


def test_scoring_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, "w " * i) for i in range(20)], "i int, completion string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    spec = [{"name": "length_reward", "kwargs": {"target_tokens": 9}}, {"name": f"{__name__}:parity"}]
    with_prompt = df.withColumn("prompt", F.lit("p"))
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withColumn("prompt", F.lit("p"))
    streams.append_stream(tl.score_rewards(stream, spec), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(tl.score_rewards(with_prompt, spec))


def parity(prompts, completions):
    return [float(len(c) % 4) for c in completions]


def test_failing_capture_does_not_touch_the_scores_and_loses_nothing(spark, tmp_path):
    schema = "run_id string, step int, reward_name string, pos int, completion string, reward double"
    spark.createDataFrame([("r", 1, "len", 0, "a", 1.0)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    broken = streams.capture_table(f"{tmp_path}/samples", order=("no_such_column",))
    with pytest.raises(Exception):
        streams.capture_stream(stream, broken, f"{tmp_path}/c1").awaitTermination()
    streams.append_stream(stream, f"{tmp_path}/scores", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 1
    mended = streams.capture_table(f"{tmp_path}/samples")
    streams.capture_stream(stream, mended, f"{tmp_path}/c1").awaitTermination()
    assert mended.read(spark).count() == 1


def test_capture_keeps_the_first_of_a_step_over_all_batches(spark, tmp_path):
    data = [("r", i % 2, "len", 100 - i, f"c{i}", float(i)) for i in range(40)]
    schema = "run_id string, step int, reward_name string, pos int, completion string, reward double"
    spark.createDataFrame(data, schema).repartition(5, "pos").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = streams.capture_table(f"{tmp_path}/out", fold_every=2, max_per_step=3)
    streams.capture_stream(stream, live, f"{tmp_path}/c").awaitTermination()
    first = [sorted((d[3], d[4]) for d in data if d[1] == step)[:3] for step in (0, 1)]
    assert rows(live.read(spark), "pos", "completion") == sorted(first[0] + first[1], key=repr)


def test_live_log_tail(spark, tmp_path):
    data = [(f"run{i % 3}", i, datetime(2024, 1, 1, 9, 0, i % 60), f"line {i}") for i in range(90)]
    schema = "run_id string, seq bigint, ts timestamp, line string"
    df = spark.createDataFrame(data, schema)
    df.repartition(4, "seq").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live = streams.log_table(f"{tmp_path}/out", max_lines=5, fold_every=2)
    streams.log_stream(stream, live, f"{tmp_path}/c").awaitTermination()
    from tuneloom.operators.telemetry import log_tail

    assert rows(streams.current_log(spark, live, 5)) == rows(log_tail(df, 5))


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_file_or_a_folder_of_files(spark, tmp_path, files):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/documents.parquet.old")  # another table whose name begins alike
    assert rows(_stream_to_end(spark, tmp_path), "doc_id", "text") == rows(docs, "doc_id", "text")


def test_table_that_is_a_file(spark, tmp_path):
    assert rows(_stream_to_end(spark, SF, tmp_path), "doc_id", "text") == rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")


def _stream_to_end(spark, folder, out=None):
    out = f"{out or folder}/out"
    streams.append_stream(catalog._stream(spark, str(folder), "documents"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")
