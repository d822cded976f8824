import pytest
from conftest import SF, plan, rows
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.plans import catalog, jobs, oracle
from tuneloom.plans.spec import job_from_dict, job_from_yaml
from tuneloom.sources.sinks import read_document

SFT = """
model_id: some/model
method: qlora
dataset:
  name: poems
  split: train[:6]
  format: alpaca
  column_map: {question: instruction, answer: output}
  key: id
train:
  epochs: 2
  learning_rate: 2.0e-4
  per_device_train_batch_size: 2
  gradient_accumulation_steps: 1
  max_seq_length: 30
output_dir: {out}
"""

GRPO = {
    "type": "grpo",
    "model_id": "x",
    "dataset": {"name": "poems", "config": None, "split": "train", "format": "raw_text", "order_by": "id", "max_samples": 5},
    "prompt_column": "question",
    "num_generations": 3,
    "max_prompt_length": 2,
    "rewards": [
        {"name": "regex_format_reward", "kwargs": {"pattern": r"\d+"}, "weight": 2.0},
        {"name": "length_reward", "kwargs": {"target_tokens": 8}},
    ],
}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("poems")
    rows_ = [(i, f"question number {i}", f"answer {i} " * (i + 1)) for i in range(10)]
    spark.createDataFrame(rows_, "id bigint, question string, answer string").repartition(3).write.parquet(f"{root}/poems/train")
    return tl.DatasetCatalog(root=str(root))


def test_defaults_and_round_trip():
    job = job_from_dict({"dataset": {"name": "d"}})
    assert (job.type, job.dataset.format, job.dataset.split, job.seed) == ("sft", "alpaca", "train", 42)
    assert (job.num_generations, job.max_prompt_length, job.prompt_column) == (4, 256, "prompt")
    assert (job.train.max_seq_length, job.train.save_total_limit, job.train.logging_steps) == (1024, 2, 5)
    grpo = job_from_dict(GRPO)
    assert grpo.rewards[0].kwargs == {"pattern": r"\d+"} and grpo.rewards[0].weight == 2.0
    assert grpo.rewards[1].weight == 1.0
    assert grpo.to_dict()["model_id"] == "x" and grpo.to_dict()["type"] == "grpo"
    assert job_from_dict(grpo.to_dict()).to_dict() == grpo.to_dict()


@pytest.mark.parametrize(
    "change, message",
    [
        ({"type": "weird"}, "Unknown job type"),
        ({"dataset": None}, "name|dataset|Bad settings"),
        ({"dataset": {"name": "d", "format": "not-a-format"}}, "Unknown format"),
        ({"dataset": {"name": "d", "colour": 1}}, "Unknown settings in dataset"),
        ({"rewards": [{"name": "r", "wait": 1}]}, "Unknown settings in rewards"),
        ({"dataset": {"name": "d", "max_samples": -1}}, "max_samples"),
    ],
)
def test_bad_specs(change, message):
    with pytest.raises(ValueError, match=message):
        job_from_dict({**GRPO, **change})


def test_no_rewards_is_a_valid_spec_but_not_a_job(spark, data, tmp_path):
    job = job_from_dict({**GRPO, "rewards": [], "output_dir": str(tmp_path)})
    assert job.rewards == []
    with pytest.raises(ValueError, match="At least one reward"):
        jobs.run_job(spark, data, job)


def test_sft_job(spark, data, tmp_path):
    job = job_from_yaml(SFT.replace("{out}", f"{tmp_path}/run"))
    summary = jobs.run_job(spark, data, job)
    assert summary["rows"] == 6 and summary["steps"] == 6 and summary["type"] == "sft"
    texts = spark.read.parquet(f"{tmp_path}/run/texts")
    assert texts.columns == ["id", "text", "n_tokens", "was_truncated"]
    assert summary["truncated"] == texts.where("was_truncated").count() > 0
    assert summary["tokens"] == texts.agg(F.sum("n_tokens")).head()[0]
    schedule = spark.read.parquet(f"{tmp_path}/run/schedule")
    assert schedule.count() == 12 and schedule.agg(F.max("step")).head()[0] == 5
    echo = read_document(spark, f"{tmp_path}/run/config")
    assert echo["type"] == "sft" and echo["method"] == "qlora" and echo["train"]["learning_rate"] == 2.0e-4
    assert read_document(spark, f"{tmp_path}/run/summary")["rows"] == 6


def test_grpo_job_and_scoring(spark, data, tmp_path):
    job = job_from_dict({**GRPO, "output_dir": f"{tmp_path}/run"})
    summary = jobs.run_job(spark, data, job)
    assert summary == {"output_dir": f"{tmp_path}/run", "type": "grpo", "num_rewards": 2, "rows": 15, "truncated": 15}
    prompts = spark.read.parquet(f"{tmp_path}/run/prompts")
    assert rows(prompts.where("id = 3"), "prompt", "gen_idx") == [("question number", i) for i in range(3)]

    def openings(prompts, completions):
        return [float(len(set(completions)))] * len(completions)

    completions = prompts.select("id", "gen_idx", "prompt", F.concat(F.lit("word "), F.col("gen_idx").cast("string")).alias("completion"))
    scored = jobs.scored_completions(completions, job, ["id"])
    row = scored.where("id = 3 and gen_idx = 0").head()
    assert (row["regex_format_reward"], row["length_reward"], row["total_reward"]) == (1.0, 0.25, 2.25)
    assert row["advantage"] == 0.0 and scored.count() == 15


def test_scoring_with_group_reward_and_repeated_names(spark, data):
    job = job_from_dict(
        {**GRPO, "rewards": [
            {"name": "length_reward", "kwargs": {"target_tokens": 1}},
            {"name": "length_reward", "kwargs": {"target_tokens": 2}, "weight": 0.5},
            {"name": f"{__name__}:distinct", "scope": "group"},
        ]}
    )
    data_ = [(1, 0, "p", "a"), (1, 1, "p", "a b"), (1, 2, "p", "a"), (1, 3, "p", "c")]
    df = spark.createDataFrame(data_, "id int, gen_idx int, prompt string, completion string")
    out = jobs.scored_completions(df, job, ["id"])
    assert rows(out, "gen_idx", "length_reward", "length_reward_2", "distinct", "total_reward") == [
        (0, 1.0, 0.5, 3.0, 4.25), (1, 0.0, 1.0, 3.0, 3.5), (2, 1.0, 0.5, 3.0, 4.25), (3, 1.0, 0.5, 3.0, 4.25)
    ]


def distinct(prompts, completions):
    return [float(len(set(completions)))] * len(completions)


def test_scoring_job_counts_late_answers_and_resumes(spark, tmp_path):
    job = job_from_dict({
        "type": "grpo", "dataset": {"name": "x"}, "output_dir": f"{tmp_path}/scored", "max_completion_length": 8,
        "rewards": [{"name": "regex_format_reward", "kwargs": {"pattern": "</answer>"}}],
    })
    data_ = [(i % 3, i, "p", "word " * 300 + ("</answer>" if i % 2 else "")) for i in range(12)]
    df = spark.createDataFrame(data_, "step int, gen_idx int, prompt string, completion string")
    summary = jobs.run_scoring(spark, df, job, ["step"], "step")
    assert summary["rows"] == 12 and summary["mean_total"] == 0.5 and summary["samples"] == 12
    scores = spark.read.parquet(f"{tmp_path}/scored/scores")
    assert rows(scores, "gen_idx", "total_reward") == sorted(((i, float(i % 2)) for i in range(12)), key=repr)
    assert scores.where("length(completion) < 1500").isEmpty()
    again = jobs.run_scoring(spark, df.limit(0), job, ["step"], "step")
    assert again == summary


def test_stream_texts(spark, data, tmp_path):
    job = job_from_dict({"dataset": {"name": "poems", "column_map": {"question": "instruction"}, "key": "id"}, "output_dir": f"{tmp_path}/s"})
    jobs.stream_texts(spark, data, job).awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/s/texts")
    assert rows(streamed) == rows(jobs.training_texts(spark, data, job))
    jobs.resume_texts(spark, data, f"{tmp_path}/s").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s/texts").count() == streamed.count()
    with pytest.raises(FileNotFoundError, match="holds no job"):
        jobs.resume_texts(spark, data, f"{tmp_path}/nowhere")


def test_every_query_has_sql_and_runs_on_whole_tables(spark):
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    from tools.check import canonical

    mine = catalog.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(oracle.oracle_sql()[name]).fetch_df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_plans_have_no_cross_joins_and_python_only_in_user_rewards(spark):
    skipped = {"sink_summary", "stream_format", "stream_score", "stream_latest", "stream_ring", "stream_capture"}
    with_python = set()
    for name, query in catalog.queries().items():
        if name in skipped:
            continue
        text = plan(query(spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        if any(sign in text for sign in ("Python", "ArrowEval", "InArrow")):
            with_python.add(name)
    groups = {"reward_group_lists", "reward_group_stream", "reward_group_merge"}
    assert with_python == {"reward_user_udf", "reward_user_columns", "reward_contains_many", *groups}


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection
