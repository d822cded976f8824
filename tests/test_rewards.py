import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.functions.resolve import Reward, output_names


def scores(spark, completions, *specs, schema="string", **defaults):
    df = spark.createDataFrame(
        [(i, "p", c) for i, c in enumerate(completions)], f"i int, prompt string, completion {schema}"
    )
    rewards = tl.resolve_rewards(specs, **defaults)
    out = tl.score_rewards(df, rewards).orderBy("i")
    names = output_names(rewards)
    got = [tuple(r[n] for n in names) for r in out.collect()]
    return [g[0] for g in got] if len(names) == 1 else got


def test_length(spark):
    spec = {"name": "length_reward", "kwargs": {"target_tokens": 100}}
    assert scores(spark, ["leaf " * n for n in (25, 100, 140, 260)], spec) == [0.25, 1.0, pytest.approx(0.6), 0.0]
    assert scores(spark, ["a"], "length_reward", target_tokens=10) == [pytest.approx(0.1)]
    assert scores(spark, ["", "a", None], "length_reward", target_tokens=0) == [1.0, 0.0, 1.0]
    assert scores(spark, ["word " * 256], "length_reward") == [1.0]


def test_length_of_messages(spark):
    messages = [[("assistant", "hi " * 50)]]
    schema = "array<struct<role:string,content:string>>"
    assert scores(spark, messages, "length_reward", schema=schema, target_tokens=50) == [1.0]


def test_regex(spark):
    spec = {"name": "regex_format_reward", "kwargs": {"pattern": r"\[total: \d+\]"}}
    assert scores(spark, ["[total: 7]", "total 7", "so [total: 31] it is", None], spec) == [1.0, 0.0, 1.0, 0.0]
    assert scores(spark, ["", "x\ny"], "regex_format_reward") == [1.0, 1.0]
    assert scores(spark, ["ABC"], "regex_format_reward", pattern="b", flags=2) == [1.0]
    with pytest.raises(ValueError, match="flags"):
        scores(spark, ["x"], "regex_format_reward", pattern="b", flags=4)


def test_regex_only_python_knows(spark):
    spec = {"name": "regex_format_reward", "kwargs": {"pattern": r"^(<)?\w+(?(1)>|!)$"}}
    assert scores(spark, ["<a>", "a!", "a>", None], spec) == [1.0, 1.0, 0.0, 0.0]


def test_contains(spark):
    assert scores(spark, ["Rain falls over a calm harbour"], "contains_reward", keywords=["rain", "harbour", "desert"]) == [pytest.approx(2 / 3)]
    assert scores(spark, ["MARBLE stairs"], "contains_reward", keywords=["marble"]) == [1.0]
    assert scores(spark, ["pebble"], "contains_reward") == [0.0]
    assert scores(spark, ["pebble"], "contains_reward", keywords=[]) == [0.0]
    assert scores(spark, ["ab"], "contains_reward", keywords=["a", "A", "x", ""]) == [0.75]


def test_contains_many_keywords(spark):
    words = [f"w{i}x" for i in range(60)] * 2
    assert scores(spark, ["w1x W2X"], "contains_reward", keywords=words) == [pytest.approx(4 / 120)]


def test_keyword_list():
    assert tl.parse_keywords(" a, ,b ,, c d ") == ["a", "b", "c d"]
    assert tl.parse_keywords(None) == []


def constant(prompts, completions, value=42.0, **_):
    return [value] * len(completions)


def too_few(prompts, completions):
    return [1.0]


def messages_seen(prompts, completions, tag):
    return [float(len(c) + len(t)) if isinstance(c, list) and isinstance(c[0], dict) else -1.0 for c, t in zip(completions, tag)]


def test_resolver_forms(spark):
    here = __name__
    assert scores(spark, ["x"], constant) == [42.0]
    assert scores(spark, ["x"], f"{here}:constant") == [42.0]
    assert scores(spark, ["x"], f"{here}.constant") == [42.0]
    assert scores(spark, ["x"], {"name": f"{here}.constant", "kwargs": {"value": 3.0}}, value=9.0) == [3.0]
    assert scores(spark, ["x"], f"{here}.constant", value=9.0) == [9.0]
    assert scores(spark, ["a b"], "tuneloom.functions.rewards.length_reward", target_tokens=2) == [1.0]
    assert tl.resolve_reward("tuneloom.functions.rewards.length_reward").native is not None
    assert isinstance(tl.resolve_reward(constant), Reward)


@pytest.mark.parametrize(
    "spec, error, message",
    [
        ("kindness", ValueError, "No reward is registered"),
        ("tuneloom.absent_part.score", ValueError, "does not load"),
        ("math:kindness", ValueError, "defines none of"),
        (5, TypeError, "reward spec"),
        ({"kwargs": {}}, ValueError, "Bad reward spec"),
        ({"name": "length_reward", "scope": "x"}, ValueError, "scope"),
    ],
)
def test_resolver_errors(spec, error, message):
    with pytest.raises(error, match=message):
        tl.resolve_reward(spec)


def test_at_least_one_reward():
    with pytest.raises(ValueError, match="At least one"):
        tl.resolve_rewards([])


def test_names_are_made_unique(spark):
    specs = ["length_reward", {"name": "length_reward", "kwargs": {"target_tokens": 1}}, constant]
    assert output_names(tl.resolve_rewards(specs)) == ["length_reward", "length_reward_2", "constant"]
    assert scores(spark, ["a"], *specs)[0][1:] == (1.0, 42.0)


def test_user_function_errors_and_columns(spark):
    df = spark.createDataFrame([("p", "a"), ("q", "b")], "prompt string, completion string").coalesce(1)
    with pytest.raises(Exception, match="returned 1 values for 2"):
        tl.score_rewards(df, [too_few]).collect()
    schema = "prompt string, completion array<struct<role:string,content:string>>, tag string"
    df = spark.createDataFrame([("p", [("user", "x"), ("user", "y")], "abc")], schema)
    assert rows(tl.score_rewards(df, [{"name": f"{__name__}:messages_seen", "columns": ["tag"]}]), "messages_seen") == [(5.0,)]


def test_user_module_file(spark, tmp_path):
    (tmp_path / "shout_reward.py").write_text(
        "def shout_reward(prompts, completions, **kw):\n    return [float(c.isupper()) for c in completions]\n"
    )
    (tmp_path / "other_reward.py").write_text("def reward(prompts, completions):\n    return [2.0 for _ in completions]\n")
    tl.register_user_rewards(spark, str(tmp_path / "shout_reward.py"), str(tmp_path / "other_reward.py"))
    assert tl.available_rewards() == ["length_reward", "regex_format_reward", "contains_reward", "other_reward", "shout_reward"]
    assert scores(spark, ["ABC", "abc"], "shout_reward") == [1.0, 0.0]
    assert scores(spark, ["ABC"], "other_reward") == [2.0]
    with pytest.raises(ValueError):
        tl.register_user_rewards(spark, "not a module.txt")


def test_weighted_total_takes_null_as_nothing(spark):
    specs = [{"name": "length_reward", "weight": 2.0}, {"name": "contains_reward", "weight": -0.5}]
    df = spark.createDataFrame([(0.5, 1.0), (None, 1.0), (None, None)], "length_reward double, contains_reward double")
    assert rows(tl.weighted_total(df, specs), "total_reward") == [(-0.5,), (0.0,), (0.5,)]


def test_existing_column_is_not_overwritten(spark):
    df = spark.createDataFrame([("a", 1.0)], "completion string, length_reward double")
    with pytest.raises(ValueError, match="already has"):
        tl.score_rewards(df, ["length_reward"])


def test_native_rewards_need_no_python_and_split_once(spark):
    df = spark.createDataFrame([("a",)], "completion string").repartition(2)
    out = tl.score_rewards(
        df,
        [
            {"name": "length_reward", "kwargs": {"target_tokens": 5}},
            {"name": "length_reward", "kwargs": {"target_tokens": 9}},
            {"name": "contains_reward", "kwargs": {"keywords": ["a", "b"]}},
            "regex_format_reward",
        ],
    )
    text = plan(out)
    assert "Python" not in text and "ArrowEval" not in text
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("split(") == 1
    assert optimized.count("lower(") == 1


def test_group_reward_sees_what_is_compared(spark):
    def share(prompts, completions):
        return [len(set(completions)) / len(completions)] * len(completions)

    data = [(g, i, "p", f"c{(g + i) % 3}") for g in range(5) for i in range(8)]
    df = spark.createDataFrame(data, "g int, gen_idx int, prompt string, completion string").repartition(7)
    for by, same in ((["g"], lambda a, b: a[0] == b[0]), (["g", "round"], lambda a, b: a[0] == b[0] and a[1] // 4 == b[1] // 4)):
        frame = df.withColumn("round", F.expr("gen_idx div 4"))
        out = tl.score_group_reward(frame, {"name": share, "scope": "group"}, by, "gen_idx").drop("round")
        expected = []
        for row in data:
            group = [d[3] for d in data if same(d, row)]
            expected.append((*row, len(set(group)) / len(group)))
        assert rows(out) == sorted(expected, key=repr)
    with pytest.raises(ValueError, match="group scope"):
        tl.score_rewards(df, [{"name": share, "scope": "group"}])


def test_long_rewards_and_mean(spark):
    df = spark.createDataFrame([("r", 1, 1.0, 0.0), ("r", 1, 0.5, None)], "run_id string, step int, a double, b double")
    long = tl.long_rewards(df, ["a", "b"])
    assert rows(long, "reward_name", "reward") == [("a", 0.5), ("a", 1.0), ("b", 0.0), ("b", None)]
    means = tl.mean_reward(long, ["run_id", "step", "reward_name"])
    assert rows(means) == [("r", 1, "a", 0.75, 2), ("r", 1, "b", 0.0, 1)]


def test_partitioning_does_not_change_scores(spark):
    df = spark.createDataFrame([(i, "w " * i) for i in range(40)], "i int, completion string")
    spec = [{"name": "length_reward", "kwargs": {"target_tokens": 20}}]
    results = [rows(tl.score_rewards(df.repartition(n), spec).select("i", F.col("length_reward"))) for n in (1, 4, 8)]
    assert results[0] == results[1] == results[2]
