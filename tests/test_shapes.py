"""Items whose shape differs by row, and long keyword lists."""

import json
import time

import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.functions.rewards import count_keywords
from tuneloom.functions.text import first_field, flat_column, parsed_shapes


def by_hand(item):
    """The same on Python values; null is '', what is nested deeper is JSON."""
    def text(value):
        if value is None:
            return ""
        if isinstance(value, (list, dict)):
            return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        return str(value)

    if isinstance(item, list):
        return "\n".join(text(e.get("content")) if isinstance(e, dict) else text(e) for e in item)
    return text(item["content"] if isinstance(item, dict) and "content" in item else item)


ITEMS = [
    "text", "", "true", "5", "[1]", '{"content":"x"}', None, True, False, 5, -7, 2.5, [], {},
    ["a", "b"], ["a", {"content": "b"}, 3, True, None, [1, ["c"]], {"role": "x"}, 1.25, {"content": None}, {"content": ["p", "q"]}],
    {"content": "c", "role": "r"}, {"content": ""}, {"content": None}, {"content": 12}, {"content": False}, {"content": {"a": [1, 2]}},
    {"other": 1}, [[]], [{}], ["é 🙂\n", {"content": "line\nbreak"}], [None], ["\"quoted\""],
]


def test_flatten_by_row(spark):
    data = [(i, json.dumps(item)) for i, item in enumerate(ITEMS)] + [(-1, None), (-2, "no JSON ["), (-3, "")]
    df = spark.createDataFrame(data, "i int, j string").withColumn("completion", parsed_shapes(F.col("j")))
    found = dict(rows(df.select("i", flat_column(df, "completion"))))
    want = {i: by_hand(item) for i, item in enumerate(ITEMS)} | {-1: "", -2: "no JSON [", -3: ""}
    assert found == want


def test_rewards_of_mixed_shapes(spark):
    data = [(i, "p", json.dumps(item)) for i, item in enumerate(ITEMS)]
    df = spark.createDataFrame(data, "i int, prompt string, j string").withColumn("completion", parsed_shapes(F.col("j"))).drop("j")
    scored = tl.score_rewards(df, [{"name": "contains_reward", "kwargs": {"keywords": ["b", "TRUE"]}}])
    found = {r["i"]: r["contains_reward"] for r in scored.collect()}
    assert found == {i: sum(w in by_hand(item).lower() for w in ("b", "true")) / 2 for i, item in enumerate(ITEMS)}


def test_messages_of_mixed_rows(spark):
    data = [
        (1, '{"messages":[{"role":"user","content":"Hi"},{"from":"gpt","value":"Yo"},{"role":"","from":"human","content":"","value":"v"},"bare"]}'),
        (2, '{"conversations":[{"from":"human","value":"Q"}],"messages":[{"role":"x","content":"y"}]}'),
        (3, '{"conversations":[],"messages":[{"role":"x","content":"y"}]}'),
        (4, '{"conversations":null,"messages":[{"role":"x","content":"y"}]}'),
        (5, "{}"), (6, '{"conversations":"text"}'), (7, None),
    ]
    df = spark.createDataFrame(data, "i int, row string").withColumn("row", F.parse_json("row"))
    lists = df.select("i", first_field(F.col("row"), "conversations", "messages").alias("conversations"))
    plain = dict(rows(lists.transform(tl.format_rows("sharegpt", keep=["i"]))))
    assert plain == {1: "User: Hi\nGpt: Yo\nHuman: v\n: bare", 2: "Human: Q", **{i: "" for i in (3, 4, 5, 6, 7)}}
    tagged = dict(rows(lists.transform(tl.format_rows("sharegpt", template="role_colon", keep=["i"]))))
    assert tagged[1] == "user: Hi\nassistant: Yo\nuser: v\n: bare" and tagged[2] == "user: Q" and tagged[5] == ""


letters = st.text(alphabet="abAB İΣß", max_size=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(letters, min_size=1, max_size=30), st.lists(st.one_of(st.none(), st.text(alphabet="abAB İΣß", max_size=30)), max_size=5))
def test_automaton_counts_like_searches(words, texts):
    words = tuple(word.lower() for word in words)
    assert count_keywords(texts, words) == [sum(w in (t or "").lower() for w in words) for t in texts]


@pytest.mark.parametrize("n", [50, 51, 400])
def test_both_sides_of_the_limit(spark, n):
    words = [f"w{i}x" if i % 2 else f"W{i}X" for i in range(n - 2)] + ["", "w1x"]
    texts = ["w1x W2X", None, "", " ".join(words), "ww1x-W3x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, completion string").withColumn("prompt", F.lit(""))
    scored = tl.score_rewards(df, [{"name": "contains_reward", "kwargs": {"keywords": words}}])
    found = {r["i"]: r["contains_reward"] for r in scored.collect()}
    assert found == {i: pytest.approx(sum(w.lower() in (t or "").lower() for w in words) / n) for i, t in enumerate(texts)}


def test_time_does_not_depend_on_the_number_of_words():
    texts = [" ".join(f"word{(i * 7919 + j) % 100_003}" for j in range(2_000)) for i in range(60)]
    seconds = {}
    for n in (10, 10_000):
        words = tuple(f"sought{i}x" for i in range(n))
        count_keywords(texts[:1], words)
        tries = []
        for _ in range(3):
            started = time.perf_counter()
            count_keywords(texts, words)
            tries.append(time.perf_counter() - started)
        seconds[n] = min(tries)
    assert seconds[10_000] < 3 * seconds[10] + 0.05
