"""The driver's test tables in the shapes the operators expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tuneloom.operators.prompts import conversations, dialogue_pairs
from tuneloom.operators.scale import previous_row
from tuneloom.operators.scoring import long_rewards, score_rewards
from tuneloom.operators.telemetry import FAILURE, LOG, TRAIN_BEGIN

REWARDS = [
    {"name": "length_reward", "kwargs": {"target_tokens": 150}, "weight": 1.0},
    {"name": "regex_format_reward", "kwargs": {"pattern": r"\n\w+ on "}, "weight": 0.5},
    {"name": "contains_reward", "kwargs": {"keywords": ["tion", "ING", "zebra"]}, "weight": 0.25},
]
REWARD_NAMES = [reward["name"] for reward in REWARDS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instruction_rows(documents: DataFrame) -> DataFrame:
    """Two of three rows carry an input; the others a blank one."""
    return documents.select(
        "doc_id",
        F.concat(F.lit("Summarise text in "), "lang").alias("instruction"),
        F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise(F.lit("  \n ")).alias("input"),
        F.col("source").alias("output"),
    )


def turn_lists(turns: DataFrame) -> DataFrame:
    return conversations(turns)


def mixed_completions(turns: DataFrame) -> DataFrame:
    """One completion a dialogue, as JSON text; by turns a string, lists of strings, of messages and of anything, messages, null."""
    lists = turn_lists(turns)
    first, last = F.col("messages")[0], F.element_at("messages", -1)

    def text(column):
        return F.to_json(column.cast("variant"))

    odd = F.concat(
        F.lit("["), F.to_json(F.struct(first["content"].alias("content"))), F.lit(","), text(last["content"]),
        F.lit(',7,true,null,[1,"a"],{"role":"user"},2.5]'),
    )
    shapes = [
        text(first["content"]),
        F.to_json(F.transform("messages", lambda m: m["content"])),
        F.to_json("messages"),
        F.to_json(first),
        F.to_json(F.struct(first["role"].alias("role"))),
        odd,
        F.lit(None).cast("string"),
        F.lit("not JSON {"),
    ]
    chosen = F.lit("null")
    for i, shape in enumerate(shapes):
        chosen = F.when(F.col("conv_id") % 9 == i, shape).otherwise(chosen)
    return lists.select("conv_id", chosen.alias("completion"))


def mixed_dialogues(turns: DataFrame) -> DataFrame:
    """Dialogues as JSON rows that name list and fields by turns one way and the other; some have an empty list first."""
    named = F.struct(F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations"))
    usual = F.to_json(F.struct("messages"))
    empty = F.concat(F.lit('{"conversations":[],'), F.substring(usual, 2, 1 << 30))
    kind = F.col("conv_id") % 3
    return turn_lists(turns).select("conv_id", F.when(kind == 0, usual).when(kind == 1, F.to_json(named)).otherwise(empty).alias("row"))


def answer_rows(turns: DataFrame) -> DataFrame:
    """Assistant turns as completions, without looking at their neighbours."""
    return turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("completion"))


def pair_rows(turns: DataFrame) -> DataFrame:
    return dialogue_pairs(turns)


def scored_turns(turns: DataFrame) -> DataFrame:
    """Rewards of every answer that has a turn before it, without the texts.

    Turns are scored where they are read, so only ids and rewards are shuffled.
    """
    answered = F.when(F.col("role") == "assistant", F.col("text"))
    scored = score_rewards(turns.withColumn("completion", answered), REWARDS)
    narrow = scored.select("conv_id", "turn", "role", *REWARD_NAMES)
    found = previous_row(narrow, ["conv_id"], "turn", {})
    answers = found.where((F.col("role") == "assistant") & F.col("has_previous"))
    return answers.select("conv_id", "turn", *REWARD_NAMES)


def _placed(scored: DataFrame, texts: Sequence[str] = (), rewards: Sequence[str] = REWARD_NAMES) -> DataFrame:
    """Ten dialogues make one step."""
    return scored.select(
        F.lit("run").alias("run_id"),
        F.expr("conv_id div 10").alias("step"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        *texts,
        *rewards,
    )


def reward_rows(turns: DataFrame) -> DataFrame:
    """Rewards of the pairs in long form."""
    return long_rewards(_placed(scored_turns(turns)), REWARD_NAMES)


def sample_pairs(turns: DataFrame) -> DataFrame:
    """Pairs with their texts at their step and place, not scored yet."""
    return _placed(pair_rows(turns), ["prompt", "completion"], [])


def answer_samples(turns: DataFrame) -> DataFrame:
    """Scored answers in long form, each by itself, so that it also works on a stream."""
    placed = _placed(score_rewards(answer_rows(turns), REWARDS), ["completion"])
    return long_rewards(placed, REWARD_NAMES)


def many_keywords() -> list[str]:
    """500 keywords by a rule: pairs and triples of letters, every third upper-case; the first fifty come twice."""
    letters = "etaoinshrdlucmfwypvbgk"
    pairs = [a + b for a in letters for b in letters][:300]
    words = pairs + [pair + letters[i % 9] for i, pair in enumerate(pairs[:150])]
    words += words[:50]
    return [word.upper() if i % 3 == 0 else word for i, word in enumerate(words)]


def log_events(events: DataFrame) -> DataFrame:
    """Events as trainer logs of one run per user."""
    value, none = F.col("value"), F.expr("cast(map() as map<string,double>)")

    def entry(name: str):
        return F.create_map(F.lit(name), value)

    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", TRAIN_BEGIN).when(kind == "error", FAILURE).otherwise(LOG).alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("step"),
        F.when(kind == "view", entry("loss"))
        .when(kind == "purchase", entry("train_loss"))
        .when(kind == "click", entry("reward"))
        .otherwise(none)
        .alias("logs"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat("event_type", F.lit(" "), "props").alias("line"),
    )


def manifest(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "purchase", F.concat(F.lit("checkpoint-"), F.col("event_id").cast("string")))
        .when(kind == "click", "checkpoint-foo")
        .otherwise("logs")
    )
    return events.select(
        F.col("user_id").alias("run_id"), name.alias("path"), (kind != "view").alias("is_dir")
    )
