import random

from conftest import plan, rows
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.operators.scale import dense_positions

SCHEMA = "conv_id long, turn long, role string, text string"


def turns():
    deal = random.Random(9)
    out = [(conv, turn * deal.choice([1, 1000]) + conv, deal.choice(["user", "assistant", "system"]), f"{conv}:{turn}")
           for conv in (1, 2, 3, None) for turn in range(deal.randrange(1, 12)) for conv in [conv] if conv is not None]
    # Half of all turns in one dialogue, and one without an id.
    out += [(7, 3 * turn, deal.choice(["user", "assistant"]), f"7:{turn}") for turn in range(800)]
    out += [(None, turn, "user" if turn % 3 else "assistant", f"none:{turn}") for turn in range(30)]
    kept = {}
    for row in out:
        kept.setdefault(row[:2], row)
    return list(kept.values())


def test_zip_with_one_huge_dialogue(spark):
    data = turns()
    want = []
    for conv in {row[0] for row in data}:
        texts = {role: [r[3] for r in sorted(data, key=lambda r: r[1]) if r[0] == conv and r[2] == role] for role in ("user", "assistant")}
        want += [(conv, i, *pair) for i, pair in enumerate(zip(texts["user"], texts["assistant"]))]
    found = tl.zip_roles(spark.createDataFrame(data, SCHEMA).repartition(6))
    assert found.columns == ["conv_id", "pos", "prompt", "completion"]
    assert rows(found) == sorted(want, key=repr)
    assert plan(found).count("Window") <= 4 and "turn" not in "".join(line for line in plan(found).splitlines() if "Window" in line)


def test_positions_are_dense(spark):
    df = spark.range(5_000, numPartitions=4).select((F.col("id") % 7 % 3).alias("g"), F.lit("k").alias("h"), (F.col("id") * 11 % 5_003).alias("o"))
    found = dense_positions(df, ["g", "h"], "o")
    members = {}
    for g, o, pos in found.select("g", "o", "pos").collect():
        members.setdefault(g, []).append((o, pos))
    assert sum(map(len, members.values())) == 5_000
    assert all([pos for _, pos in sorted(some)] == list(range(len(some))) for some in members.values())
    assert dense_positions(df.limit(0), ["g"], "o").isEmpty()
