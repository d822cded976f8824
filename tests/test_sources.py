import json
import os

import pytest
from conftest import SF, plan, rows
from pyspark.sql import functions as F

import tuneloom as tl
from tuneloom.session import discard, stored
from tuneloom.sources import order
from tuneloom.sources.datasets import parse_split
from tuneloom.sources.order import key_positions, positional_slice
from tuneloom.sources.sinks import read_document, write_document


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The same rows as partitioned columns and as directories."""
    root = tmp_path_factory.mktemp("data")
    df = spark.range(0, 60).select(
        (F.col("id") * 3).alias("doc_id"),
        F.concat(F.lit("text "), "id").alias("text"),
        F.when(F.col("id") % 2 == 0, "main").otherwise("extra").alias("config"),
        F.when(F.col("id") < 50, "train").otherwise("test").alias("split"),
    ).repartition(5)
    df.write.partitionBy("config", "split").parquet(f"{root}/partitioned/set")
    df.where("split = 'train' and config = 'main'").drop("config", "split").write.json(f"{root}/dirs/set/main/train")
    df.where("split = 'test'").drop("config", "split").write.csv(f"{root}/csv/set/test", header=True)
    df.where("split = 'test'").select("text").write.text(f"{root}/txt/set/test")
    df.where("split = 'test'").drop("config", "split").write.orc(f"{root}/orc/set/test")
    return root


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_split_strings():
    assert parse_split("train").sliced is False
    split = parse_split("train[:1000]")
    assert (split.name, split.positions(lambda: 1 / 0)) == ("train", (0, 1000))
    assert parse_split("train[200:500]").positions(lambda: 1 / 0) == (200, 500)
    assert parse_split("train[5:]").positions(lambda: 1 / 0) == (5, None)
    assert parse_split("train[-10:]").positions(lambda: 100) == (90, 100)
    assert parse_split("train[:-10]").positions(lambda: 100) == (0, 90)
    assert parse_split("train[10%:50%]").positions(lambda: 33) == (3, 16)
    assert parse_split("train[50:20]").positions(lambda: 100) == (50, 50)
    for bad in ("train[", "train[a:b]", "train[1:2:3]", "train+test", "", "train[:5%:]", "train[1:50%]", "train[:500%]"):
        with pytest.raises(ValueError):
            parse_split(bad)


def test_partitioned_layout_prunes(spark, table):
    catalog = tl.DatasetCatalog(root=f"{table}/partitioned", layout="partitions")
    df = tl.load_dataset(spark, catalog, "set", config="main", split="train")
    assert ids(df) == [i * 3 for i in range(0, 50, 2)]
    scan = next(line for line in plan(df).splitlines() if "FileScan" in line)
    assert "split" in scan.split("PartitionFilters")[1] and "config" in scan.split("PartitionFilters")[1]


def test_directory_layout_and_formats(spark, table):
    json_files = tl.DatasetCatalog(root=f"{table}/dirs", file_format="json")
    assert len(ids(tl.load_dataset(spark, json_files, "set", config="main"))) == 25
    csv = tl.DatasetCatalog(root=f"{table}/csv", file_format="csv", options={"header": "true"})
    assert tl.load_dataset(spark, csv, "set", split="test").count() == 10
    text = tl.DatasetCatalog(root=f"{table}/txt", file_format="text")
    assert tl.load_dataset(spark, text, "set", split="test").columns == ["value"]
    orc = tl.DatasetCatalog(paths={"other": f"{table}/orc/set"}, file_format="orc")
    assert len(ids(tl.load_dataset(spark, orc, "other", split="test"))) == 10
    with pytest.raises(ValueError):
        tl.DatasetCatalog(file_format="xml")


def test_slice_then_max_samples(spark, table):
    catalog = tl.DatasetCatalog(root=f"{table}/partitioned", layout="partitions")

    def load(split, n=None):
        return ids(tl.load_dataset(spark, catalog, "set", split=split, max_samples=n, order_by="doc_id"))

    assert load("train[:4]") == [0, 3, 6, 9]
    assert load("train[10:13]", 2) == [30, 33]
    assert load("train[48:]", 100) == [144, 147]
    assert load("train", 3) == [0, 3, 6]
    assert load("train", 0) == []
    assert load("train[-2:]") == [144, 147]
    assert load("train[:10%]") == [0, 3, 6, 9, 12]
    assert load("train[90:]") == []
    assert len(load("train", 500)) == 50
    with pytest.raises(ValueError, match="order_by"):
        tl.load_dataset(spark, catalog, "set", split="train[:4]")


def test_stream_ignores_max_samples_and_refuses_slices(spark, table, caplog):
    catalog = tl.DatasetCatalog(root=f"{table}/dirs", file_format="json")
    df = tl.load_dataset(spark, catalog, "set", config="main", streaming=True, max_samples=3)
    assert df.isStreaming and "ignored" in caplog.text
    with pytest.raises(ValueError, match="cannot be sliced"):
        tl.load_dataset(spark, catalog, "set", config="main", split="train[:3]", streaming=True)


@pytest.mark.parametrize("cast", ["int", "bigint", "date", "timestamp", "timestamp_ntz", "string", "double"])
def test_positional_slice_for_every_key_type(spark, monkeypatch, cast):
    monkeypatch.setattr(order, "SORTED_KEYS", 5)
    monkeypatch.setattr(order, "FAN_OUT", 4)
    # Clustered keys with far outliers, so that single ranges hold almost everything.
    numbers = [*range(0, 300, 2), -40_000, 900_000, 900_001]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").repartition(6)
    key = {
        "date": F.date_from_unix_date((F.col("n") / 100).cast("int") * 0 + F.col("n").cast("int")),
        "timestamp": F.timestamp_seconds("n"),
        "timestamp_ntz": F.timestamp_seconds("n").cast("timestamp_ntz"),
        "string": F.lpad((F.col("n") + 50_000).cast("string"), 9, "0"),
    }.get(cast, F.col("n").cast(cast))
    df = df.select("n", key.alias("k"))
    ordered = sorted(numbers)
    for start, stop in [(0, 7), (3, 90), (149, 152), (150, 160), (500, None), (5, 5)]:
        got = sorted(r["n"] for r in positional_slice(df, "k", start, stop).collect())
        assert got == ordered[start:stop], (start, stop)


def test_positional_slice_over_the_whole_64_bit_range(spark, monkeypatch):
    monkeypatch.setattr(order, "SORTED_KEYS", 3)
    numbers = [-(2**63), -(2**62), -5, 0, 7, 2**61, 2**62 + 3, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "k bigint")
    assert [r["k"] for r in positional_slice(df, "k", 2, 6).orderBy("k").collect()] == numbers[2:6]


def test_positional_slice_by_several_keys(spark):
    data = [(i % 4, chr(97 + i // 4)) for i in range(40)]
    df = spark.createDataFrame(data, "a int, b string").repartition(5)
    assert rows(positional_slice(df, ["a", "b"], 7, 23)) == sorted(sorted(data)[7:23], key=repr)
    assert rows(key_positions(df, ["a", "b"]), "pos", "a", "b") == sorted(((i, *d) for i, d in enumerate(sorted(data))), key=repr)


def test_slice_rejects_bad_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="not unique"):
        positional_slice(df.where("k = 1"), "k", 0, 1)
    with pytest.raises(ValueError, match="null"):
        positional_slice(spark.createDataFrame([(1,), (None,)], "k int"), "k", 0, 1)


def test_slice_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    sliced = positional_slice(df, "doc_id", 20, 30).select("doc_id")
    scan = next(line for line in plan(sliced).splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(doc_id,20)" in scan and "LessThan(doc_id,30)" in scan
    assert "text" not in scan.split("ReadSchema")[1]


def test_list_columns_and_preview(spark):
    df = spark.createDataFrame([(i, f"t{i}" * 200, None) for i in range(8)], "id int, text string, note string").repartition(3)
    assert tl.list_columns(df) == ["id", "text", "note"]
    assert tl.list_columns({"train": df.select("id"), "test": df}) == ["id"]
    assert [r["id"] for r in tl.first_rows(df, "id").collect()] == [0, 1, 2, 3, 4]
    assert [r["id"] for r in tl.first_rows(df, "id", 50).collect()] == list(range(8))
    shown = tl.preview_json(df, "id", 2).collect()
    assert shown[0]["row_json"].startswith('{"id":0,"text":"t0t0') and len(shown[0]["row_json"]) == 200
    short = tl.preview_json(df.select("id", "note"), "id", 1).head()["row_json"]
    assert json.loads(short) == {"id": 0, "note": None}
    text = tl.preview_formatted(df, "id", "raw_text", n=2).head()["preview"]
    assert text == ("t0" * 200)[:400] + "\n\n---\n\n" + ("t1" * 200)[:400]


def test_write_rows_measures_while_writing(spark, tmp_path):
    df = spark.range(0, 250).repartition(2)
    got = tl.write_rows(df, f"{tmp_path}/out", measures={"total": F.sum("id")}, max_rows_per_file=50)
    assert got == {"rows": 250, "total": sum(range(250))}
    assert len(list((tmp_path / "out").glob("*.parquet"))) >= 5
    write_document(spark, f"{tmp_path}/doc", {"type": "sft", "n": 3})
    assert read_document(spark, f"{tmp_path}/doc") == {"type": "sft", "n": 3}


@pytest.mark.parametrize("kind, keys", [
    ("bigint", [1, 1, 1, 2, 5, 5]), ("string", ["a", "a", "a", "b", "c", "c"]), ("date", None),
])
def test_repeated_keys_are_exact_or_refused(spark, kind, keys):
    from datetime import date

    keys = keys or [date(2024, 1, d) for d in (1, 1, 1, 2, 5, 5)]
    df = spark.createDataFrame([(k,) for k in keys], f"k {kind}").repartition(3)
    for start in range(7):
        for stop in range(start, 7):
            parted = any(0 < edge < 6 and keys[edge - 1] == keys[edge] for edge in (start, stop)) and start != stop
            if parted:
                with pytest.raises(ValueError, match="not unique"):
                    positional_slice(df, "k", start, stop).collect()
            else:
                assert sorted(r["k"] for r in positional_slice(df, "k", start, stop).collect()) == keys[start:stop]


@pytest.mark.parametrize("kind, keys", [("bigint", [None, 1, 2]), ("string", [None, "a", "b"])])
def test_null_keys_are_refused(spark, kind, keys):
    df = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
    with pytest.raises(ValueError, match="null"):
        positional_slice(df, "k", 0, 2).collect()


def test_a_shared_folder_has_to_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tuneloom.session import shared_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(fake)


def test_stored_tables_can_be_removed(spark):
    kept, gone = stored(spark.range(5).toDF("id"), "kept"), stored(spark.range(9).toDF("id"), "gone")
    later = stored(gone.groupBy((F.col("id") % 2).alias("odd")).count(), "later")
    files = gone.inputFiles()
    discard(gone)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert kept.count() == 5 and {tuple(r) for r in later.collect()} == {(0, 5), (1, 4)}
    with pytest.raises(KeyError):
        discard(gone)
