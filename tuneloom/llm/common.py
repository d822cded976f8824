"""What several operators of this package share: tables, stored intermediates, sorted batches, words and white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tuneloom.session import discard, stored  # noqa: F401 - for the operators

BLANKS = "\t\n\x0b\x0c\r"  # with the space: [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORKER: dict[str, object] = {"owner": None, "held": {}}


def worker_state(owner: object) -> dict:
    """What a Python worker keeps between its tasks for ``owner``; what it kept for another one goes."""
    if _WORKER["owner"] != owner:
        _WORKER.update(owner=owner, held={})
        pa.default_memory_pool().release_unused()
    return _WORKER["held"]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that no value of it is in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def stretches(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(keys)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])


def _marked(text: Column) -> Column:
    """``text`` with each run of white space as one tab and line feed, characters it then has nowhere else."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.replace(F.replace(text, F.lit(" "), F.lit("\t\n")), F.lit("\n\t"), F.lit(""))


def squeeze(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; byte searches only, no regular expression."""
    return F.replace(_marked(text), F.lit("\t\n"), F.lit(" "))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; null has none."""
    def count(marked: Column) -> Column:
        runs = (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("\t\n"), F.lit("")))) / 2
        edges = F.startswith(marked, F.lit("\t")).cast("int") + F.endswith(marked, F.lit("\n")).cast("int")
        return F.when(marked == "", 0).otherwise(runs + 1 - edges).cast("long")

    # Bound by a lambda, the marked text is made once however often the count refers to it.
    return F.transform(F.array(_marked(F.coalesce(text, F.lit("")))), count)[0]
