"""Hand formatted rows on, with a summary taken while they are written."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

MAX_ROWS_PER_FILE = 1_000_000


def write_rows(
    df: DataFrame,
    path: str,
    file_format: str = "parquet",
    measures: Mapping[str, Column] | None = None,
    max_rows_per_file: int = MAX_ROWS_PER_FILE,
    mode: str = "errorifexists",
) -> dict[str, Any]:
    """Write ``df`` and return its row count and ``measures``, in the same pass."""
    observed = Observation()
    wanted = {"rows": F.count(F.lit(1)), **(measures or {})}
    watched = df.observe(observed, *(column.alias(name) for name, column in wanted.items()))
    (
        watched.write.mode(mode)
        .option("maxRecordsPerFile", max_rows_per_file)
        .format(file_format)
        .save(path)
    )
    return dict(observed.get)


def write_document(spark: SparkSession, path: str, document: Mapping[str, Any]) -> None:
    """Write one small JSON document (a config echo or a summary) beside the rows."""
    text = json.dumps(document, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).head()["value"])
