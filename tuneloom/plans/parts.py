"""Tables of a job that are there as a whole or not at all, and are made once.

A part is a table below the job's output directory and a manifest beside it: what it was made of (a fingerprint of its
input), its rows and measures, and its files. The manifest is the last thing written and one small file, so a part
without it, or with other files than it names, is unfinished: it is made anew, over what is left of it. A part whose
manifest names the same input is kept as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from tuneloom.sources.sinks import read_document, write_document, write_rows


def read_document_if_any(spark: SparkSession, path: str) -> dict[str, Any] | None:
    try:
        return read_document(spark, path)
    except AnalysisException:
        return None


def _digest(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()


def input_of(df: DataFrame) -> str:
    """Fingerprint of the files a table is read from; written files have names of their own."""
    return _digest(df.inputFiles())


@dataclass(frozen=True)
class CommittedParts:
    spark: SparkSession
    base: str

    def holds(self, name: str) -> bool:
        """Whether a table of that name is there, finished or not."""
        return self._files(f"{self.base}/{name}") is not None

    def part(self, name: str, fingerprint: str, make: Callable[[], DataFrame], measures: Mapping[str, Column] | None = None) -> dict[str, Any]:
        """Rows and measures of a part, which is written unless it is there."""
        manifest, path = f"{self.base}/_parts/{name}", f"{self.base}/{name}"
        done = read_document_if_any(self.spark, manifest)
        if done is not None and done["input"] == fingerprint and done["files"] == self._files(path):
            return done["measures"]
        measured = write_rows(make(), path, measures=measures, mode="overwrite")
        write_document(self.spark, manifest, {"part": name, "input": fingerprint, "files": self._files(path), "measures": measured})
        return measured

    def _files(self, path: str) -> str | None:
        try:
            return _digest(self.spark.read.parquet(path).inputFiles())
        except AnalysisException:
            return None
