"""Dataset access: name, subset, split, slice, row limit, stream, preview."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tuneloom.operators.formatting import format_rows
from tuneloom.sources.order import positional_slice

logger = logging.getLogger(__name__)

FILE_FORMATS = ("parquet", "orc", "json", "csv", "text")
_SPLIT = re.compile(r"(?P<split>\w[\w.\-]*)(?:\[(?P<start>-?\d*)(?P<start_pct>%?):(?P<stop>-?\d*)(?P<stop_pct>%?)\])?")
# Sizes of the preview.
PREVIEW_ROWS, PREVIEW_JSON_CHARS, PREVIEW_TEXT_CHARS = 5, 200, 400
PREVIEW_SEPARATOR = "\n\n---\n\n"


@dataclass(frozen=True)
class Split:
    """A split name with an optional slice of row positions or percentages."""

    name: str
    start: int | None = None
    stop: int | None = None
    percent: bool = False

    @property
    def sliced(self) -> bool:
        return self.start is not None or self.stop is not None

    def positions(self, rows: Callable[[], int]) -> tuple[int, int | None]:
        """Absolute [start, stop); ``rows`` is called only for relative bounds."""
        relative = self.percent or (self.start or 0) < 0 or (self.stop or 0) < 0
        if not relative:
            start, stop = self.start or 0, self.stop
            return start, stop if stop is None else max(start, stop)
        total = rows()

        def absolute(bound: int | None, missing: int) -> int:
            if bound is None:
                return missing
            if self.percent:
                bound = round(bound * total / 100)
            return min(max(bound + total, 0) if bound < 0 else bound, total)

        start, stop = absolute(self.start, 0), absolute(self.stop, total)
        return start, max(start, stop)


def parse_split(text: str) -> Split:
    """Read ``train``, ``train[:1000]``, ``train[200:500]``, ``train[-100:]`` or ``train[:10%]``."""
    found = _SPLIT.fullmatch(text.replace(" ", ""))
    if not found:
        raise ValueError(f"Cannot read split {text!r}; expected a name, optionally with [start:stop]")
    start, stop = (int(v) if v else None for v in (found["start"], found["stop"]))
    signs = {bool(found[k + "_pct"]) for k, v in (("start", start), ("stop", stop)) if v is not None}
    if len(signs) > 1:
        raise ValueError(f"Split {text!r} mixes row numbers and percentages")
    percent = True in signs
    if percent and any(abs(v) > 100 for v in (start, stop) if v is not None):
        raise ValueError(f"Split {text!r} has percentages outside 0 to 100")
    return Split(found["split"], start, stop, percent)


@dataclass(frozen=True)
class DatasetCatalog:
    """Where datasets live.

    ``layout='directories'`` reads root/name[/config]/split. ``layout='partitions'`` reads
    root/name and filters its ``config`` and ``split`` columns, which prunes partitions.
    ``layout='file'`` reads root/name itself and ignores the split name.
    """

    root: str = ""
    paths: dict[str, str] = field(default_factory=dict)
    file_format: str = "parquet"
    layout: str = "directories"
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.file_format not in FILE_FORMATS:
            raise ValueError(f"Unknown file format {self.file_format!r}. Choose from: {list(FILE_FORMATS)}")
        if self.layout not in ("directories", "partitions", "file"):
            raise ValueError(f"Unknown layout {self.layout!r}")

    def path(self, name: str, config: str | None, split: str) -> str:
        base = self.paths.get(name) or "/".join(part for part in (self.root.rstrip("/"), name) if part)
        if self.layout == "directories":
            base = "/".join(part for part in (base, config, split) if part)
        return base


def load_dataset(
    spark: SparkSession,
    catalog: DatasetCatalog,
    name: str,
    config: str | None = None,
    split: str = "train",
    max_samples: int | None = None,
    streaming: bool = False,
    order_by: str | Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read a dataset split as a batch or streaming DataFrame.

    A slice is taken before ``max_samples``; both need ``order_by``. A stream has no end,
    so it takes no slice, and ``max_samples`` is ignored with a warning.
    """
    wanted = parse_split(split)
    path = catalog.path(name, config, wanted.name)
    if streaming:
        if wanted.sliced:
            raise ValueError(f"A stream cannot be sliced: {split!r}")
        if schema is None:
            schema = _reader(spark.read, catalog).load(path).schema
        df = _reader(spark.readStream.schema(schema), catalog).load(path)
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = _reader(reader, catalog).load(path)
    if catalog.layout == "partitions":
        df = df.where(F.col("split") == wanted.name)
        if config is not None:
            df = df.where(F.col("config") == config)
    if streaming:
        if max_samples is not None:
            logger.warning("max_samples=%d is ignored for a stream", max_samples)
        return df
    if not wanted.sliced and max_samples is None:
        return df
    if not order_by:
        raise ValueError("Slicing and max_samples need order_by: a table has no row order of its own")
    start, stop = wanted.positions(df.count)
    if max_samples is not None:
        if max_samples < 0:
            raise ValueError("max_samples cannot be negative")
        stop = start + max_samples if stop is None else min(stop, start + max_samples)
    return positional_slice(df, order_by, start, stop)


def _reader(reader, catalog: DatasetCatalog):
    return reader.format(catalog.file_format).options(**catalog.options)


def list_columns(data: DataFrame | dict[str, DataFrame]) -> list[str]:
    """Column names; for several splits those of the first."""
    if isinstance(data, dict):
        data = next(iter(data.values()))
    return list(data.columns)


def first_rows(df: DataFrame, order_by: str | Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows in key order."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return positional_slice(df, keys, 0, n).orderBy(*keys)


def preview_json(df: DataFrame, order_by: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as JSON text, cut for display."""
    as_json = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return first_rows(df, order_by, n).select(
        order_by, F.substring(as_json, 1, PREVIEW_JSON_CHARS).alias("row_json")
    )


def preview_formatted(
    df: DataFrame, order_by: str, format: str, n: int = PREVIEW_ROWS, **options
) -> DataFrame:
    """One row: the formatted, cut texts of the first rows, one below the other."""
    rows = first_rows(df, order_by, n).transform(format_rows(format, keep=[order_by], **options))
    cut = F.struct(F.col(order_by).alias("k"), F.substring("text", 1, PREVIEW_TEXT_CHARS).alias("t"))
    ordered = F.sort_array(F.collect_list(cut))
    return rows.agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), PREVIEW_SEPARATOR).alias("preview")
    )
