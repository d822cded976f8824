"""A small live table kept by a stream: batch results, folded together now and then.

Every micro-batch is reduced by ``fold`` and written to ``batch=<id>``; after every
``fold_every`` batches all parts so far are reduced into one ``fold=<id>``. ``fold`` must
give the same result whether it is applied to rows or to its own earlier results. A batch
that runs again overwrites its own part, so each counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FOLD_EVERY = 20


@dataclass(frozen=True)
class FoldedTable:
    path: str
    fold: Callable[[DataFrame], DataFrame]
    fold_every: int = FOLD_EVERY

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` function."""
        spark = batch.sparkSession
        self.fold(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if (batch_id + 1) % self.fold_every == 0:
            self.read(spark, batch_id).write.mode("overwrite").parquet(f"{self.path}/fold={batch_id}")
            # The previous fold and what follows it stay for readers that have just started.
            self._drop_before(spark, batch_id - self.fold_every)

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The table as of batch ``upto``, or as of now."""
        batches, folds = self._parts(spark, "batch"), self._parts(spark, "fold")
        if upto is not None:
            batches, folds = [b for b in batches if b <= upto], [f for f in folds if f < upto]
        base = max(folds, default=-1)
        parts = [f"{self.path}/fold={base}"] if folds else []
        parts += [f"{self.path}/batch={b}" for b in batches if b > base]
        if not parts:
            raise ValueError(f"No finished batch under {self.path}")
        return self.fold(spark.read.parquet(*parts))

    def _parts(self, spark: SparkSession, kind: str) -> list[int]:
        """Ids of the finished parts: those with a success marker."""
        fs, path = _file_system(spark, f"{self.path}/{kind}=*/_SUCCESS")
        found = fs.globStatus(path) or []
        return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found)

    def _drop_before(self, spark: SparkSession, fold_id: int) -> None:
        stale = [f"batch={b}" for b in self._parts(spark, "batch") if b <= fold_id]
        stale += [f"fold={f}" for f in self._parts(spark, "fold") if f < fold_id]
        for name in stale:
            fs, path = _file_system(spark, f"{self.path}/{name}")
            fs.delete(path, True)


def _file_system(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path
