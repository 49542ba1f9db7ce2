"""Tables written once, read by several consumers, and removed by their owner.

A plan that several consumers read would be built and run once for each.  ``Staging.put`` writes it as Parquet under the
shared checkpoint folder and reads it back: the lineage is cut with files that every executor sees, so a lost executor costs no
recomputation, and the consumers' plans begin at a scan with known sizes.  The owner (a report set, an operator) removes
the files with ``drop`` or ``close``; what is left when the driver ends is removed then.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import checkpoint_dir

_open: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _open.pop(path, None)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_open.items()):
        with contextlib.suppress(Exception):  # the session may have ended before the driver
            _remove(spark, path)


class Staging:
    """The staged tables of one owner."""

    def __init__(self, spark: SparkSession, name: str = "stage"):
        self.spark = spark
        self.name = name
        self.paths: list[str] = []

    def folder(self, name: str) -> str:
        """A new path under the shared folder that goes with this owner."""
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/{self.name}-{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        _open[path] = self.spark
        return path

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back with its schema."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove staged tables that nothing will read again."""
        for table in tables:
            self.paths.remove(table.staged_at)
            _remove(self.spark, table.staged_at)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Remove everything but the given staged tables."""
        kept = [t.staged_at for t in tables]
        for path in [p for p in self.paths if p not in kept]:
            self.paths.remove(path)
            _remove(self.spark, path)

    def close(self) -> None:
        """Remove all that is left."""
        while self.paths:
            _remove(self.spark, self.paths.pop())

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
