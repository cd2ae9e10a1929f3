"""Tables written between the steps of iterative operators.

Iterative operators cut their lineage by writing a table into the folder that the cluster
shares, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Workspaces not yet removed, by application.
_OPEN: dict[str, list[Workspace]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset in local mode, a temporary one is set for the session; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="loomtext-"))
    return spark.conf.get("spark.checkpoint.dir")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what workspaces opened inside have written; results must have been taken by then."""
    mine = _OPEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(mine)
    try:
        yield
    finally:
        while len(mine) > before:
            mine.pop().remove()


class Workspace:
    """Scratch tables of one operator run; they are removed by `remove`, at the end of `scratch`, or else when the session's file system closes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        self._fs, self._path = fs, path
        self._n = 0
        _OPEN.setdefault(spark.sparkContext.applicationId, []).append(self)

    def remove(self) -> None:
        self._fs.delete(self._path, True)

    def keep(self, df: DataFrame, name: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df once, in folders by some columns if wished, and returns the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measure(self, df: DataFrame, name: str = "t", **counts: Column) -> tuple[DataFrame, dict]:
        """As keep, with counts of the rows for which each condition holds, taken while writing."""
        seen = Observation()
        written = self.keep(df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]), name)
        got = seen.get
        return written, {n: got.get(n) or 0 for n in counts}
