"""Sinks, keyed caches and stores."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.nesting import upsert


def write_json(frames: dict[str, DataFrame], folder: str, split: str) -> None:
    """One folder of JSON lines per table and split."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{folder}/{split}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_chat(df: DataFrame, user: str, assistant: str, path: str, system: str = "") -> None:
    """Training lines {"messages": [...]} with the roles system, user and assistant; rows without a text on either side are left out."""
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    messages = F.array(*([role("system", F.lit(system))] if system else []), role("user", F.col(user)), role("assistant", F.col(assistant)))
    df.where(F.col(user).isNotNull() & F.col(assistant).isNotNull()).select(F.to_json(F.struct(messages.alias("messages"))).alias("value")).write.mode("overwrite").text(path)


def append_checked(df: DataFrame, path: str) -> None:
    """Appends to a parquet table; columns or types that differ from what is there are an error."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.parquet(path).dtypes
        if there != df.dtypes:
            raise ValueError(f"{path} has {there}, not {df.dtypes}")
    df.write.mode("append").parquet(path)


class Store:
    """Tables under slash-separated keys in one folder.

    A table is a folder of numbered versions, of which the last complete one counts; a new one is
    written beside it and counts once it is whole, so a failure in between loses nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, key: str) -> list[int]:
        """Numbers of the complete versions, in order."""
        where = self._path(f"{self.folder}/{key}")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        found = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
        return [n for n in found if self._fs.exists(self._path(f"{self.folder}/{key}/v{n}/_SUCCESS"))]

    def set(self, key: str, df: DataFrame, by: tuple[str, ...] = ()) -> None:
        """Writes a table; df may be made from the one that it replaces."""
        old = self._versions(key)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{key}/v{max(old, default=0) + 1}")
        for n in old:
            self._fs.delete(self._path(f"{self.folder}/{key}/v{n}"), True)

    def get(self, key: str) -> DataFrame:
        found = self._versions(key)
        if not found:
            raise KeyError(key)
        return self.spark.read.parquet(f"{self.folder}/{key}/v{found[-1]}")

    def __contains__(self, key: str) -> bool:
        return bool(self._versions(key))

    def keys(self, prefix: str = "") -> list[str]:
        """Keys below a prefix, sorted."""
        out, todo = [], [prefix.strip("/")]
        while todo:
            at = todo.pop()
            if at and at in self:
                out.append(at)
                continue
            where = self._path(f"{self.folder}/{at}")
            if self._fs.exists(where):
                todo += [f"{at}/{s.getPath().getName()}".lstrip("/") for s in self._fs.listStatus(where) if s.isDirectory()]
        return sorted(out)

    def all(self, prefix: str = "") -> dict[str, DataFrame]:
        """Every table below a prefix, by key."""
        return {k: self.get(k) for k in self.keys(prefix)}

    def find(self, key: str, test: Column | str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a table that meet a test, and some of their columns."""
        found = self.get(key) if test is None else self.get(key).where(test)
        return found.select(*columns) if columns else found

    def find_one(self, key: str, test: Column | str | None = None) -> dict | None:
        """A row that meets a test as a dictionary, or null."""
        row = self.find(key, test).limit(1).collect()
        return row[0].asDict(recursive=True) if row else None

    def distinct(self, key: str, column: str) -> DataFrame:
        """(column): its distinct values that aren't null."""
        return self.get(key).select(column).where(F.col(column).isNotNull()).distinct()

    def delete_many(self, key: str, test: Column) -> None:
        """Leaves out the rows that meet a test; those for which it is null stay."""
        self.set(key, self.get(key).where(~F.coalesce(test, F.lit(False))))

    def drop(self, key: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{key}"), True)

    def upsert(self, key: str, changes: DataFrame, on: list[str], order: list) -> None:
        """Merges the last change of each key into a table."""
        self.set(key, upsert(self.get(key), changes, on, order) if key in self else upsert(changes.limit(0), changes, on, order))

    def cached(self, parts: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, written once per distinct parts."""
        key = "cache/" + hashlib.sha256(repr(parts).encode()).hexdigest()
        if key not in self:
            self.set(key, make())
        return self.get(key)


class Steps:
    """Named steps with outputs in a store; a step runs when its output isn't there or one it depends on ran."""

    def __init__(self, store: Store):
        self.store, self.steps = store, {}

    def add(self, name: str, make: Callable[..., DataFrame], needs: tuple[str, ...] = ()) -> None:
        self.steps[name] = (make, needs)

    def run(self) -> list[str]:
        """Names of the steps that ran, in order of adding; a step needs only steps added before it."""
        ran: list[str] = []
        for name, (make, needs) in self.steps.items():
            if name not in self.store or set(needs) & set(ran):
                self.store.set(name, make(*[self.store.get(n) for n in needs]))
                ran.append(name)
        return ran
