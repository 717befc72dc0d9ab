"""Snapshots and logs: versioned Parquet tables, an append-only change log, and their replay.

A version is a directory that Spark's committer completes with a marker; readers take the newest complete
one, so a failed writer leaves the older version in force and nothing is overwritten while it is read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Named tables under one path, in numbered versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        fs, p = self._fs(f"{self.path}/{name}")
        if not fs.exists(p):
            return []
        done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v")]
        return sorted(int(d.getName()[1:]) for d in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))

    def save(self, name: str, df: DataFrame, keep: int = 2) -> DataFrame:
        """Write the next version and return it; older ones than the last ``keep`` go."""
        have = self.versions(name)
        number = have[-1] + 1 if have else 1
        path = f"{self.path}/{name}/v{number:010d}"
        df.write.mode("overwrite").parquet(path)
        for old in have[: max(0, len(have) + 1 - keep)]:
            fs, p = self._fs(f"{self.path}/{name}/v{old:010d}")
            fs.delete(p, True)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, name: str, version: int | None = None) -> DataFrame:
        have = self.versions(name)
        if not have or version is not None and version not in have:
            raise FileNotFoundError(f"{name}, version {version}" if version else name)
        return self.spark.read.parquet(f"{self.path}/{name}/v{version or have[-1]:010d}")

    def names(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def save_all(self, states: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        return {name: self.save(name, df) for name, df in states.items()}

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.load(name) for name in self.names() if self.versions(name)}


class ChangeLog:
    """An append-only log of changes (pk, op, at, row) that replays into state and streams to readers."""

    SCHEMA = "pk string, op string, at long, row string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, changes: DataFrame) -> None:
        changes.select("pk", "op", "at", "row").write.mode("append").parquet(self.path)

    def read(self, after: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows if after is None else rows.filter(F.col("at") > after)

    def stream(self, files_per_trigger: int = 100) -> DataFrame:
        return self.spark.readStream.schema(self.SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(self.path)

    def replay(self, state: DataFrame | None = None) -> DataFrame:
        """State (pk, row) after all changes; one aggregation, last change wins."""
        last = self.read().groupBy("pk").agg(F.max_by(F.struct("op", "row"), "at").alias("c")).select("pk", "c.op", "c.row")
        rows = last.filter("op != 'delete'").select("pk", "row")
        return rows if state is None else state.join(last, "pk", "left_anti").unionByName(rows)


def dump(df: DataFrame) -> DataFrame:
    """Every row as one JSON text that keeps NULLs."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def restore(values: DataFrame, schema: str) -> DataFrame:
    """Rows back from ``dump``."""
    return values.select(F.from_json("value", schema).alias("r")).select("r.*")
