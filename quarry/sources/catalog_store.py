"""The catalog on disk: projects, jobs, models and settings, opened and brought to the present form by migrations.

Each table is Parquet of its own version; the pointer names the versions and how many migrations
have run. A migration takes the tables and gives them back changed, and all that are due run
before anything is published, so a failed one leaves the catalog as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored

Tables = dict[str, DataFrame]
Migration = Callable[[SparkSession, Tables], Tables]


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _projects(spark: SparkSession, t: Tables) -> Tables:
    return t | {"projects": _empty(spark, "id long, name string, root_path string"), "settings": _empty(spark, "key string, value string")}


def _jobs(spark: SparkSession, t: Tables) -> Tables:
    return t | {"jobs": _empty(spark, "id long, project string, state string, started timestamp, ended timestamp")}


def _models(spark: SparkSession, t: Tables) -> Tables:
    return t | {"models": _empty(spark, "id long, name string, backend string, dim int, context int")}


def _machines(spark: SparkSession, t: Tables) -> Tables:  # noqa: ARG001
    """Projects learn which machine their root is on and which domains they have; old ones are of no machine and hold code."""
    return t | {"projects": t["projects"].withColumns({"machine_id": F.lit(""), "domains": F.lit("code")})}


MIGRATIONS: tuple[Migration, ...] = (_projects, _jobs, _models, _machines)


class Catalog:
    """Opened by its folder; ``write`` replaces one table."""

    def __init__(self, spark: SparkSession, path: str, migrations: tuple[Migration, ...] = MIGRATIONS):
        self.spark, self.path = spark, path.rstrip("/")
        self._pointer = stored.Pointer(spark, self.path)
        state = self._pointer.read() or {"migrated": 0, "tables": {}, "serial": 0}
        if state["migrated"] > len(migrations):
            raise ValueError(f"{path} was written by a later version: {state['migrated']} migrations, {len(migrations)} are known")
        self._state = state
        if state["migrated"] < len(migrations):
            before = {name: self.table(name) for name in state["tables"]}
            after = before
            for step in migrations[state["migrated"] :]:
                after = step(spark, after)
            self._publish({k: v for k, v in after.items() if v is not before.get(k)}, len(migrations), set(after))

    @property
    def migrated(self) -> int:
        return self._state["migrated"]

    @property
    def names(self) -> list[str]:
        return sorted(self._state["tables"])

    def table(self, name: str) -> DataFrame:
        """The table as it was last written; an unknown name is a KeyError."""
        return self.spark.read.parquet(f"{self.path}/{self._state['tables'][name]}")

    def write(self, **tables: DataFrame) -> None:
        """Replaces tables, all of them at once; each must exist and keep its columns."""
        for name, df in tables.items():
            if self.table(name).columns != df.columns:
                raise ValueError(f"{name}: columns {df.columns}")
        self._publish(tables, self.migrated, set(self.names))

    def _publish(self, changed: Tables, migrated: int, kept: set[str]) -> None:
        serial = self._state["serial"] + 1
        at = {k: v for k, v in self._state["tables"].items() if k in kept}
        for name, df in changed.items():
            at[name] = f"{name}-{serial}"
            df.write.mode("overwrite").parquet(f"{self.path}/{at[name]}")
        before = self._state["tables"]
        self._state = {"migrated": migrated, "tables": at, "serial": serial}
        self._pointer.replace(self._state)
        for name, was in before.items():
            if at.get(name) != was:
                self._pointer.drop(was)
