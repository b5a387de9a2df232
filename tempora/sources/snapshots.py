"""Versions of several tables that change together: a reader sees all of a load or nothing of it.

Tables are staged in folders of their own; a manifest names the folders that make up a version, and one rename makes it
current. What a load doesn't bring is carried over. Tables that follow from others (an overlay that is attached to nodes, a
report of what hangs loose) are derived from the staged ones and published with them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempora.operators.incremental import refuse_shrinking

Read = Callable[[str], DataFrame]


class Busy(RuntimeError):
    """Another load took the version; nothing was published."""


@dataclass
class Snapshot:
    """A version: for each table its folder below data/, its number of rows and its schema."""

    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)


class Snapshots:
    """Versions below a folder that all executors share. A load that fails leaves folders that no manifest names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list:
        where = self._path(f"{self.path}/{folder}")
        return sorted(self._files.listStatus(where), key=lambda f: f.getPath().getName()) if self._files.exists(where) else []

    def versions(self) -> list[int]:
        """The versions whose manifests are there, oldest first."""
        return [int(n[:-5]) for f in self._list("manifests") if (n := f.getPath().getName()).endswith(".json") and not n.startswith(".")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, or the current one; version 0 has no tables."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version and version not in known:
            raise KeyError(f"no version {version}")
        if not version:
            return Snapshot()
        said = self.spark.read.text(f"{self.path}/manifests/{version:09d}.json", wholetext=True).first()["value"]
        return Snapshot(version, json.loads(said))

    def _frame(self, table: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(table["schema"])).parquet(f"{self.path}/data/{table['folder']}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version. The files are fixed now: later loads don't change what the result reads."""
        return self._frame(self.snapshot(version).tables[name])

    def load(self, tables: Mapping[str, DataFrame], derived: Mapping[str, Callable[[Read], DataFrame]] | None = None, least: float = 0.0) -> Snapshot:
        """Stage tables, then what is derived from them, and publish the next version.

        derived: functions of a reader of the new version's tables, in order; later ones may read earlier ones. Raises Shrunk
        where a table would fall below `least` of its rows, Busy where another load came first; either publishes nothing.
        """
        old = self.snapshot()
        new = Snapshot(old.version + 1, dict(old.tables))

        def stage(name: str, rows: DataFrame) -> None:
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/data/{folder}")
            table = {"folder": folder, "schema": rows.schema.jsonValue()}
            table["rows"] = self._frame(table).count()
            if least:
                refuse_shrinking(table["rows"], old.tables.get(name, {}).get("rows"), least)
            new.tables[name] = table

        for name, rows in tables.items():
            stage(name, rows)
        for name, follows in (derived or {}).items():
            stage(name, follows(lambda table: self._frame(new.tables[table])))
        self._publish(new)
        return new

    def _publish(self, new: Snapshot) -> None:
        folder = f"{self.path}/manifests"
        self._files.mkdirs(self._path(folder))
        staged, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{new.version:09d}.json")
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps(new.tables).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(staged, final):
            self._files.delete(staged, False)
            raise Busy(f"version {new.version}")

    def collect_garbage(self, keep: int = 1, older: float = 86400.0) -> list[str]:
        """Remove manifests but for the last `keep`, and folders that those don't name; returns the folders.

        Folders that were written to in the last `older` seconds stay: they may belong to a load under way.
        """
        known = self.versions()
        named = {t["folder"] for v in known[-keep:] for t in self.snapshot(v).tables.values()}
        for version in known[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifests/{version:09d}.json"), False)
        until = (time.time() - older) * 1000
        gone = [f.getPath() for f in self._list("data") if f.getPath().getName() not in named and f.getModificationTime() <= until]
        for place in gone:
            self._files.delete(place, True)
        return [place.getName() for place in gone]


def attached(edges: DataFrame, nodes: DataFrame, key: str = "key") -> DataFrame:
    """edges with `loose`: whether their target isn't among the nodes. Rows are matched by key, each edge once."""
    known = nodes.select(F.col(key).alias("target_key")).distinct().withColumn("__known", F.lit(True))
    return edges.join(known, "target_key", "left").withColumn("loose", F.col("__known").isNull()).drop("__known")
