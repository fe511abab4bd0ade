"""Versioned tables: immutable files in buckets of a key, and a log of numbered snapshots.

A snapshot names the folders that hold each bucket. A change writes new folders for the
buckets it touches, and then one entry of the log, which is made under its number only if no
other writer has made it; whoever comes second gets :class:`Conflict`. Readers see a snapshot
or the next one, never a part. Going back is an entry with an older snapshot's folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot was read."""


class Log:
    """Numbered JSON entries of a folder, each written once, by the file system that Spark uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway, self.path = spark.sparkContext._gateway, path.rstrip("/")

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._at().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._at()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict:
        stream = self._fs().open(self._at(f"{version:012}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def append(self, version: int, entry: dict) -> None:
        """Makes the entry under a number that has none: it is written aside and renamed, which
        fails where the name is taken."""
        aside, final = self._at(f".{uuid.uuid4().hex}"), self._at(f"{version:012}.json")
        fs = self._fs()
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        try:
            context.rename(aside, final, self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise


class VersionedTable:
    """A table below ``path``, its rows in ``buckets`` buckets of the columns ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str | list[str] = "rec_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), [key] if isinstance(key, str) else list(key), buckets
        self.log = Log(spark, f"{self.path}/_log")

    # ------------------------------------------------------------------ snapshots

    def version(self) -> int:
        """The number of the last snapshot; 0 before the first."""
        return max(self.log.versions(), default=0)

    def entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self.log.read(version) if version else {"version": 0, "parts": {}, "schema": None, "transactions": {}, "buckets": self.buckets}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a snapshot (default: the last one), or of some of its buckets."""
        return self._read(self.entry(version), only)

    def _read(self, entry: dict, only: list[int] | None = None) -> DataFrame:
        if entry["schema"] is None:
            raise ValueError(f"{self.path} has no snapshot")
        schema = StructType.fromJson(entry["schema"])
        folders = [f"{self.path}/{p}" for b, parts in entry["parts"].items() if only is None or int(b) in set(only) for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, entry: dict):
        return F.pmod(F.xxhash64(*self.key), F.lit(entry["buckets"])).cast("int")

    def _touched(self, keys: DataFrame, entry: dict) -> list[int]:
        """Buckets with a row of ``keys``: so many at most as there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket(entry).alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, entry: dict) -> dict[str, list[str]]:
        """Folders of the rows' buckets in a new folder. Large buckets are split over tasks."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(entry)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        at = self.log.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in at.getFileSystem(self.log.conf).listStatus(at) if s.isDirectory()]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith("_bucket=")}

    def _commit(self, before: dict, parts: dict, schema: StructType, what: str, transaction: tuple[str, int] | None = None) -> int:
        version = before["version"] + 1
        done = before["transactions"] | ({transaction[0]: transaction[1]} if transaction else {})
        self.log.append(version, {"version": version, "what": what, "key": self.key, "buckets": before["buckets"], "schema": schema.jsonValue(), "transactions": done, "parts": {b: p for b, p in parts.items() if p}})
        return version

    @staticmethod
    def _schema(rows: DataFrame) -> StructType:
        return StructType.fromJson(json.loads(rows.schema.json().replace('"nullable":false', '"nullable":true').replace('"containsNull":false', '"containsNull":true').replace('"valueContainsNull":false', '"valueContainsNull":true')))

    # -------------------------------------------------------------------- changes

    def replace(self, rows: DataFrame, expected: int | None = None) -> int:
        """All rows anew. ``expected`` is the version that the change was made for (default: the last)."""
        before = self._at(expected)
        return self._commit(before, self._write(rows, before), self._schema(rows), "replace")

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], expected: int | None = None) -> int:
        """Rewrites the buckets with a row of ``keys`` by ``change``, which gets their rows and
        gives the new ones; the files of all other buckets stay. Rows outside the keys pass
        through ``change`` too, and must come out of it."""
        before = self._at(expected)
        touched = self._touched(keys, before)
        if not touched:
            return before["version"]
        made = self._write(change(self._read(before, touched)).select(*self._read(before, []).columns), before)
        parts = {b: p for b, p in before["parts"].items() if int(b) not in set(touched)} | made
        return self._commit(before, parts, StructType.fromJson(before["schema"]), "update")

    def upsert(self, rows: DataFrame, transaction: tuple[str, int] | None = None, expected: int | None = None) -> int:
        """Rows of a key replace all rows of that key. Buckets without an old row of the keys get
        the new files beside their own; only the others are rewritten. A ``transaction`` (name,
        number) that the table has seen, or a later one, changes nothing."""
        before = self._at(expected)
        if transaction and before["transactions"].get(transaction[0], -1) >= transaction[1]:
            return before["version"]
        if before["schema"] is None:
            return self._commit(before, self._write(rows, before), self._schema(rows), "upsert", transaction)
        names = self._read(before, []).columns
        keys = rows.select(*self.key).distinct()
        touched = self._touched(keys, before)
        again = self._touched(self._read(before, touched).select(*self.key).join(keys, self.key, "left_semi"), before) if touched else []
        added = self._write(rows.select(*names), before)
        kept = self._write(self._read(before, again).join(keys, self.key, "left_anti").select(*names), before) if again else {}
        parts = {b: list(p) for b, p in before["parts"].items() if int(b) not in set(again)}
        for made in (kept, added):
            for b, p in made.items():
                parts[b] = parts.get(b, []) + p
        return self._commit(before, parts, StructType.fromJson(before["schema"]), "upsert", transaction)

    def restore(self, version: int, expected: int | None = None) -> int:
        """A snapshot with the rows of an older one; no file is written but the entry."""
        if version not in self.log.versions():
            raise ValueError(f"nothing to restore: {self.path} has no version {version}")
        before, old = self._at(expected), self.entry(version)
        return self._commit(before, old["parts"], StructType.fromJson(old["schema"]), f"restore {version}")

    def undo(self, expected: int | None = None) -> int:
        """The snapshot before the last one."""
        return self.restore((self.version() if expected is None else expected) - 1, expected)

    def compact(self, most: int = 8, expected: int | None = None) -> int:
        """Buckets of more than ``most`` folders get one."""
        before = self._at(expected)
        many = [int(b) for b, p in before["parts"].items() if len(p) > most]
        if not many:
            return before["version"]
        parts = {b: p for b, p in before["parts"].items() if int(b) not in set(many)} | self._write(self._read(before, many), before)
        return self._commit(before, parts, StructType.fromJson(before["schema"]), "compact")

    def _at(self, expected: int | None) -> dict:
        before = self.entry()
        if expected is not None and expected != before["version"]:
            raise Conflict(f"{self.path} is at version {before['version']}, not {expected}")
        return before
