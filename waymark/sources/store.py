"""Cached results: Parquet tables with versions, and numbered manifests.

A change writes a new version of a table and then a manifest with the next
number; the manifest with the highest number counts.  A manifest appears whole
or not at all, by a rename that never replaces a file, so a reader never sees
half a change, a crash at any point leaves the state before it, and of two
writers that meet the second starts again from the first one's state.  Old
versions stay, so that frames read earlier still work, until ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import relational


class _Moved(Exception):
    """Another writer changed the table first."""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        self._fs = self._path("").getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _latest(self) -> int:
        """The number of the manifest that counts; 0 if there is none."""
        if not self._fs.exists(self._path("")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)

    def _load(self, number: int) -> dict[str, dict]:
        if not number:
            return {}
        source = self._fs.open(self._path(f"manifest-{number:012d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def manifest(self) -> dict[str, dict]:
        return self._load(self._latest())

    def _publish(self, number: int, manifest: dict[str, dict]) -> bool:
        """Whether the manifest became the one with this number; false if another writer was first."""
        temp, goal = self._path(f".manifest-{uuid.uuid4().hex}"), self._path(f"manifest-{number:012d}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(temp, goal, none)
        except Py4JJavaError:
            self._fs.delete(temp, False)
            if self._fs.exists(goal):
                return False
            raise
        return True

    def _commit(self, change: Callable[[dict[str, dict]], None]) -> None:
        while True:
            number = self._latest()
            manifest = self._load(number)
            change(manifest)
            if self._publish(number + 1, manifest):
                return

    def read(self, table: str) -> DataFrame | None:
        entry = self.manifest().get(table)
        return self.spark.read.parquet(f"{self.folder}/{entry['dir']}") if entry else None

    def fingerprint(self, table: str) -> str | None:
        return self.manifest().get(table, {}).get("fingerprint")

    def write(self, table: str, df: DataFrame, fingerprint: str | None = None) -> DataFrame:
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{folder}")
        self._commit(lambda m: m.update({table: {"dir": folder, "fingerprint": fingerprint}}))
        return self.spark.read.parquet(f"{self.folder}/{folder}")

    def _change(self, table: str, make: Callable[[DataFrame | None], DataFrame], fingerprint: Callable[[str | None], str | None] = lambda f: f) -> DataFrame:
        """A new version made from the old one; made again if another writer changed the table meanwhile."""
        while True:
            entry = self.manifest().get(table)
            folder = f"{table}/{uuid.uuid4().hex}"
            make(self.spark.read.parquet(f"{self.folder}/{entry['dir']}") if entry else None).write.parquet(f"{self.folder}/{folder}")

            def change(manifest: dict[str, dict], entry=entry, folder=folder) -> None:
                if manifest.get(table) != entry:
                    raise _Moved
                manifest[table] = {"dir": folder, "fingerprint": fingerprint(entry and entry["fingerprint"])}

            try:
                self._commit(change)
            except _Moved:
                continue
            return self.spark.read.parquet(f"{self.folder}/{folder}")

    def upsert(self, table: str, new: DataFrame, keys: list[str]) -> DataFrame:
        return self._change(table, lambda old: relational.upsert(old, new, keys) if old is not None else new)

    def delete(self, table: str, gone: DataFrame, keys: list[str]) -> None:
        if table in self.manifest():
            self._change(table, lambda old: relational.delete(old, gone, keys))

    def update(self, table: str, new: DataFrame, keys: list[str], values: list[str], fingerprint: str | None = None) -> DataFrame:
        """Sets values of existing rows; RuntimeError if the table lacks one of the keys."""

        def make(old: DataFrame | None) -> DataFrame:
            if old is None or new.join(old, relational.same(new, old, keys), "left_anti").limit(1).count():
                raise RuntimeError(f"{table} lacks rows to update")
            return relational.update(old, new, keys, values)

        return self._change(table, make, lambda _: fingerprint)

    def put_parts(self, table: str, rows: DataFrame, named: DataFrame) -> None:
        """Adds the rows of the keys in ``named``, or puts new ones in place of their old ones; those of other keys are not touched.

        Rows lie in a folder for each write and key.  The small table
        ``<table>_keys`` says which write of a key counts, so keys without
        rows are known, too, and frames read before still work.
        """
        version, keys = uuid.uuid4().hex, named.columns
        rows.withColumn("version", F.lit(version)).repartition(*keys).write.mode("append").partitionBy("version", *keys).parquet(f"{self.folder}/{table}")
        self.upsert(f"{table}_keys", named.distinct().withColumn("version", F.lit(version)), keys)

    def read_parts(self, table: str, wanted: DataFrame, schema: str) -> DataFrame:
        """The rows of the wanted keys; ``schema`` has all columns, as text."""
        keys = wanted.columns
        named = self.read(f"{table}_keys")
        if named is None:
            return self.spark.createDataFrame([], schema)
        named = named.join(wanted.distinct(), relational.same(named, wanted, keys), "left_semi")
        rows = self.spark.read.schema(f"{schema}, version string").parquet(f"{self.folder}/{table}")
        return rows.join(named, (rows["version"] == named["version"]) & relational.same(rows, named, keys), "left_semi").drop("version")

    def drop(self, *tables: str) -> None:
        """Forgets tables, or everything if none is named."""

        def change(manifest: dict[str, dict]) -> None:
            for t in tables or tuple(manifest):
                manifest.pop(t, None)

        if self.manifest():
            self._commit(change)

    def forget_fingerprints(self, *tables: str) -> None:
        def change(manifest: dict[str, dict]) -> None:
            for t in tables or tuple(manifest):
                if t in manifest:
                    manifest[t]["fingerprint"] = None

        if any(t in self.manifest() for t in tables or self.manifest()):
            self._commit(change)

    def touch(self, table: str, fingerprint: str) -> None:
        self._commit(lambda m: m[table].update({"fingerprint": fingerprint}) if table in m else None)

    def cached(self, table: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table if its fingerprint still holds, else what ``make`` gives, stored."""
        if self.fingerprint(table) == fingerprint:
            return self.read(table)
        return self.write(table, make(), fingerprint)

    def vacuum(self) -> None:
        """Removes old manifests and versions that the newest one does not name; frames that read them stop working."""
        number = self._latest()
        used = {tuple(e["dir"].split("/")) for e in self._load(number).values()}
        parts = self._live_parts()
        if not self._fs.exists(self._path("")):
            return
        for entry in self._fs.listStatus(self._path("")):
            name = entry.getPath().getName()
            if entry.isDirectory():
                for child in self._fs.listStatus(entry.getPath()):
                    inner = child.getPath().getName()
                    if (name, inner) not in used and inner not in parts.get(name, ()):
                        self._fs.delete(child.getPath(), True)
            elif name.startswith(".manifest-") or re.fullmatch(r"manifest-\d+\.json", name) and name != f"manifest-{number:012d}.json":
                self._fs.delete(entry.getPath(), False)

    def _live_parts(self) -> dict[str, set[str]]:
        """The folders of the writes that still count, of each table in parts; their number is that of the writes."""
        out = {}
        for t in self.manifest():
            if t.endswith("_keys"):
                out[t.removesuffix("_keys")] = {f"version={r.version}" for r in self.read(t).select("version").distinct().toLocalIterator()}
        return out
