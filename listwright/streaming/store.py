"""Tables in buckets, for merges that touch few of them.

``<root>/<table>/v=<n>/bucket=<b>/`` holds what version n wrote of a bucket.  ``<root>/manifest/<n>`` names, for every
table and bucket, the versions to read; it is put in place by a rename when all files of version n are there.  A commit that
fails before leaves the version before it in force, and its folders are overwritten by the next try.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import file_system


class BucketStore:
    """Versions of tables dealt by key; readers see whole versions, writers rewrite or append buckets.

    One writer at a time, as in a stream.  ``buckets`` is fixed when the store is made; a bucket should stay
    within what a task sorts easily (some hundred MB), so it grows with the data one expects.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        found = self._manifest(self.version())
        self.buckets = found["buckets"] if found else buckets

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The latest whole version, -1 for none."""
        fs, folder = file_system(self.spark, f"{self.root}/manifest")
        if not fs.exists(folder):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=-1)

    def _manifest(self, version: int) -> dict:
        if version < 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{version}", wholetext=True).first()[0])

    def folders(self, name: str, version: int | None = None) -> dict[int, list[int]]:
        """Versions to read of each bucket of a table."""
        held = self._manifest(self.version() if version is None else version).get("tables", {}).get(name, {})
        return {int(b): v for b, v in held.items()}

    def read(self, name: str, schema: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some buckets of it: only their folders are read."""
        held, empty = self.folders(name, version), self.spark.createDataFrame([], schema)
        wanted = held if buckets is None else {b: held[b] for b in buckets if b in held}
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, versions in sorted(wanted.items()) for v in versions]
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def write(self, name: str, df: DataFrame, version: int, *keys: str, spread: str | None = None, ways: int = 32) -> list[int]:
        """Write rows of a version to their buckets' folders, in order of the keys; returns the buckets that got any.

        ``spread`` is a column that deals a bucket to ``ways`` tasks, for keys that can hold very many rows.
        """
        path = f"{self.root}/{name}/v={version}"
        own = df.withColumn("bucket", self.bucket(*keys))
        own = own.repartition("bucket") if spread is None else own.repartition("bucket", F.pmod(F.xxhash64(spread), F.lit(ways)))
        own.sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(path)
        fs, folder = file_system(self.spark, path)
        return [int(n.split("=")[1]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith("bucket=")]

    def commit(self, version: int, rewritten: dict[str, tuple[Iterable[int], Iterable[int]]] | None = None, appended: dict[str, Iterable[int]] | None = None) -> None:
        """Make ``version`` the one in force.

        ``rewritten``: table -> (buckets that the version replaces, those of them that have rows now); ``appended``: table ->
        buckets that it adds rows to.
        """
        tables = {name: dict(held) for name, held in self._manifest(self.version()).get("tables", {}).items()}
        for name, (touched, full) in (rewritten or {}).items():
            own = tables.setdefault(name, {})
            for b in touched:
                own.pop(str(b), None)
            own.update({str(b): [version] for b in full})
        for name, full in (appended or {}).items():
            own = tables.setdefault(name, {})
            own.update({str(b): [*own.get(str(b), []), version] for b in full})
        fs, done = file_system(self.spark, f"{self.root}/manifest/{version}")
        _, draft = file_system(self.spark, f"{self.root}/manifest/_draft{version}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "tables": tables}).encode()))
        out.close()
        if not fs.rename(draft, done):
            raise RuntimeError(f"version {version} is there already")

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders of versions that none of the last ``keep`` manifests names; returns how many."""
        fs, folder = file_system(self.spark, f"{self.root}/manifest")
        versions = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
        held = [self._manifest(v)["tables"] for v in versions[-keep:]]
        gone = 0
        for name in {n for t in held for n in t}:
            used = {(v, int(b)) for t in held for b, vs in t.get(name, {}).items() for v in vs}
            _, top = file_system(self.spark, f"{self.root}/{name}")
            for own in fs.listStatus(top):
                v = int(own.getPath().getName().split("=")[1])
                for b in fs.listStatus(own.getPath()) if v <= versions[-1] else []:
                    kind, _, number = b.getPath().getName().partition("=")
                    if kind == "bucket" and (v, int(number)) not in used:
                        gone += fs.delete(b.getPath(), True)
        for v in versions[:-keep]:
            fs.delete(file_system(self.spark, f"{self.root}/manifest/{v}")[1], True)
        return gone
