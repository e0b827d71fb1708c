"""A Parquet table that is merged into by key, in versions with an atomic commit.

Rows lie in buckets of their group's hash.  A merge rewrites the buckets that it touches, each into a new
folder, and then commits a manifest that names one folder for every bucket; a manifest appears by a
rename that fails when another writer was first.  A writer that dies leaves files that no manifest names: the old version stays readable,
and ``clean`` deletes them.  A read opens one folder a bucket, however many merges there were.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.plans.storage import written


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class VersionedTable:
    """Rows grouped by ``group`` (a document, a case): a merge replaces all rows of the groups that it brings."""

    def __init__(self, spark: SparkSession, path: str, group: tuple[str, ...], buckets: int = 32):
        self.spark, self.path, self.group = spark, path.rstrip("/"), group
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        last = self.manifest()
        self.buckets = last["buckets"] if last else buckets

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Committed versions in order."""
        home = self._hadoop(f"{self.path}/_versions")
        if not self._fs.exists(home):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(home)]
        return sorted(int(n[:-5]) for n in names if n[:-5].isdigit() and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version holds, the latest unless said; None for a table without any."""
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        stream = self._fs.open(self._hadoop(f"{self.path}/_versions/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, or of some of its buckets; None where nothing was committed."""
        held = self.manifest(version)
        if held is None:
            return None
        folders = sorted({folder for bucket, folder in held["folders"].items() if only is None or int(bucket) in only})
        schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(held["schema"]).toDDL()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def merge(self, new: DataFrame, token: int | None = None) -> int:
        """Replace the groups of ``new`` by its rows and commit; the version, or the present one when ``token`` was merged before.

        ``token`` numbers the batches of a stream, so that one that is run again changes nothing.  Rows with a null in the group are one group of their own; columns that only some
        versions have are null in the others.
        """
        last = self.manifest()
        if last and token is not None and last["token"] is not None and token <= last["token"]:
            return last["version"]
        bucket = F.pmod(F.xxhash64(*self.group), F.lit(self.buckets)).cast("int").alias("_bucket")
        fresh = written(new.select("*", bucket), "merge")
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # as many as there are buckets at most
        rows, old = fresh, self.read(only=touched) if last else None
        if old is not None:
            kept = self._without(old, fresh.select(*self.group).distinct())
            rows = kept.select("*", bucket).unionByName(fresh, allowMissingColumns=True)
        stem = uuid.uuid4().hex
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{stem}")
        folders = dict(last["folders"]) if last else {}
        folders |= {str(b): f"{stem}/_bucket={b}" for b in touched}
        schema = rows.drop("_bucket").schema
        return self._commit({"version": (last["version"] if last else 0) + 1, "token": token if token is not None else (last or {}).get("token"), "buckets": self.buckets, "folders": folders, "schema": schema.json()})

    def _without(self, old: DataFrame, gone: DataFrame) -> DataFrame:
        named = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in self.group])
        on = F.lit(True)
        for c in self.group:
            on &= F.col(c).eqNullSafe(F.col(f"_gone_{c}"))
        return old.join(named, on, "left_anti")

    def _commit(self, held: dict) -> int:
        jvm, home = self.spark._jvm, f"{self.path}/_versions"
        draft, final = self._hadoop(f"{home}/_draft-{uuid.uuid4().hex}"), self._hadoop(f"{home}/{held['version']:010d}.json")
        self._fs.mkdirs(self._hadoop(home))
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(held).encode()))
        finally:
            stream.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext()
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {held['version']} was committed by another writer") from error
            raise
        return held["version"]

    def clean(self, keep: int = 2) -> int:
        """Drop all but the last ``keep`` versions and every file that none of them names; how many folders went.  Not beside a running writer."""
        known = self.versions()
        for version in known[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/_versions/{version:010d}.json"), False)
        used = {folder for version in known[-keep:] for folder in self.manifest(version)["folders"].values()}
        gone, home = 0, self._hadoop(f"{self.path}/data")
        for merge in self._fs.listStatus(home) if self._fs.exists(home) else []:
            for part in self._fs.listStatus(merge.getPath()):
                if part.isDirectory() and f"{merge.getPath().getName()}/{part.getPath().getName()}" not in used:
                    self._fs.delete(part.getPath(), True)
                    gone += 1
            if not any(part.isDirectory() for part in self._fs.listStatus(merge.getPath())):
                self._fs.delete(merge.getPath(), True)
        return gone
