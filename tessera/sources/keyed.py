"""Tables that are replaced by key: a folder of hash buckets, each in the version that wrote it last.

A version writes only the buckets it touches; a manifest names the version of every bucket and is what makes a version visible.
Whoever reads sees one manifest, so a run that fails, or is run again, leaves nothing half done.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import written


class ConflictError(RuntimeError):
    """Another writer has made the version that this one would have made."""


class KeyedTable:
    """Rows by (r, c) in `buckets` buckets below `folder`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # Manifests are small files beside the data.

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """The numbers of the versions that are there, in order."""
        fs, path = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def newest(self, below: int | None = None) -> int | None:
        """The newest version, or the newest before a number; None where there is none."""
        found = [v for v in self.versions() if below is None or v < below]
        return found[-1] if found else None

    def _manifest(self, version: int) -> dict:
        fs, path = self._fs(f"manifests/{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict, again: bool) -> None:
        """Puts a manifest in its place; the place is taken only once unless a version is made `again`."""
        fs, path = self._fs(f"manifests/{version}.json")
        if not again and fs.exists(path):
            raise ConflictError(f"version {version} of {self.folder} has been made by somebody else")
        temporary = self._fs(f"manifests/.{version}.{manifest['run']}")[1]
        out = fs.create(temporary, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        if again:
            fs.delete(path, False)
        if not fs.rename(temporary, path):
            fs.delete(temporary, False)
            raise ConflictError(f"version {version} of {self.folder} has been made by somebody else")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("r", "c"), F.lit(self.buckets)).cast("int")

    def read(self, below: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The newest version, or the newest before a number; `only` some of its buckets."""
        version = self.newest(below)
        if version is None:
            raise FileNotFoundError(self.folder)
        return self._read(self._manifest(version), only)

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/{run}/bucket={b}" for b, run in manifest["buckets"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def create(self, rows: DataFrame) -> int:
        """All rows as a new version, whatever was there before."""
        version = (self.newest() if self.newest() is not None else -1) + 1
        self._write(rows, {}, list(range(self.buckets)), version, False)
        return version

    def replace(self, made: DataFrame, keys: DataFrame, version: int | None = None, expected: int | None = None) -> int:
        """The rows of keys (r, c) taken out and those of made put in, as a version; each replaced row is replaced whole.

        Only the buckets of keys and made are read and written. With a `version` the same batch can be applied again. With
        `expected` a ConflictError is raised where the newest version is another one by now.
        """
        again = version is not None
        base = self.newest(version)
        if expected is not None and base != expected:
            raise ConflictError(f"{self.folder} is at version {base} and no longer at {expected}")
        manifest = self._manifest(base) if base is not None else {"buckets": {}}
        made = written(made, "made")
        doomed = written(keys.select("r", "c").unionByName(made.select("r", "c")).distinct(), "keys")
        # At most one number per bucket comes to the driver.
        touched = sorted(x[0] for x in doomed.select(self.bucket()).distinct().collect())
        rows = made
        if base is not None:
            kept = self._read(manifest, touched)
            rows = kept.join(doomed, ["r", "c"], "left_anti").unionByName(made, allowMissingColumns=True)
        number = version if again else (base if base is not None else -1) + 1
        self._write(rows, manifest["buckets"], touched, number, again)
        return number

    def _write(self, rows: DataFrame, buckets: dict[str, str], touched: list[int], version: int, again: bool) -> None:
        import uuid

        run = f"v{version}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{run}")
        fs, path = self._fs(run)
        written = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(path) if s.isDirectory()}
        kept = {b: r for b, r in buckets.items() if int(b) not in set(touched)}
        manifest = {"run": run, "schema": json.loads(rows.schema.json()), "buckets": kept | {b: run for b in sorted(written)}}
        self._commit(version, manifest, again)

    def expire(self, keep: int = 2) -> None:
        """Deletes all but the newest versions, and the files that none of those names."""
        versions = self.versions()
        if not versions:
            return
        held = {run for v in versions[-keep:] for run in self._manifest(v)["buckets"].values()}
        fs, root = self._fs("")
        for v in versions[:-keep]:
            fs.delete(self._fs(f"manifests/{v}.json")[1], False)
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v") and name not in held:
                fs.delete(status.getPath(), True)
