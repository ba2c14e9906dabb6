"""Tables whose versions are named by manifests, so that a reader never sees half a write.

A commit writes its rows to a new folder and then creates the next manifest, a small file
that lists the folders of the version.  Creation is exclusive: of two writers that start
from one version, the second fails and can try again.  Readers follow the newest complete
manifest; folders that no manifest names are left-overs of writes that did not end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError


class ConflictError(RuntimeError):
    """Another writer has committed this version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd") -> None:
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._system = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self._path(f"{self.path}/_manifests/{version:012d}.json")

    def _read(self, file) -> dict | None:
        stream = self._system.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # its writer has not ended, or never will
            return None

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifests")
        if not self._system.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._system.listStatus(folder)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True)

    def current(self) -> tuple[int, list[str]]:
        """(version, folders) of the newest complete version; 0 and none before the first."""
        for version in self._versions():
            found = self._read(self._manifest(version))
            if found is not None:
                return version, found["folders"]
        return 0, []

    def read(self) -> DataFrame | None:
        """Rows of the newest version, None before the first."""
        _, folders = self.current()
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def _commit(self, version: int, folders: list[str]) -> None:
        newest = max([version, *self._versions()[:1]])
        target = self._manifest(newest + 1)
        if newest > version and self._read(self._manifest(newest)) is not None:
            raise ConflictError(f"version {newest} of {self.path} was committed meanwhile")
        try:
            stream = self._system.create(target, False)
        except (Py4JJavaError, CapturedException) as exists:
            raise ConflictError(f"version {newest + 1} of {self.path} was committed meanwhile") from exists
        try:
            stream.write(bytearray(json.dumps({"folders": folders}).encode()))
        finally:
            stream.close()

    def write(self, df: DataFrame) -> str:
        """Rows in a new folder that no version names yet."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.option("compression", self.compression).parquet(f"{self.path}/{folder}")
        return folder

    def replace(self, df: DataFrame, check=None) -> DataFrame:
        """A version of these rows alone; ``check(written)`` may reject it before it is committed."""
        version, _ = self.current()
        folder = self.write(df)
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        if check is not None:
            check(written)
        self._commit(version, [folder])
        return written

    def append_missing(self, df: DataFrame, keys: list[str]) -> int:
        """Add the rows whose key the store lacks (one row a key); returns how many were added.

        Done again, by a retry or a second run, it adds nothing.
        """
        version, folders = self.current()
        new = df.dropDuplicates(keys)
        stored = self.read()
        if stored is not None:
            known = stored.select(*[F.col(k).alias(f"__{k}") for k in keys])
            on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            new = new.join(known, on, "left_anti")
        folder = self.write(new)
        added = self.spark.read.parquet(f"{self.path}/{folder}").count()
        if added:
            self._commit(version, [*folders, folder])
        else:
            self._system.delete(self._path(f"{self.path}/{folder}"), True)
        return added

    def vacuum(self) -> int:
        """Delete folders and manifests that the newest version does not need; returns their number.

        To be called when no reader uses an older version any more.
        """
        version, folders = self.current()
        names = [s.getPath() for s in self._system.listStatus(self._path(self.path))] if version else []
        old = [p for p in names if p.getName().startswith("data-") and p.getName() not in folders]
        old += [self._manifest(v) for v in self._versions() if v < version]
        for p in old:
            self._system.delete(p, True)
        return len(old)
