"""Tables that are replaced in one step, with their earlier versions kept until they are dropped.

A table is a folder with a folder of Parquet files for each version, and a manifest that names the current one. A new version is
written completely before a rename puts its manifest in place of the old one, which the file system does at once or not at all.
So a job that fails leaves the table as it was, a table can be rewritten from itself, and a reader keeps the version that it
opened whatever is written meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_current"
VERSION = "version-"


class Snapshots:
    """The versions of the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(self._conf)

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def current(self) -> str | None:
        """Name of the version that readers get now; None if there is none yet."""
        manifest = self._place(MANIFEST)
        if not self._files.exists(manifest):
            return None
        stream = self._files.open(manifest)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def versions(self) -> list[str]:
        """All versions that are there, oldest first; those of failed jobs among them."""
        if not self._files.exists(self._folder):
            return []
        found = [s for s in self._files.listStatus(self._folder) if s.getPath().getName().startswith(VERSION)]
        return [s.getPath().getName() for s in sorted(found, key=lambda s: (s.getModificationTime(), s.getPath().getName()))]

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of a version, the current one by default; later writes do not change what this reads."""
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def replace(self, df: DataFrame, *, sort_by: str | None = None, expect: str | None = None) -> DataFrame:
        """Make ``df`` the current version and read it back.

        ``expect`` is the version that ``df`` was made from: if another writer has replaced it since, the switch is refused and the
        table stays as that writer left it.
        """
        if sort_by:
            df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
        version = f"{VERSION}{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        if expect is not None and self.current() != expect:
            self._files.delete(self._place(version), True)
            raise RuntimeError(f"{self.path} is no longer at {expect}")
        self._switch(version)
        return self.read(version)

    def _switch(self, version: str) -> None:
        fresh = self._place(f"{MANIFEST}-{uuid.uuid4().hex}")
        stream = self._files.create(fresh, False)
        try:
            stream.write(version.encode())
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self._conf)
        context.rename(fresh, self._place(MANIFEST), overwrite)

    def drop_old(self, keep: int = 1) -> list[str]:
        """Delete all but the current version and the ``keep`` - 1 newest others. Call it when nothing reads these any more."""
        current = self.current()
        others = [v for v in self.versions() if v != current]
        gone = others[: len(others) - (keep - 1)] if keep > 1 else others
        for version in gone:
            self._files.delete(self._place(version), True)
        return gone
