"""Stage tables: results written once and read back by the steps after them.

A stage is a parquet table in the folder the cluster names in
``spark.checkpoint.dir``. It cuts the lineage, survives lost executors and,
unlike a cache, is read column by column with known sizes. Stages over known
inputs are named by what they derive from, so that a later application finds them.
"""

from __future__ import annotations

import functools
import hashlib
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def edition() -> str:
    """Digest of this package's own code: stages of other code are left alone."""
    package = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for part in ("", "functions/", "operators/", "plans/", "sources/"):
        for file in sorted(package.glob(f"{part}*.py")):
            digest.update(file.relative_to(package).as_posix().encode() + file.read_bytes())
    return digest.hexdigest()


def stage_root(spark: SparkSession) -> str:
    """The shared folder of the session; the warehouse's own disk in local mode only."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError(
                "set spark.checkpoint.dir to a folder all executors share; "
                "stage tables are written there"
            )
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return configured.rstrip("/")


class Folder:
    """Files below a path of any file system Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def rename(self, old: str, new: str) -> bool:
        """False where ``new`` is there already."""
        if self.fs.exists(self.at(new)):
            return False
        return self.fs.rename(self.at(old), self.at(new))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(name)))

    def write_text(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


class Stages:
    """Stage tables of one analysis over one set of inputs.

    ``source`` names the inputs and everything else the stages derive from; without it
    the stages belong to this object alone and ``close`` removes them.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, source: str | None = None):
        self.spark = spark
        self.shared = source is not None
        name = uuid.uuid4().hex
        if source is not None:
            name = "by-input/" + hashlib.sha256(f"{edition()}\n{spark.version}\n{source}".encode()).hexdigest()[:32]
        self.path = f"{root or stage_root(spark)}/tallywise/{name}"
        self.folder = Folder(spark, self.path)
        self.built: list[str] = []
        self._read: dict[str, DataFrame] = {}
        # A stage is built once, and building one may ask for another.
        self._building = threading.RLock()

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Read stage ``name``, writing it first when it is not there (any more).

        It is written under another name and renamed when complete, so a reader never
        sees half of it and of two writers one wins.
        """
        target = f"{self.path}/{name}"
        with self._building:
            if not self.folder.exists(f"{name}/_SUCCESS"):
                draft = f"_draft-{uuid.uuid4().hex}-{name}"
                build().write.parquet(f"{self.path}/{draft}")
                if not self.folder.rename(draft, name):
                    self.folder.delete(draft)
                self.built.append(name)
                self._read.pop(name, None)
            if name not in self._read:
                self._read[name] = self.spark.read.parquet(target)
            return self._read[name]

    def close(self) -> None:
        """Remove own stages; those named by their inputs stay for others."""
        self._read.clear()
        if not self.shared:
            self.folder.delete()
