"""Versioned artifacts: tables, models and settings that one job builds and others read.

An artifact has a name and a key: the digest of its input snapshot, its
parameters and ``VERSION``. A build writes a folder of its own; when all of it
is written, one row appended to the name's manifest makes it visible (the
append commits by a single rename). Readers resolve the manifest, so they see
an older version or the new one, never a half-written one; a build that dies
leaves an unreferenced folder and the old version in place.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir

#: Raised when a build's meaning changes: older artifacts are then built anew.
VERSION = "2"
MANIFEST = "key string, version string, at long"


def snapshot(spark: SparkSession, sf_dir: str, tables) -> str:
    """Digest of the files of the tables: path, length and time of each (no content is read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load([os.path.join(sf_dir, f"{t}.parquet") for t in tables]))
    n, a, b = files.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64("path", "length", "modificationTime", F.lit(s)).cast("decimal(38,0)"))
                                            for s in (1, 2)]).first()
    return f"{n}:{a}:{b}"


class Artifacts:
    """The artifact store of a session: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or os.path.join(ensure_checkpoint_dir(spark), "artifacts")

    def _manifest(self, name: str) -> str:
        return os.path.join(self.root, name, "manifest")

    def versions(self, name: str) -> DataFrame:
        """(key, version, at) of every committed version of ``name``."""
        try:
            return self.spark.read.schema(MANIFEST).json(self._manifest(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def path(self, name: str, key: str | None = None) -> str | None:
        """Folder of the latest committed version (of ``key``, or of any), or None."""
        rows = self.versions(name)
        rows = rows if key is None else rows.where(F.col("key") == key)
        version = rows.agg(F.max_by("version", F.struct("at", "version"))).first()[0]
        return None if version is None else os.path.join(self.root, name, version)

    def publish(self, name: str, key: str, build: Callable[[str], None]) -> str:
        """Build a new version in its own folder, then switch the pointer to it."""
        version = uuid.uuid4().hex
        folder = os.path.join(self.root, name, version)
        build(folder)
        self.spark.createDataFrame([(key, version, time.time_ns())], MANIFEST).coalesce(1).write.mode("append").json(
            self._manifest(name))
        return folder

    def get(self, name: str, inputs: str, build: Callable[[str], None], **parameters) -> str:
        """Folder of the artifact of this input snapshot and these parameters; built once if there is none."""
        key = hashlib.sha256(repr((VERSION, inputs, sorted(parameters.items()))).encode()).hexdigest()[:32]
        return self.path(name, key) or self.publish(name, key, build)

    def table(self, name: str, inputs: str, make: Callable[[], DataFrame], **parameters) -> DataFrame:
        """An artifact that is one table."""
        return self.spark.read.parquet(self.get(name, inputs, lambda folder: make().write.parquet(folder), **parameters))
