"""Tables that outlive a session: each write is a new version of a table, read once it is whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the driver and all executors share, or of this machine where it is all there is (tests); removed when the session's file systems close."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(base or f'file://{tempfile.mkdtemp(prefix="palimpsest-")}').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as it is now, written to the shared folder and read back: later plans begin here and know its size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Parquet tables under a folder of any file system: <table>/v<number>, of which the last that was finished counts.

    A reader never sees half a write, and a reader of the version before keeps its files until the write after the next.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._files = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, name: str) -> list[tuple[int, str]]:
        """Number and folder of the whole versions of a table, oldest first; a folder is v<number> or v<number>-<key>."""
        found = [v for v in self.names(name) if v[:1] == "v" and v[1:].split("-")[0].isdigit() and self._files.exists(self._at(name, v, "_SUCCESS"))]
        return sorted((int(v[1:].split("-")[0]), v) for v in found)

    def versions(self, name: str) -> list[int]:
        """Numbers of the whole versions of a table, oldest first."""
        return [n for n, _ in self._folders(name)]

    def last_key(self, name: str) -> str | None:
        """The key that the last version of a table was written under."""
        found = self._folders(name)
        return found[-1][1].partition("-")[2] or None if found else None

    def names(self, folder: str) -> list[str]:
        """What a folder beside the tables holds."""
        at = self._at(folder)
        return [str(x.getPath().getName()) for x in self._files.listStatus(at)] if self._files.exists(at) else []

    def remove(self, folder: str) -> None:
        self._files.delete(self._at(folder), True)

    def read(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        """The last version of a table; default where there is none."""
        found = self._folders(name)
        return self.spark.read.parquet(f"{self.path}/{name}/{found[-1][1]}") if found else default

    def write(self, name: str, df: DataFrame, key: str | None = None) -> DataFrame:
        """df as the next version, read back; df may be made of the version before. A version's key is whole with it."""
        found = self._folders(name)
        n = found[-1][0] + 1 if found else 1
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{n}{f'-{key}' if key else ''}")
        for _, old in found[:-1]:
            self._files.delete(self._at(name, old), True)
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, key: str) -> DataFrame:
        """The table with the rows of new in place of those with their key."""
        old = self.read(name)
        return self.write(name, new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True))

    def delete(self, name: str, ids: DataFrame, key: str) -> DataFrame | None:
        old = self.read(name)
        return None if old is None else self.write(name, old.join(ids.select(key).distinct(), key, "left_anti"))

    def clear(self, name: str) -> DataFrame | None:
        old = self.read(name)
        return None if old is None else self.write(name, old.where(F.lit(False)))
