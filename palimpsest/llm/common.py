"""What the operators of this subpackage share: word splitting, tables in the shared folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run on executors travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: White space of the contracts: U+0020 and U+0009 to U+000D; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python 2,000 rows at a time, where the session leaves Spark's default of 10,000: a batch stays some megabytes on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def no_space(text: Column) -> Column:
    return F.translate(text, SPACE_CHARS, "")


def word_count(text: Column) -> Column:
    """Number of words as long, without building an array of the spaces; null counts 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where it is unset, one of this machine, which must be all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = found or f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}"


#: Paths made by this process, oldest first.
MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed by released() or when the session's file systems close."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    MADE.append(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    Cuts the lineage with replicated files, so that a lost executor costs only its running
    tasks, and gives the planner exact sizes: a later join broadcasts it only if it is small.
    """
    small_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def given_back(run: Callable) -> Callable:
    """A function over Arrow batches that returns its task's memory to the system at the end: idle workers stay beside stages that need none."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def released(spark: SparkSession, since: int) -> None:
    """Removes the tables made after the first `since`, but for the last one: what a stage needed before its result was written."""
    jvm = spark.sparkContext._jvm
    for path in MADE[since:-1]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del MADE[since:-1]


def null_safe(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join in which nulls match nulls; pairs name the columns of left and right."""
    on = None
    for a, b in keys:
        one = left[a].eqNullSafe(right[b])
        on = one if on is None else on & one
    return left.join(right, on, how)
