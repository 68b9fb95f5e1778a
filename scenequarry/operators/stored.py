"""Tables that cut lineage: written as Parquet to the folder that all executors share, and read back.

A chain of checkpoints would carry products of size estimates from round to round; a stored table starts anew. Its size is that of packed
files, so large ones are kept from being broadcast by their rows.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rows above which a table is never broadcast unasked.
LARGE = 10_000
#: Spark's setting that a finished action's shuffle files go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only where none is set and all runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="scenequarry-")
        atexit.register(shutil.rmtree, own, True)
        _OWN[context.applicationId] = f"file://{own}"
    return _OWN[context.applicationId]


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Actions within leave no shuffle files behind: nothing reads them again, and those of all steps together are many times the input."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str = "table", tidy: bool = True) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends there and survives a lost executor. What the write shuffled is deleted, if ``tidy``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scenequarry-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with tidied(spark) if tidy else contextlib.nullcontext():
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    return unbroadcast(found, found.count())


def unbroadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df``, read from a table of so many ``rows``, so that a join sorts it where they are more than ``LARGE``.

    Spark broadcasts what is small as a file; a packed file may hold millions of rows, and an operator that multiplies them goes by the same size. All would pass
    through the driver. A broadcast that is asked for (``camera.small``, which counts) still holds.
    """
    return df.hint("merge") if rows > LARGE else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems know the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove_stored(spark: SparkSession, df: DataFrame | None = None) -> None:
    """Delete a stored table that nothing will read again (a finished round's), or all that this application stored."""
    root = f"{shared_folder(spark)}/scenequarry-{spark.sparkContext.applicationId}"
    paths = [root] if df is None else sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
