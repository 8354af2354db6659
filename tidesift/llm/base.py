"""What the operators of this subpackage share: the stash, table reading and id columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what lies between these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: What has been stashed and not dropped, for each stage that is being written.
_open: list[list[DataFrame]] = []
#: What a worker process keeps from one task to the next: models with their tables.
kept: dict[tuple, object] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tidesift-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: cuts lineage, survives lost executors, is computed once.

    The folder goes when the driver's JVM ends; ``drop_stash`` removes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    if _open:
        _open[-1].append(out)
    return out


def drop_stash(df: DataFrame) -> None:
    """Remove a stash that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stash)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stash_stage(make: Callable[[], DataFrame]) -> DataFrame:
    """What a stage makes, as a stash; whatever it stashed on its way goes once that is written."""
    _open.append([])
    try:
        out = stash(make())
    finally:
        made = _open.pop()
    for df in made[:-1]:
        drop_stash(df)
    return out


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context: they may lack the folder that the driver imports it from."""
    context = spark.sparkContext
    if getattr(context, "_tidesift_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tidesift-")) / "tidesift_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    context._tidesift_shipped = True


def lean(each: Callable, keep: bool = False) -> Callable:
    """A function for mapInArrow whose tasks leave a worker small.

    Workers live on between tasks and stages, and allocators keep what was freed: without this, an executor pays for the largest
    task of each worker as long as it runs. What the worker keeps goes before the first batch unless the tasks use it (``keep``).
    """

    def task(batches: Iterator) -> Iterator:
        if not keep:
            forget()
        try:
            yield from each(batches)
        finally:
            give_back()

    return task


def forget() -> None:
    """Drop what this worker keeps."""
    kept.clear()


def give_back() -> None:
    """Return memory that nothing uses to the system: Arrow's pool, then the C library's heap where it can be trimmed."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def whole_rows(docs: DataFrame) -> DataFrame:
    """row: each row as one struct, so that no column of the input can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def id_text(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id as long, text (null as empty) and the columns named; whatever else the table has goes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)
