"""What several corpus operators share: words, shared storage for intermediate tables, sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

#: A word is a run of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with more underscores before those that are taken; Spark's names ignore case."""
    known = {n.lower() for n in taken}
    out = []
    for name in wanted:
        while name.lower() in known:
            name = f"_{name}"
        out.append(name)
    return out


def others(docs: DataFrame, *names: str) -> list[StructField]:
    """The columns of docs but those with one of the names, whatever the case."""
    gone = {n.lower() for n in names}
    return [f for f in docs.schema.fields if f.name.lower() not in gone]


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ddl(fields: list[StructField], *more: str) -> str:
    return ", ".join([f"{tick(f.name)} {f.dataType.simpleString()}" for f in fields] + list(more))


def numbered(fields: list[StructField]) -> list[Column]:
    """Columns as c0, c1 and so on: on their way through Python they may be named anything, so they go by place."""
    return [F.col(tick(f.name)).alias(f"c{i}") for i, f in enumerate(fields)]


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null. Counting where words begin keeps no list of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='veilsift-')}"
        _forget_at_exit(spark, found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def forget() -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            _delete(spark, path)

    atexit.register(forget)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither recompute it nor lose it
    with an executor. The table goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veilsift-{name}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = weakref.ref(out), path
    return out


#: Where tables that materialize gave lie.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize gave, once nothing that is still to run reads them.

    The shuffles that made them go as well: Spark deletes those that the driver's collector finds unused, and without
    a call it would hardly ever look, as a driver with little to do has little to collect.
    """
    for table in tables:
        ref, path = _PATHS.pop(id(table), (None, ""))
        if ref is not None and ref() is table:
            _delete(table.sparkSession, path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that nothing uses back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, and what it held is given back when it ends: Spark keeps its Python workers for later tasks, of this stage
    or another, and what a worker has kept comes on top of all that the executor needs then."""

    @functools.wraps(run)
    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        release()

    return tidied
