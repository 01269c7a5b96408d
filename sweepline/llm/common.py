"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage. The session names it; only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sweepline-"))
    return spark.sparkContext.getCheckpointDir()


_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables of written() inside of this go when it ends; result() writes what stays."""
    path = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
    token = _folders.set((*_folders.get(), path))
    try:
        yield
    finally:
        _folders.reset(token)
        discard(spark, path)


def written(df: DataFrame, name: str, outside: int = 0) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and the table's path."""
    spark = df.sparkSession
    folders = (scratch_root(spark), *_folders.get())
    path = f"{folders[max(0, len(folders) - 1 - outside)]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def result(df: DataFrame, name: str) -> DataFrame:
    """df as a table that outlives the innermost scratch()."""
    return written(df, name, 1)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of written() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(name: str, columns: list[str]) -> str:
    """name, with ``_`` behind it until no column has it (names of columns are the same in upper and lower case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text, a null being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def release_memory(spark: SparkSession) -> None:
    """Give the driver's freed memory back to the system, from Python and from the JVM: Arrow's pool and the C library keep it otherwise, for good.

    In the JVM it is what compilers and codecs allocated outside of the heap, hundreds of MB after some thousand
    stages. Its diagnostic command exists on Linux, from Java 17.0.9 on; without it, the JVM's share stays. Spark
    deletes shuffle files and broadcasts of queries that nothing holds any more once the JVM has collected them.
    """
    gc.collect()
    spark._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)
    jvm, array, of = spark._jvm, spark.sparkContext._gateway.new_array, spark._jvm.java.lang.Class.forName
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # by the public interface: the server's own class is hidden from Python
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.Object, 0), array(jvm.String, 0)
    with suppress(Py4JJavaError):
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)


def bounded_batches(spark: SparkSession, rows: int = 512, size: str = "32m") -> SparkSession:
    """Hold the Arrow batches of Python operators on whole texts to so many rows and bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def extended(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema with further fields, given by name and type."""
    return T.StructType([*schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items())])
