"""Intermediate tables in the folder that driver and executors share, and how joins read them."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode only, a folder of this machine where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='conceptloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Seconds between two collections of the driver's garbage.
TIDY_S = 3.0
_tidied = 0.0


def _diagnose(spark: SparkSession, command: str) -> None:
    """A diagnostic command of the driver's JVM. The server's class is not open to Py4J, the interface's method is."""
    java, gateway = spark._jvm.java.lang, spark.sparkContext._gateway

    def array(kind: object, *values: object) -> object:
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds = [java.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *kinds))
    invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, name, command, array(java.Object), array(java.String)))


def give_back(spark: SparkSession) -> tuple[bool, bool]:
    """Return what the allocators of the driver's Python and JVM hold free to the system; whether each could. Compiling the plans of
    many small jobs leaves free native memory in the arenas of many threads, and fitted models leave it in Python's."""
    python = jvm = False
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
        python = True
    with contextlib.suppress(Py4JError):  # only some JVMs have the command
        _diagnose(spark, "systemTrimNativeHeap")
        jvm = True
    return python, jvm


def tidy(spark: SparkSession) -> bool:
    """Collect the driver's garbage, at most every TIDY_S seconds; whether it did. A query of many small jobs leaves plans and task
    results behind, with which the heap would grow to its limit, and shuffle files stay until what refers to them is collected."""
    global _tidied
    if time.monotonic() - _tidied < TIDY_S:
        return False
    gc.collect()  # what Python refers to stays alive in the JVM
    spark._jvm.System.gc()
    give_back(spark)
    _tidied = time.monotonic()
    return True


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast. Planners size generated rows and written tables by compressed files, of which a
    few megabytes can fill the driver."""
    return df.hint("merge")
