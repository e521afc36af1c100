"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Tables written by this thread since its innermost ``scratch_scope`` began.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def build_session(app: str = "cardwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "static",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Stored bytes that one task reads at most where more tasks would only cost time.
FEW_BYTES = 16 << 20


def few_bytes(df: DataFrame) -> bool:
    """Whether what ``df`` reads is small enough for one task, as the planner counts it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= FEW_BYTES


@lru_cache(maxsize=8)
def workers(n: int) -> ThreadPoolExecutor:
    """``n`` threads that stay: each thread of Python has one in the JVM, which keeps memory of its own."""
    return ThreadPoolExecutor(n, thread_name_prefix=f"cardwarden-{n}")


def start_beside(spark: SparkSession, work: Callable, *args) -> Future:
    """Run ``work`` in another thread. It must not wait for such work itself beyond one level or two."""
    return workers(16).submit(inheritable_thread_target(spark)(work), *args)


@contextmanager
def beside(spark: SparkSession, work: Callable, *args) -> Iterator[Future]:
    """Run ``work`` in a thread beside the body; it has ended, or raised, when the body is left."""
    found = start_beside(spark, work, *args)
    try:
        yield found
    finally:
        wait([found])
    found.result()


def give_back(spark: SparkSession) -> None:
    """Have the driver's JVM drop plans, broadcasts and generated classes that nothing uses, and return
    free memory to the system; a long stream makes many of them, and the JVM alone keeps it all."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    # ``MBeanServer.invoke(commands, "systemTrimNativeHeap", null, null)``, which Py4J calls by reflection only.
    kind = jvm.java.lang.Class.forName
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, values = array(jvm.java.lang.Class, len(names)), array(jvm.java.lang.Object, len(names))
    for i, name in enumerate(names):
        kinds[i] = kind(name)
    values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    values[1] = "systemTrimNativeHeap"
    with suppress(Py4JError):  # not every JVM has the command
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    A machine-local folder is set only in local mode, where nothing was named.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cardwarden-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/scratch-{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cached frame the table survives the loss of any executor, and unlike an RDD
    checkpoint it stays columnar and carries its true size for the join planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, what this thread's ``materialize`` calls wrote inside.

    For work that ends inside the scope; nothing read later may depend on its tables.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for name in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
