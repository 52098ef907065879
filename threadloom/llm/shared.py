"""What the operators of this subpackage share: shared storage and small plan helpers."""

from __future__ import annotations

import gc
import os
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship  # noqa: F401  for the operators


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) is a folder of our own chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"/tmp/checkpoints/threadloom-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scope:
    """The tables in the shared folder that the operators called inside a :func:`scope` made."""

    def __init__(self):
        self.paths: list[str] = []

    def free(self, spark: SparkSession) -> None:
        """Delete them; only once nothing reads the results made inside the scope any more."""
        while self.paths:
            fs, path = _store(spark, self.paths.pop())
            fs.delete(path, True)


_SCOPES: ContextVar[tuple[Scope, ...]] = ContextVar("threadloom_scopes", default=())


@contextmanager
def scope():
    """Collect the tables made inside, and only those, so that the caller can :meth:`Scope.free` them later."""
    made = Scope()
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(token)


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def claim(spark: SparkSession, path: str) -> str:
    """Mark ``path`` as ours: it goes when the innermost scope is freed, or else when the application ends."""
    if _SCOPES.get():
        _SCOPES.get()[-1].paths.append(path)
    fs, where = _store(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = claim(spark, f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}")
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HEAVY: dict = {}


def worker_object(key, make):
    """What ``make()`` gives, once per Python worker; a worker keeps one such object, since it outlives stages and their memory."""
    if key not in _HEAVY:
        spare()
        _HEAVY[key] = make()
    return _HEAVY[key]


#: Rows of an Arrow batch in :func:`small_batches`.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python workers ``BATCH_ROWS`` at a time, unless the session asks for fewer.

    A batch is held in the JVM and once more in the worker, by every task; results don't depend on it. It is a setting of the
    session, read when a plan is made, so it stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def spare() -> None:
    """Let go of what an earlier step left in this Python worker; for steps that keep no such object, or need much memory."""
    if _HEAVY:
        _HEAVY.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)`` as rows ``(node, root)``, one a node, root the smallest node reachable.

    Alternates the large-star and small-star steps, which keep connectivity and only ever add edges to smaller
    neighbours, and writes the edge table after each round. Each round begins with every node's least neighbour, which also
    tells whether all components are stars by now: then those rows are the result. Nodes without an edge are absent; an
    empty table gives an empty result. Minima are pre-aggregated before each shuffle, and the joins are plain, so skewed
    hubs can be split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(limit):
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        # In a star the centre has larger neighbours only, and any other node has one neighbour.
        other = (F.min("b") < F.col("a")) & (F.min("b") < F.max("b"))
        least = written(now.union(up).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), other.alias("other")), "least")
        if not least.agg(F.max("other").alias("other")).first()["other"]:
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = up.join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {limit} rounds")
