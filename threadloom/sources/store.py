"""Tables as revisions: working tables, an atomic pointer that moves by generations, and results kept by their key.

A published name is a folder. Its revisions are folders of Parquet that are never written twice; its pointer is a series of
small files ``_pointer/000000000001``, ``...2``, each written whole under another name and then put in place only if that
generation does not exist yet. So a reader that takes the highest generation always finds one whole revision, whatever
happened to a writer, and of two writers that saw the same generation one wins and the other is told.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_pointer"


class Conflict(RuntimeError):
    """Another writer has moved the pointer since it was read."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _list(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times (ms) of what is in a folder; none if there is no such folder."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    return [(x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(where)]


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _read(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place, whole, unless there is one already; whether it was put there."""
    jvm = spark.sparkContext._jvm
    draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.draft"
    fs, where = _fs(spark, draft)
    out = fs.create(where, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace the file, a link does not
            local = lambda p: _fs(spark, p)[1].toUri().getPath()
            try:
                os.link(local(draft), local(path))
            except FileExistsError:
                return False
            return True
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(where, jvm.org.apache.hadoop.fs.Path(path), how)  # refuses an existing target
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(where, False)


class Published:
    """The revisions of one name: a set of tables that move together."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def generations(self) -> list[int]:
        return sorted(int(n) for n, _ in _list(self.spark, f"{self.path}/{POINTER}") if n.isdigit())

    def entry(self, generation: int | None = None) -> dict | None:
        """What the pointer says (``generation, revision, folder, tables``): the latest, or that of a generation."""
        found = self.generations() if generation is None else [generation]
        return json.loads(_read(self.spark, f"{self.path}/{POINTER}/{found[-1]:012d}")) if found else None

    def write(self, tables: dict[str, DataFrame], options: dict[str, dict[str, str]] | None = None) -> str:
        """Write tables as a revision's folder that nothing points to yet. If one fails, the folder goes.

        ``options``: of some tables, further options of the writer.
        """
        folder = f"rev-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.mode("errorifexists").options(**{"compression": "zstd"} | (options or {}).get(name, {})).parquet(f"{self.path}/{folder}/{name}")
        except Exception:
            _delete(self.spark, f"{self.path}/{folder}")
            raise
        return folder

    def commit(self, folder: str, revision: str, tables: list[str], expected: int, more: dict | None = None) -> int:
        """Make a written folder the generation after ``expected``, or raise :class:`Conflict` if there is one.

        ``more`` goes into the entry; folders that it names as ``segments`` are kept as long as the entry.
        """
        entry = {"generation": expected + 1, "revision": revision, "folder": folder, "tables": sorted(tables)} | (more or {})
        fs, where = _fs(self.spark, f"{self.path}/{POINTER}")
        fs.mkdirs(where)
        if not create_once(self.spark, f"{self.path}/{POINTER}/{expected + 1:012d}", json.dumps(entry)):
            raise Conflict(f"generation {expected + 1} of {self.path} exists")
        return expected + 1

    def publish(self, tables: dict[str, DataFrame], revision: str, expected: int | None = None) -> int:
        """Write and commit. ``expected``: the generation that the tables were made from (0: none yet); without it, the
        latest one when the tables have been written, as often as another writer comes first."""
        folder = self.write(tables)
        while True:
            try:
                return self.commit(folder, revision, list(tables), max([0, *self.generations()]) if expected is None else expected)
            except Conflict:
                if expected is not None:
                    _delete(self.spark, f"{self.path}/{folder}")
                    raise

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        entry = self.entry(generation)
        if entry is None:
            raise FileNotFoundError(f"nothing is published at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{entry['folder']}/{name}")

    def sweep(self, keep: int = 2, older_s: float = 86_400) -> list[str]:
        """Delete folders that no kept generation points to and that are older than any writer takes; what went.

        The last ``keep`` generations stay, so a reader that has just read the pointer keeps its tables.
        """
        found = self.generations()
        entries = [self.entry(g) for g in found[-keep:]]
        kept = {f for e in entries for f in (e["folder"], *e.get("segments", ()))}
        gone = []
        for name, ms in _list(self.spark, self.path):
            if name.startswith("rev-") and name not in kept and time.time() - ms / 1000 >= older_s:
                _delete(self.spark, f"{self.path}/{name}")
                gone.append(name)
        for g in found[:-keep]:
            _delete(self.spark, f"{self.path}/{POINTER}/{g:012d}")
        return gone


class Cache:
    """Results by the key of what they were made from (see ``retrieval.revision``); a key's result never changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.hits, self.misses = spark, root.rstrip("/"), 0, 0

    def find(self, key: str) -> DataFrame | None:
        entry = Published(self.spark, self.root, key).entry()
        return None if entry is None else self.spark.read.parquet(f"{self.root}/{key}/{entry['folder']}/result")

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored result, or else what ``make`` gives, stored; of two writers at once the first one's counts."""
        found = self.find(key)
        if found is not None:
            self.hits += 1
            return found
        self.misses += 1
        try:
            Published(self.spark, self.root, key).publish({"result": make()}, key, expected=0)
        except Conflict:
            pass  # the other writer's result has the same key, so it is the same
        return self.find(key)

    def drop(self, key: str) -> None:
        _delete(self.spark, f"{self.root}/{key}")


def working_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; one of our own only where that is unset and the master local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"/tmp/checkpoints/threadloom-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def working_path(spark: SparkSession, name: str) -> str:
    """A new folder for working tables; it goes when the application ends."""
    path = f"{working_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a working table, in folders by ``by``: made once however often it is read, its lineage cut, safe from lost executors."""
    path = working_path(df.sparkSession, name)
    df.write.mode("append").partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
