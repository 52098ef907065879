"""A Spark data source for JSON exports: files are streamed, so one may be larger than a worker's memory.

After :func:`register`, ``spark.read.format("chat_exports").load(folder)``, with options ``names`` (a JSON array: parts of file names,
case aside) and ``limit`` (the first files by name). Filters on conv_id, which is the file's name without its suffix, leave
files unread. Small files share a partition, a large one has its own.

A file is read three times: for its head, since what makes a file a group may stand behind the messages; to check every
message, since a bad file gives one row with ``error`` and no message; and to give its rows. A message at a time is in
memory, and 8 bytes for each id of the canonical protocol.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..functions.ship import ship
from .exports import ROW, Bad, Canonical, _need, rules

CHUNK = 1 << 20
#: Bytes of small files that share a partition.
TOGETHER = 64 << 20
BATCH = 5000
#: Characters of one value (a message) beyond which a file is given up.
VALUE = 256 << 20
_BLANK = re.compile(r"[ \t\r\n]*")
_FIELDS = ["type", "content", "is_send", "time_str", "create_time", "source_message_id"]
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]


def store(path: str):
    """The Arrow file system and inner path of a path; a path without scheme is local."""
    from pyarrow import fs

    if re.match(r"(file:)?/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def reached(path: str) -> bool:
    """Whether Arrow reaches the store of a path; other stores are left to Spark's own readers."""
    return re.match(r"(file:)?/|(hdfs|s3|s3a|s3n|gs|abfs|abfss)://", path) is not None


def opened(path: str):
    """A file's bytes as a stream."""
    where, inner = store(path)
    return where.open_input_stream(inner, compression=None)


class Tokens:
    """JSON values one after another from a stream of UTF-8; what has been taken is let go."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.text, self.at, self.done = stream, chunk, "", 0, False
        self.decoder, self.values = codecs.getincrementaldecoder("utf-8-sig")(), json.JSONDecoder()

    def more(self) -> bool:
        if self.done:
            return False
        data = self.stream.read(max(self.chunk, len(self.text) - self.at))  # doubles for a value that goes on and on
        self.done = not data
        try:
            self.text = self.text[self.at :] + self.decoder.decode(data, final=self.done)
        except UnicodeDecodeError as e:
            raise Bad(f"not UTF-8: {e.reason}") from None
        self.at = 0
        return True

    def peek(self) -> str:
        """The next character that is no blank; empty at the end."""
        while True:
            self.at = _BLANK.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, which: str) -> str:
        c = self.peek()
        if not c or c not in which:
            raise Bad(f"expected one of {which} at a {c or 'file end'}")
        self.at += 1
        return c

    def value(self):
        self.peek()
        while True:
            try:
                value, end = self.values.raw_decode(self.text, self.at)
            except json.JSONDecodeError as e:
                # What breaks off at the end of the text may go on in the next chunk; what is wrong before it is wrong.
                cut = e.pos > len(self.text) - 16 or e.msg.startswith("Unterminated")
                if not cut or len(self.text) - self.at > VALUE or not self.more():
                    raise Bad(f"no JSON: {e.msg}") from None
                continue
            if end < len(self.text) or self.done or self.text[end - 1] in '}]"':
                self.at = end
                return value
            self.more()  # a number may go on in the next chunk

    def items(self) -> Iterator:
        """The elements of an array."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.take(",]") == "]":
                return


def walk(path, messages: bool, chunk: int = CHUNK) -> Iterator[tuple[str, object]]:
    """(key, value) of a file's object; ``messages`` value by value, or passed over and given as their number.

    ``path``: a path, or what opens the stream.
    """
    with path() if callable(path) else opened(path) as stream:
        t = Tokens(stream, chunk)
        if t.peek() != "{":
            t.value()
            raise Bad("not a JSON object")
        t.take("{")
        seen = set()
        if t.peek() == "}":
            t.at += 1
        else:
            while True:
                key = t.value()
                _need(isinstance(key, str), "a key must be text")
                t.take(":")
                if key == "messages" and t.peek() == "[":
                    _need(key not in seen, "messages is repeated")
                    n = 0
                    for n, m in enumerate(t.items(), 1):
                        if messages:
                            yield key, m
                    if not messages:
                        yield key, n
                else:
                    value = t.value()
                    if not messages:
                        yield key, 0 if key == "messages" else value
                seen.add(key)
                if t.take(",}") == "}":
                    break
        _need(not t.peek(), "more than one JSON value")


def checked(path, chunk: int = CHUNK) -> dict:
    """The head of a file all of whose messages keep the rules; else ``Bad``."""
    head = dict(walk(path, False, chunk))
    n = head.pop("messages", 0)
    rule = rules(head)
    _need(n, "messages must be a list of objects, not empty")
    ids = array("q")
    for _, m in walk(path, True, chunk):
        row = rule.row(m)
        if isinstance(rule, Canonical):
            ids.append(hash(row["source_message_id"]))
    twice = {h for h, k in _runs(ids) if k > 1}
    if twice:  # of equal hash; whether the ids are equal is looked up
        again = Counter(m["id"] for _, m in walk(path, True, chunk) if hash(m["id"]) in twice)
        _need(max(again.values()) == 1, "a message id is repeated")
    return head


def _runs(ids: array) -> Iterator[tuple[int, int]]:
    import numpy as np

    values, counts = np.unique(np.frombuffer(ids, np.int64), return_counts=True) if len(ids) else ([], [])
    return ((int(v), int(c)) for v, c in zip(values, counts, strict=True) if c > 1)


def batches(path, name: str, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of one file, or one row that tells what is wrong with it."""

    def made(rows: list[dict], first: int, error: str | None) -> pa.RecordBatch:
        n = len(rows)
        cols = [pa.array([r[k] for r in rows], t) for k, t in zip(_FIELDS, _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(first, first + n), pa.int32()), *cols, pa.array([error] * n, pa.string())], ["conv_id", "original_index", *_FIELDS, "error"])

    try:
        rule = rules(checked(path, chunk))
    except ValueError as e:
        yield made([dict.fromkeys(_FIELDS)], 0, str(e))
        return
    rows, first = [], 0
    for _, m in walk(path, True, chunk):
        rows.append(rule.row(m))
        if len(rows) == BATCH:
            yield made(rows, first, None)
            first, rows = first + BATCH, []
    if rows:
        yield made(rows, first, None)


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])


def chosen(found: list[tuple[str, int]], names: list[str] | None, limit: int | None) -> list[tuple[str, int]]:
    """Exports among (path, size), by name; of those whose name holds one of ``names`` the first ``limit``."""
    found = sorted(f for f in found if f[0].lower().endswith((".json", ".md")))
    if names:
        found = [f for f in found if any(n.lower() in stem(f[0]).lower() for n in names)]
    return found if limit is None else found[:limit]


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files in a folder, or of one file, in any store that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [(x.getPath().toString(), x.getLen()) for x in status if x.isFile()]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Exports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_exports"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        if "files" in self.options:
            return Reader([tuple(f) for f in json.loads(self.options["files"])])
        from pyarrow import fs

        where, inner = store(self.options["path"])  # this runs beside the driver, without a session
        there = where.get_file_info(fs.FileSelector(inner)) if where.get_file_info(inner).type == fs.FileType.Directory else [where.get_file_info(inner)]
        head = self.options["path"].partition("://")[0] + "://" if "://" in self.options["path"] else ""
        limit = self.options.get("limit")
        found = chosen([(head + x.path, x.size) for x in there if x.is_file], json.loads(self.options.get("names", "null")), None if limit is None else int(limit))
        return Reader([f for f in found if f[0].lower().endswith(".json")])


def register(spark: SparkSession) -> None:
    """Make ``chat_exports`` known to a session, and let Spark push filters into Python data sources, which is off by default."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Exports)


class Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        """Files that a filter on conv_id rules out are not opened; other filters stay with Spark."""
        tests = {EqualTo: lambda s, v: s == v, In: lambda s, v: s in v, StringContains: lambda s, v: v in s, StringStartsWith: str.startswith, StringEndsWith: str.endswith}
        for f in filters:
            test = tests.get(type(f)) if getattr(f, "attribute", None) == ("conv_id",) else None
            if test is None:
                yield f
            else:
                self.files = [x for x in self.files if test(stem(x[0]), f.value)]

    def partitions(self):
        out, some, size = [], [], 0
        for path, n in self.files:
            if some and size + n > TOGETHER:
                out.append(Files(some))
                some, size = [], 0
            some.append(path)
            size += n
        return [*out, Files(some)] if some else out or [Files([])]

    def read(self, partition):
        for path in partition.paths:
            yield from batches(path, stem(path))
