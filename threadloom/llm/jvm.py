"""Java functions of this subpackage: scalar, sequential loops over bytes, which columns and numpy cannot express.

The sources lie beside this module. Spark's own compiler of generated code (Janino) compiles them on the driver, once per
application, and the classes go to the executors as a jar, through the driver's file server.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import sys
import tempfile
import unicodedata
import zipfile
from array import array
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHITE, RankBpe, byte_letters
from .shared import ship

_SOURCES = ("MixingCoder", "WordBpe")
_FUNCTIONS = {"threadloom_encode2": "MixingCoder$Encode2", "threadloom_encode4": "MixingCoder$Encode4", "threadloom_decode": "MixingCoder$Decode", "threadloom_words": "WordBpe$Words"}


def _send(spark: SparkSession, name: str, files: dict[str, bytes]) -> None:
    jar = os.path.join(tempfile.mkdtemp(prefix="threadloom-"), name)
    with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in files.items():
            z.writestr(path, data)
    spark.sql(f"ADD JAR '{jar}'")


def register(spark: SparkSession) -> None:
    """Make the functions known to this session; null in, null out."""
    sc = spark.sparkContext
    if not hasattr(sc, "_threadloom_jars"):
        files = {}
        for name in _SOURCES:
            compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
            made = compiler.getBytecodes()
            files |= {f"{c.replace('.', '/')}.class": bytes(made[c]) for c in made}
        _send(spark, "threadloom-functions.jar", files)
        sc._threadloom_jars = {}
    loader, nothing = spark._jsparkSession.sharedState().jarClassLoader(), sc._gateway.new_array(sc._jvm.java.lang.Object, 0)
    kind = sc._jvm.org.apache.spark.sql.types.DataType.fromDDL("binary")
    for function, name in _FUNCTIONS.items():
        made = loader.loadClass(f"threadloom.{name}").getDeclaredConstructors()[0].newInstance(nothing)
        spark._jsparkSession.udf().register(function, made, kind)


@functools.cache
def characters(words: bool) -> bytes:
    """Classes (0: not plain, 1: blank, 2: letter, 3: number, 4: other) and lower-case forms of the first 65536 characters.

    For models with word ends those are plain that stay what they are under NFC whatever stands beside them, with a
    lower-case form of one character, from scripts without composing vowels or syllables; for byte-level ones all that have
    a meaning, with themselves for lower case.
    """
    blank, letter, number = (regex.compile(x) for x in (rf"[{WHITE}]", r"\p{L}", r"\p{N}"))
    scripts = [range(0x00, 0x1C), range(0x20, 0x2C0), range(0x370, 0x483), range(0x48A, 0x530), range(0x2010, 0x2028), range(0x202F, 0x2060), range(0x2070, 0x2C00), range(0x3000, 0x302A), range(0x3041, 0x3097), range(0x30A1, 0x30FB), range(0x4E00, 0xA000)]
    kinds, lower = bytearray(65536), [0] * 65536
    for c in (chr(x) for part in (scripts if words else [range(0x00, 0x1C), range(0x20, 0xD800), range(0xE000, 0x10000)]) for x in part):
        low = c.lower() if words else c
        if unicodedata.category(c) in ("Cn", "Co", "Cs"):
            continue
        if words and (unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or len(low) != 1 or ord(low) > 0xFFFF):
            continue
        kinds[ord(c)] = 1 if blank.match(c) else 2 if letter.match(low) else 3 if number.match(low) else 4
        lower[ord(c)] = ord(low)
    return bytes(kinds) + struct.pack(">65536H", *lower)


def _tables(model: RankBpe) -> bytes | None:
    """What ``WordBpe`` needs of a model with ids of 2 bytes; None for other models."""
    if model.wide:
        return None
    ids = {t: i for i, t in model.tokens.items()}
    letters = {b: c for c, b in byte_letters().items()}
    single = [ids.get(letters[b], -1) for b in range(256)]
    last = [ids.get(letters[b] + model.suffix, -1) for b in range(256)]
    if min(single) < 0 or min(last) < 0:
        return None
    merges = array("i", [x for k, r in sorted(model.rank.items(), key=lambda x: x[1]) for x in (*model.parts[k], k)])
    if sys.byteorder == "little":
        merges.byteswap()
    return struct.pack(">514i", model.words, *single, *last, len(model.rank)) + merges.tobytes() + characters(model.words)


def words(spark: SparkSession, spec: bytes) -> tuple[str | None, int]:
    """The resource of a tokenizer file for ``threadloom_words`` (None if it has ids of 4 bytes), and the bytes of its ids.

    The file is taken apart once per application, by a worker, so that the driver holds nothing but the result (1 MB).
    """
    register(spark)
    known = spark.sparkContext._threadloom_jars
    key = hashlib.sha256(spec).hexdigest()[:16]
    if key not in known:
        ship(spark)
        sent = spark.sparkContext.broadcast(spec)

        def run(batches):
            model = RankBpe(sent.value)
            yield pa.RecordBatch.from_arrays([pa.array([_tables(model)], pa.binary()), pa.array([4 if model.wide else 2], pa.int32())], ["tables", "width"])

        made = spark.range(1, numPartitions=1).mapInArrow(run, "tables binary, width int").first()
        name = f"threadloom/words-{key}.bin" if made.tables else None
        if name:
            _send(spark, f"words-{key}.jar", {name: bytes(made.tables)})  # jars go by their names
        known[key] = name, made.width
    return known[key]


def encoded(rows: DataFrame, spec: bytes, text: str = "text") -> tuple[DataFrame, int]:
    """``rows`` with ``ids binary`` (little-endian) of the texts that the JVM can encode, whose ``text`` is then null, and the
    bytes of an id; the other rows keep their text. ``rows`` must not have a column ``ids``."""
    known, width = words(rows.sparkSession, spec)
    made = rows.withColumn("ids", F.expr(f"threadloom_words(cast(`{text}` AS binary), '{known}')") if known else F.lit(None).cast("binary"))
    return made.withColumn(text, F.when(F.col("ids").isNull(), F.col(text))), width
