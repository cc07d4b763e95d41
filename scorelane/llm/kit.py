"""What the operators share: shared tables, text as byte arrays, hashing of words.

Text columns reach Python as Arrow batches; the kernels here work on the UTF-8
bytes of a whole chunk of documents at once, so no word becomes a Python object.
A null text is an empty text everywhere.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
DEFAULT_SHARED = "file:///tmp/checkpoints/scorelane"
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, whatever their search path is; once a session."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()  # the driver serves the archive from there as long as it lives
        atexit.register(shutil.rmtree, folder, True)
        shutil.copytree(package, f"{folder}/top/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}_{context.applicationId}", "zip", f"{folder}/top"))
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a local one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named.rstrip("/") if named else DEFAULT_SHARED


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scorelane-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the table stands for the exchanges that made it; their files go
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append((spark, path.rpartition("/")[0]))
    trim(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path.rpartition("/")[0]
    return back


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of its own for each row, whatever the ids in it are.

    Rows of a table of files have their file's place among its files and theirs in it; nothing
    is copied. Other frames may give other rows when they are run again: they are stored.
    """
    plain = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not plain or unused(df, "_metadata") != "_metadata":
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    path, file, place = (unused(df, x) for x in ("_path", "_file", "_place"))
    names = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
    files = df.sparkSession.createDataFrame(list(enumerate(names)), f"`{file}` long, `{path}` string")
    whole = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    row = F.shiftleft(file, 40) + F.col(place)
    return whole.join(F.broadcast(files), path).select(*[F.col(f"`{c}`") for c in df.columns], row.alias(name))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(spark: SparkSession) -> None:
    """Lets go of what earlier jobs left with the driver: plans, broadcasts, files of exchanges."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Gives back to the system what the driver's compiler and native code have freed; else it stays with the process.

    A driver whose Java has no command for that keeps it.
    """
    context = spark.sparkContext
    jvm, array = context._jvm, context._gateway.new_array
    try:
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is not open
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return


def release(*frames: DataFrame) -> None:
    """Removes tables of stored() that nothing reads any more: all that came of them is stored itself."""
    for df in frames:
        entry = (df.sparkSession, df._stored_at)
        if entry in _written:
            _written.remove(entry)
            _remove(*entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored() -> None:
    """Removes every table that stored() has written; frames over them end."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return


atexit.register(drop_stored)


def blocks_for(total: int, each: int, least: int, spark: SparkSession) -> int:
    """How many blocks hold total items at about `each` a block; at least the session's shuffle width."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo: the folds of the contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


# --- text as bytes -----------------------------------------------------------------

#: White space of the word patterns.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
#: Bytes of words made of a-z, 0-9 and everything beyond ASCII.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[0x30:0x3A] = IS_ALNUM[0x61:0x7B] = IS_ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about `most` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of member bytes; none crosses a document's end."""
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SYMBOLS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (finaliser of a public hash)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from prefix sums of a random polynomial: equal spans, equal hashes."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * power[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def hash_of(word: str) -> int:
    """span_hashes() of one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def strings(values: list, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(values, kind or pa.string())
