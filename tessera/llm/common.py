"""Helpers shared by the text operators: scratch tables, folds, skew-safe joins."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words, as in the contracts of the queries.
SPACES = "\\x20\\x09-\\x0D"
WORD = re.compile("[^ \t\n\x0b\x0c\r]+")

#: At most this many keys can each hold more than 1/HOT_PARTS of all rows.
HOT_PARTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder and
    a cluster gets an error, since executors could not see such a folder.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    The shuffle files of the write go when it is done, as the table stands for them.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables made by ``written`` which no later step reads."""
    for t in tables:
        path = getattr(t, "_tessera_scratch", None)
        if path:
            jvm, jsc = t.sparkSession._jvm, t.sparkSession._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def path_text(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """A small file's text, None if there is no such file; with ``text`` writes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is None and not fs.exists(where):
        return None
    stream = fs.open(where) if text is None else fs.create(where, True)
    try:
        return bytes(stream.readAllBytes()).decode() if text is None else stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep an Arrow batch of long documents within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(parts)


def hash_share(key: Column | str) -> Column:
    """A number from 0 to 1 by a hash of the key, in steps of 2^-53: less than x for a share x of the keys, however small."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 53)) / F.lit(2.0**53)


#: A task gives memory back so many seconds apart, and when it ends.
GIVE_BACK_S = 1.0


def give_back() -> None:
    """Return to the system what a Python worker's allocators keep unused: workers outlive their tasks, and idle ones stand beside the busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list] | None], schema: str | T.StructType, state: Callable[[], Callable] | None = None) -> DataFrame:
    """``mapInArrow`` over columns as Python lists.  ``state`` builds ``f`` once per task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    out = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, due = state() if state else f, time.monotonic() + GIVE_BACK_S
        for b in batches:
            got = each({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)
            if time.monotonic() > due:
                b = got = None
                give_back()
                due = time.monotonic() + GIVE_BACK_S
        end = getattr(each, "finish", None)
        if end:
            for got in end():
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)
        b = got = each = end = None
        give_back()

    return df.mapInArrow(run, schema)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """Join rows to a table with one row per ``key``; ``size`` is the group's row count.

    Keys that hold more than 1/HOT_PARTS of all rows number at most HOT_PARTS,
    so those rows of ``groups`` are broadcast and their members stay where
    they are; all other keys are small enough for one task of a sort-merge join.
    ``groups`` should be a written table, as it is read more than once.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    floor = max(total // HOT_PARTS, 1)
    hot = groups.where(F.col(size) > floor)
    keys = F.broadcast(hot.select(F.col(key).alias("__hot_key")))
    warm = rows.join(keys, F.col(key) == F.col("__hot_key"), "left_semi").join(F.broadcast(hot), key, how)
    cold = rows.join(keys, F.col(key) == F.col("__hot_key"), "left_anti").join(groups.where(F.col(size) <= floor), key, how)
    return cold.unionByName(warm)


def split_join(rows: DataFrame, key: str, hot: DataFrame, values: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """Rows joined to ``values`` by ``key``: those of a ``hot`` key to the ``few`` values of hot keys, where they are.

    ``hot`` and ``few`` hold at most HOT_PARTS keys and are broadcast.
    """
    return rows.join(hot, key, "left_anti").join(values, key, how).unionByName(rows.join(hot, key, "left_semi").join(few, key, how))


#: Filters made by ``bitmap`` have two to the power of one of these bits: at least, and at most (32 MB).
FILTER_BITS, MOST_FILTER_BITS = 24, 28


def bitmap(keys: DataFrame, key: str):
    """A bitmap of all binary ``key`` values by their first 32 bits: 16 bits for each of the ``keys``, up to a size that is proven.

    Spark puts its words together in at most 2^(MOST_FILTER_BITS - 5) rows.  A key
    may be in it by mistake but is never missed, so whoever uses it must do
    with too much and gets the same result.  ``keys`` should be a written table.
    """
    import numpy as np

    size = 1 << min(MOST_FILTER_BITS, max(FILTER_BITS, (16 * keys.count()).bit_length()))
    place = F.conv(F.substring(F.hex(key), 1, 8), 16, 10).cast("long") % size
    placed = keys.select(place.alias("place")).selectExpr("place div 32 AS at", "shiftleft(1L, CAST(place % 32 AS INT)) AS bit")
    rows = placed.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 32, dtype=np.uint32)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return bits


def in_bitmap(bits, key: bytes) -> bool:
    place = int.from_bytes(key[:4], "big") % (32 * len(bits))
    return bool(bits[place >> 5] >> (place & 31) & 1)
