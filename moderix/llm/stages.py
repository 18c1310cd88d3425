"""Tables written between steps, fixed-size sketches, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session; only where
    that is unset in local mode (tests) a folder of our own. On a cluster it must be set."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors would not see the driver's folder")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="moderix-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later steps read the files, so a lost executor costs
    at most the tasks that it was running. Tables that ``dropped`` has not removed go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _left:
        atexit.register(_swept, spark)
    out = spark.read.schema(df.schema).parquet(path)
    _left[path] = weakref.ref(out)
    return out


#: Tables in the shared folder that are there yet.
_left: dict[str, weakref.ref] = {}


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    _left.pop(path, None)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` has made; nothing may read them any more."""
    for df in tables:
        for path in [p for p, table in _left.items() if table() is df]:
            _remove(df.sparkSession, path)


def _swept(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        for path in list(_left):
            _remove(spark, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size, for numbers of parts that follow the input; results never depend on it. Where Spark
    knows nothing (its estimate is then beyond a zettabyte), 0."""
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return 0 if size >> 60 else size


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, if it can give free memory back."""
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function, after which its worker gives free memory back: workers live on, and an executor may keep more of them than it
    has cores."""

    def tidy(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (libc := _libc()) is not None:
            libc.malloc_trim(0)

    return tidy


def zipped(text: Column) -> Column:
    """A text compressed, for shuffles: better than the shuffle does it, row by row. Null stays null."""

    def one(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else zlib.compress(x, 1) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())

    @F.arrow_udf("binary")
    def zip_text(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(lambda xs: map(one, xs))(texts)

    return zip_text(text)


def unzipped(blob: Column) -> Column:
    @F.arrow_udf("string")
    def unzip_text(blobs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(lambda xs: map(texts_of, xs))(blobs)

    return unzip_text(blob)


def texts_of(blobs: pa.Array) -> pa.Array:
    """The texts that ``zipped`` compressed."""
    return pa.array([None if x is None else zlib.decompress(x) for x in blobs.to_pylist()], pa.binary()).cast(pa.string())


CHUNKS = 64


def table_sum(df: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], size: int, how: str = "add") -> np.ndarray:
    """Fill a fixed-size table of 32-bit counters in each task and combine the tables, streamed by chunk, in 64 bits.

    The result, ``8 * size`` bytes however many rows there are, is the only thing that reaches the driver. A part travels
    in the narrowest type that holds it.
    """
    per, op = size // CHUNKS, getattr(np, how)

    def narrow(part: np.ndarray) -> bytes:
        width = next(k for k in (1, 2, 4, 8) if not int(part.max()) >> 8 * k)
        return bytes([width]) + part.astype(f"<u{width}").tobytes()

    def wide(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.uint64)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_row = np.zeros(size, np.uint32), False
        for b in batches:
            if b.num_rows:
                any_row = True
                fill(b, own)
        for k in range(CHUNKS if any_row else 0):
            part = own[k * per : (k + 1) * per]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([narrow(part)], pa.binary())], ["chunk", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = wide(part)
                got[k] = part if k not in got else op(got[k], part)
        for k, v in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([narrow(v)], pa.binary())], ["chunk", "part"])

    parts = df.mapInArrow(tidied(local), "chunk int, part binary").repartition(min(CHUNKS, parallelism(df.sparkSession)), "chunk").mapInArrow(merge, "chunk int, part binary").collect()
    out = np.zeros(size, np.uint64)
    for k, part in parts:
        out[k * per : (k + 1) * per] = wide(part)
    return out


MEMBERS = 1 << 23


def member_bits(ids: DataFrame) -> np.ndarray:
    """A fixed-size (1 MB) bit table of the hashes of a long column; membership may only err towards true."""

    def fill(b: pa.RecordBatch, own: np.ndarray) -> None:
        h = id_hash(b.column(0).to_numpy(zero_copy_only=False))
        np.bitwise_or.at(own, h >> 5, np.uint32(1) << (h & 31).astype(np.uint32))

    return table_sum(ids, fill, MEMBERS // 32, "bitwise_or").astype(np.uint32)


def id_hash(ids: np.ndarray) -> np.ndarray:
    from moderix.llm.textvec import mix

    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(41)).astype(np.int64)


def only_members(df: DataFrame, id_col: str, bits: np.ndarray, may: bool = True) -> DataFrame:
    """Rows whose id may be a member, or (may = False) all others, those without an id among them: decided on the id alone, so that other columns stay in the JVM."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def member(ids: pa.Array) -> pa.Array:
        h = id_hash(ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(((held.value[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1) & ids.is_valid().to_numpy(zero_copy_only=False))

    said = member(F.col(f"`{id_col}`").cast("long"))
    return df.filter(said if may else ~said)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges: component is the smallest node reachable.

    Alternating large-star and small-star steps over (a, b) rows; each round is a written table, no edge or label
    is gathered anywhere, and a hub's edges are joined as rows, which AQE can split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e, before = written(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("u", "v").alias("u"), "v", "m")
        pairs = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, written(pairs, "edges")
        dropped(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
