"""Shared folder, keys and small helpers of the text operators.

Rows of documents are told apart by their id and a 64-bit hash of their text,
so an id may be null or occur on several rows; rows equal in both get equal results.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

ID, TAG, TEXT = "_id", "_tag", "_text"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset in a local session, as in tests, a folder in the warehouse is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
            folder = context.getCheckpointDir()
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage.

    The table outlives any executor; it goes when the driver ends or forget() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._kept_at = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of keep() that no later result reads, and let Spark drop the shuffle files of written queries.

    Spark's cleaner works when the driver collects garbage; written tables stand in for those
    shuffles, so nothing has to be computed again.
    """
    for df in tables:
        for entry in [e for e in _made if e[1] == getattr(df, "_kept_at", None)]:
            _made.remove(entry)
            _delete(*entry)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Records the tables that keep() writes in a with-block, so that drop() can delete them
    once what was made from them is written."""

    def __enter__(self) -> Tables:
        self.before = {path for _, path in _made}
        self.entries: list[tuple[SparkSession, str]] = []
        return self

    def __exit__(self, *_: object) -> None:
        self.entries = [e for e in _made if e[1] not in self.before]

    def read_by(self, df: DataFrame) -> bool:
        """Whether df is still to be computed from one of the tables."""
        files = df.inputFiles()
        return any(path.removeprefix("file:") in f for f in files for _, path in self.entries)

    def drop(self) -> None:
        for entry in self.entries:
            if entry in _made:
                _made.remove(entry)
                _delete(*entry)
        for spark in {e[0] for e in self.entries}:
            release(spark)


@atexit.register
def forget() -> None:
    """Delete the tables that keep() has written."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # noqa: BLE001  the session may have ended already
            return


#: rows in an Arrow batch of texts, at most: texts of some kilobytes make a few megabytes
BATCH_ROWS = 1024


def modest_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, so that a worker holds a few megabytes of texts; send the code."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_clearers: dict[str, Callable[[], object]] = {}


def cache(name: str, clear: Callable[[], object]) -> None:
    """Register what a worker holds between tasks, so that tasks that do not use it can drop it."""
    _clearers[name] = clear


def _give_back() -> None:
    """Return freed memory to the system: workers live as long as the application."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable, uses: str = "") -> Callable:
    """run for mapInArrow, in a worker that holds no other operator's tables before and no freed memory after."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, clear in _registered():
            if name != uses:
                clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return lean_run


def _registered() -> list[tuple[str, Callable[[], object]]]:
    return list(_clearers.items())


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _tag, _text): null texts as empty ones, all other columns left out."""
    modest_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias(ID), F.xxhash64(text).alias(TAG), text.alias(TEXT))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a[ID].eqNullSafe(b[ID]) & (a[TAG] == b[TAG])


def packed(docs: DataFrame) -> DataFrame:
    """keyed() rows with the text as zstd bytes and its length, for a shuffle."""
    kind = docs.schema[ID].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            raw = [x.as_py() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([pack(x) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int32())],
                names=[ID, TAG, "_z", "_size"],
            )

    return docs.mapInArrow(lean(run), f"{ID} {kind}, {TAG} long, _z binary, _size int")


@functools.cache
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def pack(raw: bytes) -> bytes:
    return _codec().compress(raw, asbytes=True)


def unpack(z: bytes, size: int) -> bytes:
    return _codec().decompress(z, decompressed_size=size, asbytes=True) if size else b""


def rows_of(batch: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch[f.name], type=f.type) for f in schema], schema=schema)
