"""What the operators share: scratch tables in the shared folder, columns by stable names, blobs of arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() without arguments splits at the same bytes.
BLANK = " \t\n\x0b\x0c\r"

#: Where scratch tables lie in local files, no check sums beside them: each would cost a process to set its permissions.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Bytes of an Arrow batch beyond which no more rows join it.
BATCH_BYTES = 8 << 20

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_structura_dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="structura-")
            spark.sparkContext._structura_dir = base
    return base.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python workers so many rows at a time: texts are long, and default batches of 10,000 fill an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(stage: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow stage whose worker hands freed memory back when a task ends. Workers are kept, and so would be their peaks."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from stage(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def drawn_part() -> int:
    """A number for the rows of one call of an Arrow stage. A task's own number won't do: after coalesce() it runs several partitions."""
    return uuid.uuid4().int >> 65


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fewer_files(df: DataFrame) -> DataFrame:
    """df in as many tasks as there are cores, or one for sixteen shuffle partitions where those are more.

    Thousands of small files cost more than the rows in them, and for every file in a local folder an executor starts a
    process that sets its permissions. A task reads its partitions one after another, so its memory is that of one.
    """
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 16))


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive executors and go when the session ends or on drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        _left.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write a table and read it again; the shuffle files that it took are removed once it is there.

        It has as many files as fewer_files leaves at most.
        """
        df = fewer_files(df)
        self.at[name] = path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.options(**_PLAIN_FILES, compression=codec).parquet(path)
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.at:
                remove(self.spark, self.at.pop(name))


@atexit.register
def _sweep() -> None:
    for spark, root in _left:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, root)
        except Exception:  # noqa: BLE001  the session has ended
            pass


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, under fixed names; a null text counts as empty. Other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def byte_views(column) -> list[memoryview]:
    """Each value of an Arrow string or binary array as a view of its bytes, without copies. Nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return []
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(ends, ends[1:])]


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All values' bytes as one array, and the n + 1 bounds of the values in it."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def crc_mod(id_col: str, parts: int):
    """crc32 of the identifier as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(parts)
