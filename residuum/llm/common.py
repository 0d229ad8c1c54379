"""What the operators of this subpackage share: words, durable intermediate tables, distributed running totals."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, \t, \n, \v, \f, \r (the regex and the characters say the same).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: The temporary folder of this process, once one is needed.
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for cut lineage (``spark.checkpoint.dir``); where none is set, a temporary one, but on local masters alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="residuum-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = f"file://{_own[0]}"
    return folder.rstrip("/")


#: Folders that this process has made under the shared one and not discarded.
_made: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_folder(spark)}/residuum-{what}-{uuid.uuid4().hex}")
    return _made[-1]


def stash(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later passes neither recompute it nor depend on an executor."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing will read any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _made:
            _made.remove(path)


@contextmanager
def discarding(spark: SparkSession, keep: str) -> Iterator[None]:
    """Discards, at its end, every folder made within but ``keep``, which has been written by then."""
    before = set(_made)
    yield
    discard(spark, *[p for p in _made if p not in before and p != keep])


def slices(batch: pa.RecordBatch, column: int, most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and about so many bytes of a text column; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        read = int(sizes[a - 1]) if a else 0
        b = min(a + most_rows, max(a + 1, int(np.searchsorted(sizes, read + most_bytes, "right"))))
        yield batch.slice(a, b - a)
        a = b


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one, memory that the task's Python process has freed goes back to the system, as the process waits for other tasks meanwhile."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row: a lambda variable is bound, where a repeated column may be inlined."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, block: int = 64, levels: int = 3) -> Column:
    """Inclusive running sums of an array of longs.

    A fold that appends copies its array at each step, so it is kept to blocks, whose totals are summed in the same way: the
    work is in proportion to the array up to some millions of values.
    """

    def fold(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))

        return F.aggregate(a, start, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        last = lambda x: F.element_at(x, -1)
        upto = running_sums(F.transform(blocks, last), block, levels - 1)
        return F.flatten(F.zip_with(blocks, upto, lambda x, t: F.transform(x, lambda v: v + t - last(x))))

    def cut(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.ceil(F.size(a) / block).cast("int") - 1)
        return let(F.transform(at, lambda b: fold(F.slice(a, b * block + 1, F.lit(block)))), joined)

    return fold(values) if levels == 1 else let(values, lambda a: F.when(F.size(a) <= block, fold(a)).otherwise(cut(a)))


def running_total(df: DataFrame, keys: list[Column | str], value: str, out: str, what: str) -> DataFrame:
    """``df`` with ``out``: the inclusive sum of ``value`` over all rows in the order of ``keys``.

    Rows are range-partitioned on the keys, each range is summed, and the sums of the earlier ranges
    (one row a partition, so a broadcast of bounded size) are added to the running sum within the range:
    no task holds more than one range. Keys must order rows up to interchangeable ties.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    ranges = stash(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), what)
    sums = ranges.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return ranges.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.sum(value).over(within)).drop("__part", "__before")
