"""Tables between steps, and joins and scans that stay even; shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  A temporary folder is made
    only where that is unset and the session runs in one JVM, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="leafmill-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOT[0], True)
    return _LOCAL_ROOT[0]


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.  The table
    goes when it is released, or else with the session.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out), path)
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for t in tables:
        ref, path = _WRITTEN.pop(id(t), (None, ""))
        if ref is not None and ref() is t:
            where, fs = _place(t.sparkSession, path)
            fs.delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is read from fewer files than there are cores and is small for them.

    A file of one row group is one task, however slow its rows are to work on.  Tables of
    more than a scan's usual share a core (``spark.sql.files.maxPartitionBytes``) stay as
    they are: there a shuffle of all bytes would cost more than it gives.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.isStreaming or cores < 2:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    share = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return df.repartition(4 * cores) if size < share * cores and 0 < len(df.inputFiles()) < cores else df


def join_salted(rows: DataFrame, side: DataFrame, on: list[str], count: str | None, n: int, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which holds each key once and in ``count`` about how many of the ``n`` rows have it.

    The rows of a hot key are dealt to several tasks by a hash of their columns ``by``, and
    the key's row of ``side`` goes to each of these.  Only the hot keys, at most eight a
    partition, are broadcast, each with its number of tasks.  ``count`` doesn't come out;
    without one the rows are counted here.
    """
    least = n // (8 * partitions(rows.sparkSession)) + 1
    if count is None:
        counted, count = rows.groupBy(*on).agg(F.count("*").alias("_count")), "_count"
    else:
        counted = side
    hot = F.broadcast(counted.filter(F.col(count) > least).select(*on, F.ceil(F.col(count) / least).cast("int").alias("_tasks")))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_tasks")).cast("int"), F.lit(0)))
    each = side.drop(count).join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)))
    return dealt.drop("_tasks").join(each.drop("_tasks"), [*on, "_salt"], how).drop("_salt")


#: Rows that a Python step holds at a time; Arrow hands over up to 10,000.
ROWS = 256


def sliced(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` over small pieces of the batches, so that a worker's memory follows some rows, not a batch."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        yield from run(pieces)

    return small
