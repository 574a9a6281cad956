"""What the corpus operators share: tables, staged intermediates, word rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, the word separator of every operator: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch.
BATCH = 2 << 20
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none, as in tests, a local one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        found = tempfile.mkdtemp(prefix="gapweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and reads it back.

    This cuts the lineage: what follows reads files that survive a lost
    executor, and a plan used twice is computed once. While it is written, Arrow
    batches are BATCH bytes: a batch is held by the JVM and by a worker at once.
    """
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}/{name}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before_ = conf.get(key)
    conf.set(key, str(BATCH))
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before_)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes the files of staged tables that no later plan reads."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tasks_for(df: DataFrame, each: int = 16 << 20) -> int:
    """Tasks for an exchange of `df`: the session's number, or more if the bytes of the files it reads ask for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # what isn't read from files claims to be endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known // each, 200_000))


def read_from_files(df: DataFrame) -> DataFrame:
    """`df` if each of its rows is a row of a file; a plan that is more than a scan with projections and filters is staged."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return df if plan.nodeName() == "LogicalRelation" and plan.metadataOutput().size() else stage(df, "rows")


def addressed(df: DataFrame) -> DataFrame:
    """Rows (_row, _file, _place): each row as a struct, and where it stands in the files that hold it."""
    df = read_from_files(df)
    at = df.metadataColumn("_metadata")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.select(row, F.xxhash64(at["file_path"]).alias("_file"), at["row_index"].alias("_place"))


def lean() -> None:
    """Called first in a Python task: lets freed memory, its own and the last task's, go back to the system.

    Without it a reused worker keeps what its largest task once held, beside an executor's heap.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc: large blocks apart, so they are returned when freed
        libc.mallopt(-3, 1 << 20)
        libc.mallopt(-1, 1 << 20)
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, size: int = 1 << 20):
    """Slices of a batch, whose last column is a text, of about `size` bytes of it."""
    text = batch.num_columns - 1
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(text: Column) -> Column:
    """The words of a text, maximal runs of non-space characters; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before(a: Column, op=lambda s, x: s + x, zero: Column | None = None, levels: int = 3, chunk: int = 16) -> Column:
    """For each element of an array of longs what `op` makes of those before it, `zero` for the first.

    Chunks are folded first, and the folds of the chunks before each are found in the same way, so the work is about
    `chunk` / 2 steps an element; plain slices would take half the array for each.
    """
    zero = F.lit(0).cast("long") if zero is None else zero
    fold = lambda x, start: F.aggregate(x, start, op)
    upto = lambda x, start: F.transform(x, lambda _, i: fold(F.slice(x, F.lit(1), i), start))
    if not levels:
        return upto(a, zero)

    def by_chunks(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
        chunks = F.transform(starts, lambda s: F.slice(v, s, chunk))
        return bound(chunks, lambda c: bound(before(F.transform(c, lambda x: fold(x, zero)), op, zero, levels - 1, chunk), lambda t: F.flatten(F.zip_with(c, t, upto))))

    return bound(a, by_chunks)


#: Rows of a table that may be broadcast.
FEW = 2_000_000


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A staged table as the small side of a join: broadcast up to FEW rows, counted first; beyond, both sides are shuffled."""
    return F.broadcast(df) if df.count() <= (FEW if rows is None else rows) else df.hint("shuffle_merge")


def paired(a: Column, step: int, size: Column, f) -> Column:
    """f(a[i], a[i + step]) for every i below size - step; empty if there is none."""
    n = F.greatest(size - F.lit(step), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), f)


def total(a: Column) -> Column:
    """The sum of an array of integers, 0 if empty."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
