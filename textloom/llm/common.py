"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, here and in every contract of this folder.
WS = "\t\n\x0b\x0c\r "
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: Spark removes the shuffle files of a write when it ends, if this is set; else when the
#: driver happens to collect its garbage, which may be after many more shuffles.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Documents, their bytes, and rows of a few numbers that make a file of a written table.
DOCS, BYTES, ROWS = 2_000, 8 << 20, 250_000

#: Materialized tables by path, in the order of their making.
_tables: dict[str, DataFrame] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus))


def is_remainder(col: str, modulus: int, value: int) -> Column:
    """Whether the remainder is `value`; a null id counts as not held out."""
    return F.coalesce(remainder(col, modulus) == value, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], train: Column | None, rows: int) -> DataFrame:
    """h (hash of the id), `columns` and y of the labelled documents for which `train` (a
    column over doc_id) holds: the `rows` with the least hash. Rows with equal id, columns
    and label count once. The bound is on rows after the join, so an id with many rows or
    labels cannot pass it; only ids and hashes are sorted for it."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(train) if train is not None else known
    first = known.distinct().withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(rows)
    joined = docs.select("doc_id", *columns).join(F.broadcast(first), "doc_id").withColumn("t", F.xxhash64(*columns))  # at most `rows` ids
    keys = joined.select("h", "t", "y").distinct().orderBy("h", "t", "y").limit(rows)
    return joined.join(F.broadcast(keys), ["h", "t", "y"], "left_semi").select("h", *columns, "y").dropDuplicates(["h", "y", *columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="textloom-")  # one machine
    spark.sparkContext.setCheckpointDir(own)
    return own


def merged(df: DataFrame, rows: int = 0, docs: DataFrame | None = None) -> DataFrame:
    """`df` with its last partitions put together where there are more than cores and than
    one for ROWS of about `rows` rows, or for DOCS or BYTES of `docs`. On a local disk Hadoop
    starts processes for every file that a task writes, so very small files cost more than
    their rows. Spark's estimate of bytes is that of the files; where it is too high, as
    for joins, partitions stay apart."""
    parts = [df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)]
    if docs is not None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        parts += [-(-docs.count() // DOCS), min(size // BYTES, 1 << 20)]
    return df.coalesce(max(parts))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: cuts lineage and
    survives the loss of an executor. Its shuffle files go when it is written; tables are
    removed when they are released, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[path] = out
    return out


def release(*tables: DataFrame) -> None:
    """Remove materialized tables that no later plan reads."""
    for path in [p for p, t in _tables.items() if any(t is x for x in tables)]:
        _remove(path)


@contextlib.contextmanager
def scratch():
    """Tables that were made inside are removed at the end but for the last one made,
    which holds the result."""
    before = set(_tables)
    yield
    for path in [p for p in _tables if p not in before][:-1]:
        _remove(path)


def _remove(path: str) -> None:
    spark = _tables.pop(path).sparkSession
    with contextlib.suppress(Exception):
        jvm, sc = spark._jvm, spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_tables() -> None:
    for path in list(_tables):
        _remove(path)


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = 1024, size: int = 4 << 20):
    """Cut an Arrow batch into row ranges of bounded rows and text bytes (a single
    row may be longer)."""
    n = batch.num_rows
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + size, side="right"))
        to = min(max(to, at + 1), at + rows, n)
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    col = batch.column(text)
    if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
    return [x or b"" for x in col.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
