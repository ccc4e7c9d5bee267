"""What several operators of this subpackage share: session helpers and Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of texts that go to Python at once; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
BROADCAST_BYTES = 32 << 20

def trim_heap() -> None:
    """In a Python worker: give freed arrays of 8 MB and more, and a free heap top of 32 MB, back to the system.

    glibc's own limits grow with the largest array freed, after which a worker keeps its peak for good.
    """
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 8 << 20)
        libc.mallopt(-1, 32 << 20)


if getattr(getattr(sys.modules.get("__main__"), "__spec__", None), "name", "").startswith("pyspark."):  # pyspark.daemon, pyspark.worker
    trim_heap()


def small_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, where they are larger.

    These settings are read when a query is run, so they stay lowered for the session; they change no result.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests, a single machine) a temporary folder is made. On a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ocellus-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: it writes to the folder of ``shared_dir``."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def forget(spark: SparkSession, path: str) -> None:
    """Have a path deleted when the driver's JVM ends; results that read it are of use until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing. It goes with the driver."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its values have at most ``most`` bytes, else df: it is counted, so it should be stored."""
    wide = [f.name for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    fixed = 8 * (len(df.columns) - len(wide)) + 16
    n, size = df.agg(F.count(F.lit(1)), sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in wide), F.lit(0))).head()
    return F.broadcast(df) if n * fixed + size <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written in decimal."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def blocks(offsets: np.ndarray, size: int = 1 << 19):
    """Row ranges (a, b) whose texts have about ``size`` bytes; a longer row is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def small(batches, rows: int = BATCH_ROWS):
    """Arrow batches cut to at most ``rows`` rows, which bounds what Python holds at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
