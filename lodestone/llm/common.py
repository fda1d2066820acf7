"""What the operators share: reading tables, folds, durable cuts of lineage, bounded samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every internal column, so that columns of the caller never clash.
PRE = "__lode_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str | Column, n: int) -> Column:
    """crc32 of a value's text modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")), F.lit(n))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. A temporary one only where none is set and Spark
    runs on this machine alone, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """As cut(), but a Parquet table: columns can be pruned when it is read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Rows of whole texts that are sent to a Python worker at a time, at most.
BATCH_ROWS = 1000


def modest_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS if they are larger: texts are long, and a worker, and the
    executor that feeds it, hold a batch as a whole. Results don't depend on it."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def text_lists(col: pa.Array, chars: int = 1 << 19, rows: int = 512):
    """The strings of an Arrow column, null as empty, in lists of about so many bytes and at most so many rows."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    at, n = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and (n + size > chars or k - at >= rows):
            yield ["" if x is None else x for x in col.slice(at, k - at).to_pylist()]
            at, n = k, 0
        n += size
    if at < len(sizes):
        yield ["" if x is None else x for x in col.slice(at).to_pylist()]


def keep_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with columns added; a column of the same name is replaced."""
    return df.withColumns(new)


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, and other stages want the room."""
    global _trim
    if _trim is None:
        try:
            _trim = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _trim = int
    _trim(0)


_trim = None


def slices(texts: list[str], chars: int = 1 << 20):
    """Ranges of texts of about so many characters, one text at least."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield at, k
            at, n = k, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)
