"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Rows whose texts are Python objects at one time, in a worker.
SLICE, SLICE_BYTES = 256, 1 << 25

#: Bytes of input after which a worker returns freed memory to the system.
GIVE_BACK_BYTES = 1 << 24

#: Rows in a record batch between Spark and Python, and in a batch of Spark's Parquet reader: texts are long, and batches of
#: them lie whole in a worker's or an executor's memory.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Sends the package to executors and keeps the session's batches of rows small."""
    ship(spark)
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        now = int(spark.conf.get(name))
        spark.conf.set(name, BATCH_ROWS if now <= 0 else min(now, BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents; only Spark opens the path."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of an Arrow string column, a slice of rows at a time."""
    raw = column.cast(pa.binary())
    for start in range(0, len(raw), SLICE):
        yield from raw.slice(start, SLICE).to_pylist()


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on between tasks and stages, beside those of others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most SLICE rows, and of SLICE_BYTES unless a row is larger, so what a worker
    holds stays small."""
    read = GIVE_BACK_BYTES
    for batch in batches:
        read += batch.nbytes
        if read >= GIVE_BACK_BYTES:
            give_back()
            read = 0
        rows = max(1, min(SLICE, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of this machine, if all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lanternfish-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lanternfish-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it: cuts lineage, and lost executors can't lose it."""
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more; others are left as they are."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has stored: for when the results that were made of it have been written."""
    _delete(spark, _own_folder(spark))


#: Bytes of a table that may be broadcast, as Spark holds it to join with: near what Spark itself takes for small.
BROADCAST_BYTES = 8 << 20


def _width(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value in Spark's rows: 8 for each place, and those of what varies in length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * (16 + 8 * len(kind.elementType) if isinstance(kind.elementType, T.StructType) else 8) + 24
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind), F.lit(16))
    return F.lit(8)


def small_enough(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast if its size, measured, is within the limit; otherwise left for a shuffled join. A hash table takes up to
    twice the bytes of its rows. Give stored tables, as it reads them for that."""
    size = df.agg(F.sum(2 * sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(24)))).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if limit is None else limit) else df


ROW = "__row"


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """The columns (all if none are named) and ROW, a number of each row that stays the same whenever the table is read: of
    its file and place in it. Rows are told apart by it where their ids may be null or repeat. What isn't a table as it lies
    in Parquet files is stored first."""
    columns = columns or tuple(df.columns)
    try:
        if not df._jdf.queryExecution().analyzed().children().isEmpty():
            raise AnalysisException("more than a scan")
        rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return numbered(stored(df.select(*columns)))
    files = sorted(r[0] for r in rows.select("__file").distinct().collect())  # the driver has listed them for the scan
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "__number long, __file string")
    return rows.join(small_enough(numbers), "__file").select(*columns, F.expr("shiftleft(__number, 40) + __at").alias(ROW))


def own_ids(df: DataFrame, id_col: str) -> bool:
    """Whether ids are whole numbers that tell rows apart: none null, none twice."""
    if not isinstance(df.schema[id_col].dataType, (T.IntegerType, T.LongType)):
        return False
    return not df.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count()
