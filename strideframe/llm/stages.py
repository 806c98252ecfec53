"""Intermediate tables in the shared folder, free column names, and bounded samples of documents."""

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.session import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` and read it again. Spark removes the shuffle files of the job, which nothing can use any more."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """Texts go to Python in Arrow batches of at most ``limit`` bytes (Spark's own limits are 64 MB and 10,000 rows), so that
    what workers and their buffers hold does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def give_back() -> None:
    """Return memory that this worker has freed to the system: workers live on from stage to stage, and what they keep for
    themselves adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Scratch:
    """Tables of one run below ``spark.checkpoint.dir``; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        return save(df, f"{self.root}/{name}", codec)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_column(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with one more column at its end."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def drawn(df: DataFrame, share: float | Column, salt: int) -> DataFrame:
    """Every row with the same chance ``share`` (0 to 1), by a 64-bit hash of its number in the scan: equal rows are drawn
    apart, and no share is too small to draw. Used to fit models only."""
    name = fresh(df, "_draw")
    numbered = df.withColumn(name, F.xxhash64(F.monotonically_increasing_id(), F.lit(salt)))
    # The hash is uniform over signed 64-bit integers; doubles are exact enough for a share.
    return numbered.where(F.col(name).cast("double") <= (2.0 * share - 1.0) * 2.0**63).drop(name)


def thinned(df: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, drawn one by one (deviation about the root of ``most``); all rows if there are no more."""
    n = df.count()
    return df if n <= most else drawn(df, most / n, 977)


#: A side of a join with at most so many rows of a few numbers is sent to all executors; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
