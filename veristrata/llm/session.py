"""What the operators need of a session: a shared folder, bounded batches, sources, checked broadcasts."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from veristrata.sources.scratch import new_path

#: Bytes of one Arrow batch sent to a Python worker; a longer single text is one batch.
BATCH_BYTES = 4 << 20
#: A side of a join is broadcast up to this size.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, so that very long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system, in a Python worker that lives on for later stages; nothing where the C library can't."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _hadoop_path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


#: Whether the shuffles of a query are deleted as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, transient: bool = False) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read it from there.

    The table has true statistics, so that later joins are planned by its real
    size, and survives lost executors; it goes when it is released or the session ends.
    ``transient``: the shuffles that led to it are deleted once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, "settled")
    before = spark.conf.get(CLEANUP)
    try:
        if transient:
            spark.conf.set(CLEANUP, "true")
        (df.write.option("compression", "zstd") if transient else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place, files = _hadoop_path(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        place, files = _hadoop_path(t.sparkSession, t._settled_at)
        files.delete(place, True)


def size_in_bytes(df: DataFrame) -> int:
    """Rows at eight bytes a plain field, and what strings hold."""
    strings = [F.coalesce(F.octet_length(col(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    strings += [8 * F.greatest(F.size(col(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, ArrayType)]
    held = F.lit(16 * len(df.columns))
    for s in strings:
        held = held + s
    return df.agg(F.sum(held)).first()[0] or 0


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a settled small side: broadcast if its bytes are bounded, else by shuffling both."""
    return big.join(F.broadcast(small) if size_in_bytes(small) <= BROADCAST_BYTES else small, on, how)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` and the text as UTF-8 bytes named ``raw``; a null text is empty."""
    return df.select(*[F.col(k) for k in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))


def crc_mod(column: str, modulus: int):
    """``crc32(column as text) mod modulus``; null for a null column."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
