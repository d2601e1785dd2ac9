"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, StructType, VariantType

#: ASCII white space that parts words: space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``.  Where that is unset, a temporary folder
    serves in local mode (tests); on a cluster that would not be shared, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
        folder = _own_dirs[app]
    return f"{folder.rstrip('/')}/rolecall-{app}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage, survives lost executors, and gives the planner the true size, so it
    broadcasts the table only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run meanwhile gives Python workers batches of about ``most`` bytes, or a single larger row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def clear(spark: SparkSession) -> None:
    """Deletes what ``written`` left in the shared folder for this application.

    Call it when the results that were built from these tables have been stored or read: a
    DataFrame that still reads them fails afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added until none is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return isinstance(kind, AtomicType) and not isinstance(kind, VariantType)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, but for those that can't be hashed (maps, variants)."""
    return F.xxhash64(*[F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema if _hashable(f.dataType)])


def text_hash(text: Column) -> Column:
    """A hash of a text; null and empty texts differ."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


#: Bitmaps of a filter by ``marked``, each of 4 KB: 2^25 bits, whatever the data's size.
BITMAPS = 1024


def marked(df: DataFrame, flag: str, code: Column, wanted: DataFrame, wanted_code: Column) -> DataFrame:
    """``df`` with a boolean ``flag``: false only for rows whose ``code`` (a long) none of ``wanted`` has.

    The codes of ``wanted`` set bits of a Bloom filter of one hash and of fixed size (4 MB), so it
    may be broadcast.  It spares rows that can't match the shuffle of the join that follows; where
    ``wanted`` has more codes than bits, all are marked and the join does what it would have done.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAPS * 32768))
    bits = wanted.select(place(wanted_code).alias("_p")).groupBy(F.pmod("_p", F.lit(BITMAPS)).alias("_bucket")).agg(F.bitmap_construct_agg(F.floor(F.col("_p") / BITMAPS)).alias("_bits"))
    bucket, at = free_names(df, "_bucket", "_at")
    (mask,) = free_names(df, "_bits")
    bits = written(bits, "filter-bits").select(F.col("_bucket").alias(bucket), F.col("_bits").alias(mask))
    rows = df.withColumn(at, place(code)).withColumn(bucket, F.pmod(at, F.lit(BITMAPS)))
    bit = F.floor(F.col(at) / BITMAPS)
    byte = F.conv(F.hex(F.substring(mask, (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    is_set = F.getbit(byte, (bit % 8).cast("int")) == 1
    return rows.join(F.broadcast(bits), bucket, "left").withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(bucket, at, mask)


def unit_hash(column: Column, seed: int) -> Column:
    """A seeded pseudo-random double in (0, 1) for each value of ``column``."""
    bits = F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive items whose sizes sum to about ``most`` (a larger item stands alone)."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
