"""Structured Streaming forms of the keyed folds.

The source is a folder of Parquet files; each stream runs over what is there and stops
(``availableNow``).  Aggregates run in update mode, keyed state in a state store; every batch is
written under its number, so a batch that is run again after a failure replaces itself, and the
latest row of each key is the result.  Folds that hang on the order of events are in ``ordered``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir
from . import ordered


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one stream in the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, folder: str, mode: str) -> None:
    """Runs a stream over what is there; each batch is written under its number."""
    spark = stream.sparkSession

    def save(df: DataFrame, number: int) -> None:
        df.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    # keyed state with timers needs this store; a query keeps the one that it began with
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKSDB)
    try:
        stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _out(stream: DataFrame, folder: str) -> DataFrame:
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    return stream.sparkSession.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def to_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream over all that is there; the latest row of each key."""
    folder = shared_folder(stream.sparkSession)
    _run(stream, folder, "update")
    last = _out(stream, folder).groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in stream.columns]), "_batch").alias("_last"))
    return last.select("_last.*")


def to_settled(source: DataFrame, at: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``make`` of a stream over all that is there, and then closes it: a row far ahead in time lets
    the watermark pass all others, and one more, in a batch of its own, lets what still waited come out."""
    spark, folder = source.sparkSession, shared_folder(source.sparkSession)
    marked = source.withColumn("_beat", F.lit(False))
    beats = lambda n: spark.range(n).select(*[F.lit("9999-01-01 00:00:00" if f.name == at else f.name == "_beat" if f.name == "_beat" else None).cast(f.dataType).alias(f.name) for f in marked.schema])
    beats(0).coalesce(1).write.parquet(f"{folder}/beats")
    stream = make(marked.unionByName(spark.readStream.schema(marked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/beats")))
    _run(stream, folder, "append")
    for _ in range(2):
        beats(1).coalesce(1).write.mode("append").parquet(f"{folder}/beats")
    _run(stream, folder, "append")
    return _out(stream, folder).select(*stream.columns)


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern, it may name one file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")


def sightings_fold(stream: DataFrame) -> DataFrame:
    """First and last sighting of each source of a posting; late rows only widen the span."""
    return stream.groupBy("job_id", "source_url").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def steps_fold(stream: DataFrame) -> DataFrame:
    """Each step's last stated values by event time; absent fields keep what was said before."""
    at = F.struct("ts", "seq")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c)
    return stream.groupBy("run_id", "step_key").agg(last("state"), last("detail"))


def _of(t, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return make(t.derived_from(name, {"events": events(t.spark, t.sf_dir)}))


def run_sightings(t) -> DataFrame:
    return to_latest(_of(t, "sightings", sightings_fold), ["job_id", "source_url"])


def run_steps(t) -> DataFrame:
    return to_latest(_of(t, "steps", steps_fold), ["run_id", "step_key"])


def run_streaks(t) -> DataFrame:
    latest = to_latest(_of(t, "runs", ordered.failure_streaks), ["company_id"])
    return latest.where("failures > 0")


def run_overlaps(t, delay: str = "1 day") -> DataFrame:
    return to_settled(t.derived_from("runs", {"events": events(t.spark, t.sf_dir)}), "started_at", lambda s: ordered.overlapping_runs(s, delay)).select("run_id")


def run_year_changes(t, history: Callable[[DataFrame], DataFrame], delay: str = "1 day") -> DataFrame:
    return to_settled(history(events(t.spark, t.sf_dir)), "updated_at", lambda s: ordered.year_changes(s, delay))
