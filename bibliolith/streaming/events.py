"""Event-shaped operators on Structured Streaming. Windows and watermarks are an extension: the records they mirror have no event time engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_dir


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events*.parquet")


def counts_by_window(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n) of tumbling windows, or sliding ones; events later than `late` are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def visits(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): runs of events of a key with no longer gap between them."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def busy_keys(events: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than `limit` events so far."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def first_seen(events: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Each key once in `hours`: a cache with expiry as stream state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark([key])


#: Parts of an upserted table; a batch rewrites those that its keys fall into.
PARTS = 64


def _versions(spark: SparkSession, target: str, before: int | None = None) -> list[str]:
    """The newest folder of every part of an upserted table, of batches before `before` if that is given."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/part=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    newest: dict[str, tuple[int, str]] = {}
    for status in found:
        folder = status.getPath()
        version, part = int(folder.getParent().getName()[2:]), folder.getName()
        if before is None or version < before:
            newest[part] = max(newest.get(part, (-1, "")), (version, folder.toString()))
    return [folder for _, folder in newest.values()]


def upsert_batches(target: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key in parts under `target`; see `read_upserted`.

    A batch writes new versions of the parts that its keys fall into and leaves the others alone. Replaying it changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.merge import first_by

        spark = batch.sparkSession
        rows = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        touched = {f"part={r.part}" for r in rows.select("part").distinct().collect()}  # PARTS at most
        old = [folder for folder in _versions(spark, target, number) if folder.rsplit("/", 1)[1] in touched]
        if old:
            held = spark.read.schema(batch.schema).parquet(*old)
            rows = rows.unionByName(held.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")))
        first_by(rows, [key], [F.desc(order)]).write.mode("overwrite").partitionBy("part").parquet(f"{target}/v={number}")

    return write


def read_upserted(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table that `upsert_batches` keeps: the newest version of every part."""
    folders = _versions(spark, target)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def run_batchwise(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], name: str, mode: str) -> DataFrame:
    """Drain the events stream through a query once and return what it wrote, as a table of the shared folder."""
    out = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/latest" if mode == "complete" else f"{out}/batch={number}")

    query = build(read_events(spark, sf_dir)).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/latest" if mode == "complete" else out)
