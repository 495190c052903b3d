"""Incremental runs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilewright.operators.quality import outcome


def record_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(fmt).load(folder)


def append_finished(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Append records to the manifest as they arrive, then stop (restartable)."""
    return (
        stream.writeStream.format(fmt).option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def outcome_stream(stream: DataFrame) -> DataFrame:
    """Running GOOD / BAD / ERROR counters; the state is one row per status."""
    status = outcome(F.col("error"), F.col("quality"))
    return stream.select(status.alias("status")).where(F.col("status").isNotNull()).groupBy("status").agg(
        F.count(F.lit(1)).alias("n")
    )


def live_counters(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the counters in a small table that every micro-batch replaces."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(sink)

    return (
        outcome_stream(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


#: Partition column of a sink that is searched by key.
KEY_PART = "key_part"


def append_unfinished(
    stream: DataFrame, sink: str, checkpoint: str, key: str = "id", fmt: str = "parquet", parts: int = 64
) -> StreamingQuery:
    """Append only records whose key the sink does not hold yet.

    Finished keys are read from the sink, so no id state grows in the stream, a
    restart with a lost checkpoint adds nothing twice, and a retried batch is
    idempotent. Repeats inside one batch are dropped. The sink is partitioned by
    a hash of the key (column ``key_part``, ``parts`` values, the same in every
    run), and a batch reads only the partitions that its own keys fall into.
    """
    schema = stream.schema
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn(KEY_PART, part)
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            touched = [r[0] for r in batch.select(part).distinct().collect()]  # at most ``parts`` numbers
            known = spark.read.schema(schema).format(fmt).load(sink).where(F.col(KEY_PART).isin(touched))
            fresh = fresh.join(known.select(key), key, "left_anti")
        fresh.select(*schema.names, KEY_PART).repartition(KEY_PART).write.mode("append").partitionBy(KEY_PART).format(fmt).save(sink)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
        .trigger(availableNow=True).start()
    )
