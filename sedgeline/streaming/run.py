"""Running a streaming query to the end of its input, with all state in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedgeline import scratch

STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder or file of Parquet as a stream."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for the input that is there (``availableNow``), as a table with ``batch_id``; without
    input an empty one.  The session's state store is as it was afterwards."""
    spark, out = stream.sparkSession, scratch.new_path(stream.sparkSession, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/data/batch_id=-1")
    before = spark.conf.get(STORE, None)

    def keep(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again writes over itself
        batch.write.mode("overwrite").parquet(f"{out}/data/batch_id={batch_id}")

    spark.conf.set(STORE, PROVIDER)
    try:
        stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(f"{_ddl(stream)}, batch_id bigint").parquet(f"{out}/data")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
