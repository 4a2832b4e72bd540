"""Streams over files that are already there, replayed to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.session import fresh_path


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for a stream's state and tables."""
    return fresh_path(spark, "stream")


def event_stream(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """The table events as a stream of files, with its watermark."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def replay(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """What the stream gives once all files are read: each batch replaces (complete) or adds to (append) the result.

    A run that is given the `folder` of an earlier one goes on where that stopped.
    """
    spark = stream.sparkSession
    folder = folder or fresh_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream of a source with offsets of its own has given so far, over all runs with this `folder`; reads what is there now and stops."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    wanted = spark.createDataFrame([], stream.schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns) if there else wanted


def split_stream(spark: SparkSession, folder: str, n: int, in_order: bool = False) -> DataFrame:
    """The table events as n files, each a range of time, one file a batch; `in_order` has the batches follow time."""
    path = fresh_folder(spark)
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartitionByRange(n, "ts").write.parquet(path)
    if in_order:
        put_in_order(spark, path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def put_in_order(spark: SparkSession, folder: str) -> None:
    """Gives a folder's data files times that follow their names, by which a stream of files is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f.getPath(), f.getModificationTime()) for f in store.listStatus(path) if f.getPath().getName().startswith("part-"))
    first = min((t for _, _, t in files), default=0) - 1000 * len(files)
    for k, (_, file, _) in enumerate(files):
        store.setTimes(file, first + 1000 * k, -1)


def tables_in(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the tables that batches have finished in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/table-*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("table-")) for f in found)


def upsert_replay(stream: DataFrame, keys: list[str], version: str, folder: str | None = None) -> DataFrame:
    """The latest version of each key after all batches.

    Each batch writes the table anew beside the one before it, under its own
    number, so a batch that is run again gives the same table, and a run that
    is given the `folder` of an earlier one goes on where that stopped.
    Versions of a key have to differ; equal ones are one row.
    """
    spark = stream.sparkSession
    folder = folder or fresh_folder(spark)
    rest = [c for c in stream.columns if c not in keys]

    def keep(batch: DataFrame, number: int) -> None:
        before = [k for k in tables_in(spark, folder) if k < number]
        table = batch.unionByName(spark.read.parquet(f"{folder}/table-{before[-1]}")) if before else batch
        latest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__latest"))
        latest.select(*keys, "__latest.*").write.mode("overwrite").parquet(f"{folder}/table-{number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = tables_in(spark, folder)
    return spark.read.parquet(f"{folder}/table-{done[-1]}") if done else spark.createDataFrame([], stream.schema)
