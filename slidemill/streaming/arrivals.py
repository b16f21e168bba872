"""Streams: slides that arrive in a folder, and events of the conversion queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slidemill.functions.text import extension
from slidemill.plans.convert import convert
from slidemill.session import materialise, scratch_path
from slidemill.sources.formats.registry import READERS


def arrived(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """Paths of supported files as they arrive; their contents aren't read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(folder)
    return files.select("path", "modificationTime", "length").where(extension(F.col("path")).isin(*READERS))


def convert_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, quality: int | None = None, once: bool = False, most: int = 1000) -> StreamingQuery:
    """Converts slides when they arrive, those of a trigger (``most`` at most) as one batch.

    Beside the checkpoint stands which output each path has got: a batch that runs again gives its
    paths the same ones and leaves what is there, and no later path gets one of them.
    """
    given = f"{checkpoint.rstrip('/')}-outputs"
    schema = "path string, output string"

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        paths = sorted(r["path"] for r in rows.select("path").distinct().collect())  # of one trigger
        if not paths:
            return
        kept = session.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{given}/part=*") if any_of(session, given) else session.createDataFrame([], schema)
        earlier = kept.join(session.createDataFrame([(p,) for p in paths], "path string"), "path", "left_anti")
        done = materialise(convert(session, paths, out, quality, taken=earlier.select("output")), "arrived")
        done.where("output IS NOT NULL").select("path", "output").coalesce(1).write.mode("overwrite").parquet(f"{given}/part={number}")

    writer = arrived(spark, folder, most).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def any_of(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value by window and type; what is later than the watermark is left out in append mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("total"))


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its last state."""
    spark = stream.sparkSession
    held: list[DataFrame] = []

    def keep(rows: DataFrame, _: int) -> None:
        held[:] = [materialise(rows, name)]

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return held[0] if held else spark.createDataFrame([], stream.schema)
