"""Tables between stages, and the sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master that names none, as in tests, one of our own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_own_stage_dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = context._own_stage_dir = tempfile.mkdtemp(prefix="spark-stages-")
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage's rows into the shared folder and reads them: later stages plan from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all tasks: for costly work on rows so small that few tasks hold them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def archive_positions(positions: DataFrame, path: str) -> None:
    """Positions by day, each file sorted by ship and time."""
    rows = positions.withColumn("position_date", F.to_date(F.timestamp_seconds("ts")))
    # A day is dealt over several files by ship, so that one day or ship does not fill one task.
    rows.repartition("position_date", F.pmod(F.xxhash64("mmsi", F.floor(F.col("ts") / 3600)), F.lit(16))).sortWithinPartitions("mmsi", "ts").write.mode("overwrite").partitionBy("position_date").parquet(path)
