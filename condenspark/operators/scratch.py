"""Tables that cut a plan in two: written once to the folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_left: list[tuple[SparkSession, str]] = []


def place(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir, which goes when the application ends. Only a local session may lack that folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df from a Parquet table in the shared folder. A lost executor costs a re-read."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """rows with their places in an order, from 0, in the column name. The rows are sorted in ranges and written; the ranges' sizes, a number
    for each task, give their first places."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(ordered.withColumn("__id", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__id", 33))
    sizes = table.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = table.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return table.withColumn(name, F.col("__before") + F.col("__id") % (1 << 33)).drop("__id", "__part", "__before")


@atexit.register
def clear() -> None:
    """What was written goes when the application ends."""
    while _left:
        spark, path = _left.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
