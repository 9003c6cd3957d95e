"""Tables written once to the shared folder and read back, so that later steps neither recompute nor lose them."""
from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from rallyframe.session import shared_folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder; shuffle files of finished steps may then go."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark's cleaner drops the files of shuffles that nothing refers to
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by ``store`` that no later step reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
