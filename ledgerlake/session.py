"""A Spark session for tests, benchmarks and notebooks.

On a cluster the session comes from spark-submit; nothing in the library
depends on the settings below.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Small tables are read by all cores, too.
        .config("spark.sql.files.minPartitionNum", str(shuffle_partitions))
        .config("spark.sql.files.openCostInBytes", str(256 << 10))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
