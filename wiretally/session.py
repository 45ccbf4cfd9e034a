"""Session and shared-folder settings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "wiretally", shuffle_partitions: int | None = None,
                  **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's `spark.checkpoint.dir`, removed when the session ends.

    Where that is not set, below the warehouse, which a cluster's executors share as well.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) \
        or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
