"""Session set-up and the shared scratch folder that cuts lineage.

Intermediate tables that several jobs read are written as Parquet below the
folder the cluster names in ``spark.checkpoint.dir``.  Every executor and the
driver reach that folder, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def build_session(master: str = "local[8]", app: str = "ledgerline", **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, ANSI, AQE on."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only where none is set and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ledgerline-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, label: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table this process wrote; call it between jobs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def task_count(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for ``rows`` rows: at least the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // max(1, rows_per_task)))
