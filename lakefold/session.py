"""Session construction and lineage cutting."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "lakefold", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; a running session is reused.

    UTC keeps timestamps comparable with zone-less engines; AQE coalesces and splits shuffle
    partitions, so ``spark.sql.shuffle.partitions`` is only an upper bound.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Taken from ``spark.checkpoint.dir``; a local folder is made
    only where the session names none and runs on one machine, as in tests. A cluster without one is refused."""
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakefold_"))
    return jsc.getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once per application: an
    archive of it goes to the shared folder and Spark hands it out, so it needs no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_lakefold_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}/lakefold.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target.toString())
    sc._lakefold_shipped = True


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, what is executed goes to Python in Arrow batches of at most ``rows`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str = "stage", **options: object) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there, the result
    survives the loss of any executor, and later reads prune columns. ``options`` are the writer's. What was written is deleted when the
    application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
