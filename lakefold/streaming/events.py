"""Structured Streaming: windows, sessions, deduplication, upserts and incremental indexing.

Every function takes a streaming frame (or builds one with ``file_stream``) and a place for its
checkpoint and output; ``drain`` runs it to the end of the input that is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """New parquet files of a folder as a stream; the checkpoint remembers which were read, which is what
    a manifest of file times does."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is available now as parquet and stop."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every micro-batch to ``write``, then stop."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def tumbling(stream: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and group; events later than ``late`` behind the newest are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    agg = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """Sessions per ``by``: a pause of ``gap`` ends one."""
    s = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state older than the watermark is forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


_FAR = "9000-01-01"


def drain_to_end(stream: DataFrame, make: Callable[[DataFrame], DataFrame], time: str, start: str, place: str) -> DataFrame:
    """Run the windowed query ``make(stream)`` to the end of its input and give all windows, those that are open when
    the input ends included: behind the last row, in a second run of the same query, comes one far in the future,
    which lets the watermark pass every window; its own window (by the column ``start``) is left out. For runs that
    end, not for streams that go on."""
    spark = stream.sparkSession
    end, out, checkpoint = (f"{place}/{x}" for x in ("end", "out", "checkpoint"))
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(end)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    query = make(stream.unionByName(file_stream(spark, end, stream.schema)))
    drain(query, out, checkpoint)
    last = spark.range(1).select(*[(F.lit(_FAR) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    last.write.mode("append").parquet(end)
    drain(query, out, checkpoint)
    return spark.read.schema(query.schema).parquet(out).filter(F.col(start) < F.date_sub(F.lit(_FAR).cast("date"), 30))


def _versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, str]:
    """Bucket -> folder of its newest version (below a number)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for path in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/v=*/b=*")) or []:
        at = path.getPath()
        v, b = int(at.getParent().getName()[2:]), int(at.getName()[2:])
        done = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}/_SUCCESS"))
        if done and (below is None or v < below) and v >= newest.get(b, (-1, ""))[0]:
            newest[b] = v, at.toString()
    return {b: path for b, (_, path) in newest.items()}


def upsert(spark: SparkSession, target: str, keys: list[str], order: list[Column], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps one row per key, the newest by ``order``, in a parquet table under ``target``. Keys are
    hashed to ``buckets``; a batch reads and rewrites only the buckets it touches, as a new version of these. A
    batch that is replayed writes the same version again."""
    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        known = _versions(session, target, number)
        touched = [r["b"] for r in rows.select("b").distinct().collect()]  # at most ``buckets``
        old = [known[b] for b in touched if b in known]
        if old:
            stored = session.read.schema(batch.schema).parquet(*old).withColumn("b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            rows = rows.unionByName(stored)
        w = Window.partitionBy("b", *keys).orderBy(*order)
        rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").write.mode("overwrite").partitionBy("b").parquet(f"{target}/v={number}")

    return write


def newest_version(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table an ``upsert`` keeps."""
    paths = sorted(_versions(spark, target).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def reindex_by_source(existing: DataFrame, batch: DataFrame, source: str, key: str) -> DataFrame:
    """What an index holds after a batch: all rows of the batch's sources are replaced, of rows with one
    key the last counts."""
    kept = existing.join(batch.select(source).distinct(), source, "left_anti")
    fresh = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(source).desc()))).filter("_n = 1").drop("_n")
    return kept.unionByName(fresh)
