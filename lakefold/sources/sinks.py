"""Materialised views, append with deduplication, predicate deletes, merges and rendering."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def age_seconds(spark: SparkSession, path: str) -> float | None:
    """How old a finished output is; None if there is none."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], ttl_s: float = 86_400, force: bool = False) -> DataFrame:
    """The view stored under ``path``, rebuilt if it is missing, older than ``ttl_s`` or on demand."""
    age = age_seconds(spark, path)
    if force or age is None or age > ttl_s:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_by(df: DataFrame, path: str, by: str, form: str = "json") -> None:
    """One folder per value of ``by``; rows are brought together first so that each has few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).format(form).save(path)


def append_new(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str]) -> int:
    """Append the incoming rows whose key the stored table lacks, one per key; how many there were."""
    fresh = incoming.dropDuplicates(keys)
    if age_seconds(spark, path) is not None:
        stored = spark.read.parquet(path).select(*keys)
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        fresh = fresh.alias("a").join(stored.alias("b"), on, "left_anti")
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)  # counted while written
    return seen.get["n"]


def delete_where(df: DataFrame, condition, reason, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what stays, rows per reason that go). A dry run keeps everything."""
    gone = F.coalesce(condition, F.lit(False))
    report = df.filter(gone).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return (df if dry_run else df.filter(~gone)), report


def merge_newest(stored: DataFrame, staged: DataFrame, keys: list[str], time_column: str) -> DataFrame:
    """One row per key, the newer of stored and staged; of equals the stored one."""
    both = stored.withColumn("_s", F.lit(0)).unionByName(staged.withColumn("_s", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(time_column).desc_nulls_last(), "_s")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_s")


def assemble(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One record per key of ``base`` with a struct column per part; a part that lacks the key is null."""
    out = base
    for name, part in parts.items():
        fields = [c for c in part.columns if c != key]
        out = out.join(part.select(key, F.struct(*fields).alias(name)), key, "left")
    return out


def to_markdown(df: DataFrame, rows: int = 60) -> str:
    """The first rows as a Markdown table, with a note if there are more."""
    got = df.limit(rows + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in got[:rows]]
    return "\n".join(lines + (["… more rows"] if len(got) > rows else []))


def to_json_text(df: DataFrame, most: int = 12_000) -> DataFrame:
    """Rows as JSON, cut at ``most`` characters for display: what is cut no longer parses."""
    return df.select(F.substring(F.to_json(F.struct(*df.columns)), 1, most).alias("json"))
