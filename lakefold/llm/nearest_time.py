"""Pair each record with the nearest record in time of the same entity, within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions.times import micros


def _pair(t: Column, key: Column) -> Column:
    return F.struct(t.alias("t"), key.alias("k"))


def _carry(both: DataFrame, group: list[str], out_before: str, out_after: str, strict: bool = False) -> DataFrame:
    """On the union of both sides: the last right pair at or before and the first at or after each
    row (``strict``: before and after). Of right rows at one moment the smallest key is carried. The
    two sorts share one shuffle."""
    side = F.col("_side").desc() if strict else F.col("_side").asc()
    w_up = Window.partitionBy(*group).orderBy(F.col("_t").asc(), side, F.col("_k").desc())
    w_down = Window.partitionBy(*group).orderBy(F.col("_t").desc(), side, F.col("_k").desc())
    frame = (Window.unboundedPreceding, Window.currentRow)
    return both.withColumns({
        out_before: F.last("_before", ignorenulls=True).over(w_up.rowsBetween(*frame)),
        out_after: F.last("_after", ignorenulls=True).over(w_down.rowsBetween(*frame)),
    })


def nearest_by_time(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance_us: int,
    slice_us: int = 3_600_000_000,
) -> DataFrame:
    """One row (``left_id``, ``right_id``, ``distance_us``) per left row that has a right row of the
    same ``by`` value at most ``tolerance_us`` away; the nearest wins, then the earlier, then the
    smaller ``right_id``.

    Both tables are united, sorted per entity and time, and the last and next right-side rows are
    carried onto the left rows. So that no entity is sorted as a whole, the time axis is cut: inside
    slices of ``slice_us`` all rows are sorted; across slices only each slice's first and last right
    row travel, at most ``tolerance / slice`` of them per group. An entity with a third of all rows is
    thus spread over its slices.

    Defined results: rows with a null entity, time or id on either side match nothing; rows repeated
    on the right count once; a ``left_id`` that repeats is matched once per distinct (entity, time);
    empty tables give an empty result; other columns are ignored, so clashing names do no harm.
    """
    if tolerance_us < 0 or slice_us <= 0:
        raise ValueError("tolerance_us must not be negative and slice_us must be positive")
    coarse = (max(tolerance_us, slice_us) // slice_us + 1) * slice_us
    lhs = left.select(F.col(by).alias("_e"), micros(F.col(left_time)).alias("_t"), F.col(left_id).alias("_id"))
    lhs = lhs.dropna().withColumn("_s", F.expr(f"floor(_t / {slice_us}D)")).distinct()
    rhs = right.select(F.col(by).alias("_e"), micros(F.col(right_time)).alias("_t"), F.col(right_id).alias("_k"))
    rhs = rhs.dropna().withColumn("_s", F.expr(f"floor(_t / {slice_us}D)"))

    id_type, key_type = dict(lhs.dtypes)["_id"], dict(rhs.dtypes)["_k"]
    none_pair = F.lit(None).cast(f"struct<t:bigint,k:{key_type}>")

    # inside one slice
    left_rows = lhs.select(
        "_e", "_s", "_t", F.lit(1).alias("_side"), F.lit(None).cast(key_type).alias("_k"), "_id",
        none_pair.alias("_before"), none_pair.alias("_after"),
    )
    here = F.struct(F.col("_t").alias("t"), F.col("_k").alias("k"))
    right_rows = rhs.select(
        "_e", "_s", "_t", F.lit(0).alias("_side"), "_k", F.lit(None).cast(id_type).alias("_id"),
        here.alias("_before"), here.alias("_after"),
    )
    inside = _carry(left_rows.unionByName(right_rows), ["_e", "_s"], "_b", "_a")
    inside = inside.filter("_side = 1").select("_e", "_t", "_id", F.array("_b", "_a").alias("_c"))

    # across slices: first and last right row of each slice, carried within coarse blocks
    edges = rhs.groupBy("_e", "_s").agg(
        F.min(_pair(F.col("_t"), F.col("_k"))).alias("_after"),
        F.min(F.struct((-F.col("_t")).alias("n"), F.col("_k").alias("k"))).alias("_l"),
    )
    edges = edges.select(
        "_e", F.expr(f"floor(_s * {slice_us}D / {coarse}D)").alias("_g"), F.col("_s").alias("_t"),
        F.lit(0).alias("_side"), F.lit(None).cast(key_type).alias("_k"),
        F.lit(None).cast(id_type).alias("_id"), F.lit(None).cast("bigint").alias("_lt"),
        F.struct((-F.col("_l.n")).alias("t"), F.col("_l.k").alias("k")).alias("_before"), "_after",
    )
    wanted = lhs.select(
        "_e", F.explode(F.expr(f"sequence(floor(_s * {slice_us}D / {coarse}D) - 1, floor(_s * {slice_us}D / {coarse}D) + 1)")).alias("_g"),
        F.col("_s").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(key_type).alias("_k"), "_id",
        F.col("_t").alias("_lt"), none_pair.alias("_before"), none_pair.alias("_after"),
    )
    across = _carry(edges.unionByName(wanted), ["_e", "_g"], "_b", "_a", strict=True)
    across = across.filter("_side = 1").select("_e", F.col("_lt").alias("_t"), "_id", F.array("_b", "_a").alias("_c"))

    found = inside.unionByName(across).select("_e", "_t", "_id", F.explode("_c").alias("c")).filter("c is not null")
    found = found.withColumn("_d", F.abs(F.col("c.t") - F.col("_t"))).filter(F.col("_d") <= tolerance_us)
    best = found.groupBy("_e", "_t", "_id").agg(
        F.min(F.struct(F.col("_d").alias("d"), F.col("c.t").alias("t"), F.col("c.k").alias("k"))).alias("m")
    )
    return best.select(F.col("_id").alias(left_id), F.col("m.k").alias(right_id), F.col("m.d").alias("distance_us"))
