"""Reference-data operators: masters, panels, bridges, peers, lookups with fallback, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.operators.screening import newest


def outer_master(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join of two masters with columns key, name, code: key, name (of the first, else the
    second), codes of both and ``listed_on``. Rows without a key are kept apart, never joined to each
    other."""
    a_name, b_name = names
    x = a.select(F.col(key), F.col("name").alias("name_a"), F.col("code").alias("code_a"))
    y = b.select(F.col(key), F.col("name").alias("name_b"), F.col("code").alias("code_b"))
    both = x.filter(F.col(key).isNotNull()).join(y.filter(F.col(key).isNotNull()), key, "full")
    lone = x.filter(F.col(key).isNull()).unionByName(y.filter(F.col(key).isNull()), allowMissingColumns=True)
    out = both.unionByName(lone)
    listed = (
        F.when(F.col("code_a").isNotNull() & F.col("code_b").isNotNull(), f"{a_name}+{b_name}").when(F.col("code_a").isNotNull(), a_name).otherwise(b_name)
    )
    return out.select(key, F.coalesce("name_a", "name_b").alias("name"), "code_a", "code_b", listed.alias("listed_on"))


def panel(series: list[DataFrame], key: str) -> DataFrame:
    """n-way full outer join on one key."""
    return reduce(lambda a, b: a.join(b, key, "full"), series)


def two_key_lookup(left: DataFrame, dim: DataFrame, left_key: str, dim_keys: list[str], value: str) -> DataFrame:
    """``left`` with ``value`` of the dimension, looked up by the first dimension key that has it, else the
    next. One join: the dimension is stacked by key with its rank, so the left side is shuffled once."""
    stacked = reduce(DataFrame.unionByName, [dim.select(F.col(k).alias("_k"), F.lit(i).alias("_rank"), F.col(value).alias("_v")) for i, k in enumerate(dim_keys)])
    one = stacked.filter("_k is not null and _v is not null").groupBy("_k").agg(F.min(F.struct("_rank", "_v")).alias("m"))
    return left.join(one, left[left_key] == F.col("_k"), "left").select(*[left[c] for c in left.columns], F.col("m._v").alias(value))


def peers(universe: DataFrame, key: str, by: str, size: str, k: int) -> DataFrame:
    """The ``k`` largest others of each company's group: key, peer, rank. Each company meets only the
    k + 1 largest of its group, not all pairs."""
    order = [F.col(size).desc_nulls_last(), F.col(key)]
    top = universe.filter(F.col(by).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= k + 1)
    top = top.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(key).alias("peer")))).alias("_top"))
    mine = universe.filter(F.col(by).isNotNull()).select(key, by).join(top, by)
    others = F.slice(F.filter("_top", lambda x: x["peer"] != F.col(key)), 1, k)
    return mine.select(key, F.posexplode(others).alias("_i", "_p")).select(key, F.col("_p.peer").alias("peer"), (F.col("_i") + 1).alias("rank"))


def group_weights(universe: DataFrame, by: str, size: str) -> DataFrame:
    """Weight of each member in its group in percent, two decimals; a group without size has weight 0."""
    total = F.sum(size).over(Window.partitionBy(by))
    return universe.withColumn("weight_pct", F.when(total > 0, F.round(F.col(size) / total * 100, 2)).otherwise(F.lit(0.0)))


def name_key(name: Column) -> Column:
    """A company name for comparing: letters and digits of its words without legal forms."""
    x = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " ")
    x = F.regexp_replace(x, r"\b(limited|ltd|the|co|company|india|private|pvt)\b", " ")
    return F.regexp_replace(x, r"\s+", "")


def priority_lookup(left: DataFrame, entities: DataFrame, name: str, symbol: str) -> DataFrame:
    """Rows of ``left`` with the entity they mean and the step that found it: same normalised name, else
    same symbol. Equi joins only; entities are made unique per key first."""
    by_name = newest(entities.withColumn("_nk", name_key(F.col("company_name"))).filter("_nk <> ''"), ["_nk"], F.col("symbol").asc()).select("_nk", F.col("symbol").alias("_s1"))
    by_symbol = entities.select(F.col("symbol").alias("_s2")).distinct()
    out = left.withColumn("_nk", name_key(F.col(name))).join(by_name, "_nk", "left").join(by_symbol, F.col(symbol) == F.col("_s2"), "left")
    step = F.when(F.col("_s1").isNotNull(), "name").when(F.col("_s2").isNotNull(), "symbol").otherwise("none")
    return out.select(*[F.col(c) for c in left.columns], F.coalesce("_s1", "_s2").alias("entity"), step.alias("step"))


def completeness(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only one of two tables has."""
    x, y = a.select(key).filter(F.col(key).isNotNull()).distinct(), b.select(key).filter(F.col(key).isNotNull()).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("extra")))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the existing table lacks, one per key; null keys compare as equal."""
    x = incoming.dropDuplicates(keys).alias("x")
    y = existing.select(*keys).alias("y")
    return x.join(y, reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]), "left_anti")


def overlay(existing: Column, fresh: Column, fresh_wins: bool = False) -> Column:
    """Two maps as one; for a key in both the existing value wins, or the fresh one."""
    weak, strong = (existing, fresh) if fresh_wins else (fresh, existing)
    kept = F.map_filter(weak, lambda k, _: ~F.array_contains(F.map_keys(strong), k))
    return F.coalesce(F.map_concat(kept, strong), strong, weak)


def manifest(items: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Per key how many items there are of each kind; the kinds are given, so no pass is spent on finding
    them."""
    return items.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def dedupe_key(text: Column) -> Column:
    """The same for texts that differ in case and spacing only."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))
