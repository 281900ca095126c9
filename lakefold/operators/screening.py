"""Universe screens: resolution, text and threshold filters, funnels, near misses, exclusions, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions.parse import read_number


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key under an explicit order (never an arbitrary one). The rank limit is pushed
    below the shuffle, so a hot key sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def entity_master(raw: DataFrame) -> DataFrame:
    """One typed row per symbol: the newest load, decorated numbers as doubles."""
    one = newest(raw.filter("symbol is not null"), ["symbol"], F.col("loaded_at").desc_nulls_last(), F.col("rec_id").desc())
    return one.withColumns({c: read_number(F.col(c)) for c in ("market_cap_cr", "price", "pe")})


def contains_any(columns: list[str], words: list[str]) -> Column:
    """Whether any column holds any word, literally and in any case; null columns hold nothing."""
    hits = [F.coalesce(F.lower(F.col(c)).contains(w.lower()), F.lit(False)) for c in columns for w in words]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def resolve_company(entities: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Companies a query can mean: an exact symbol first, then those whose symbol or name holds the query;
    only if there is none, those whose name holds all of its words longer than two letters. Ranked by
    exactness, then market value (unknown last), then symbol."""
    q = query.strip().lower()
    words = [w for w in q.split() if len(w) > 2]
    exact = F.lower("symbol") == q
    literal = contains_any(["symbol", "company_name"], [q])
    all_words = reduce(lambda a, b: a & b, [contains_any(["company_name"], [w]) for w in words]) if words else F.lit(False)
    marked = entities.select("symbol", "company_name", "market_cap_cr", exact.alias("exact"), literal.alias("_l"), all_words.alias("_w"))
    any_literal = marked.agg(F.coalesce(F.max("_l"), F.lit(False)).alias("_any"))
    hits = marked.filter("exact or _l or _w").crossJoin(F.broadcast(any_literal)).filter("exact or _l or (_w and not _any)")
    return hits.orderBy(F.col("exact").desc(), F.coalesce("market_cap_cr", F.lit(-1.0)).desc(), "symbol").limit(limit).select("symbol", "company_name", "market_cap_cr", "exact")


class Screen:
    """A screen over a wide table: text conditions, then minimum and maximum thresholds, then flags.

    ``null_policy``: ``pass`` lets rows without the number through, ``drop`` does not. A threshold on a
    column the table lacks is an error, not silently ignored.
    """

    def __init__(self, universe: DataFrame, text: dict[str, str] | None = None, least: dict[str, float] | None = None,
                 most: dict[str, float] | None = None, flags: dict[str, bool] | None = None, null_policy: str = "pass"):
        if null_policy not in ("pass", "drop"):
            raise ValueError("null_policy is 'pass' or 'drop'")
        self.universe, self.text, self.least, self.most, self.flags = universe, text or {}, least or {}, most or {}, flags or {}
        self.null_passes = null_policy == "pass"
        unknown = [c for c in [*self.text, *self.least, *self.most, *self.flags] if c not in universe.columns]
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")

    def text_stages(self) -> list[tuple[str, Column]]:
        return [(f"{c}~{w}", contains_any([c], [w])) for c, w in self.text.items()]

    def number_stages(self) -> list[tuple[str, Column]]:
        null = F.lit(self.null_passes)
        out = [(f"{c}>={v:g}", F.coalesce(F.col(c) >= v, null)) for c, v in self.least.items()]
        return out + [(f"{c}<={v:g}", F.coalesce(F.col(c) <= v, null)) for c, v in self.most.items()]

    def flag_stages(self) -> list[tuple[str, Column]]:
        return [(f"{c}={str(v).lower()}", F.coalesce(F.col(c) == v, F.lit(False))) for c, v in self.flags.items()]

    def stages(self) -> list[tuple[str, Column]]:
        return self.text_stages() + self.number_stages() + self.flag_stages()

    def matches(self) -> DataFrame:
        return reduce(lambda df, s: df.filter(s[1]), self.stages(), self.universe)

    def funnel(self) -> DataFrame:
        """step, stage, remaining: all counts in one pass over the universe."""
        names, counts, so_far = ["universe"], [F.count(F.lit(1))], F.lit(True)
        for name, condition in self.stages():
            so_far = so_far & condition
            names.append(name)
            counts.append(F.count_if(so_far))
        one = self.universe.agg(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), c.alias("remaining")) for i, (n, c) in enumerate(zip(names, counts))]).alias("f"))
        return one.select(F.inline("f"))

    def passed_unknown(self) -> DataFrame:
        """Per threshold column, how many matches passed with the number missing."""
        columns = list(dict.fromkeys([*self.least, *self.most]))
        one = self.matches().agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_unknown")) for c in columns]).alias("f"))
        return one.select(F.inline("f"))

    def near_misses(self, key: str, tolerance_pct: float = 15.0, limit: int = 15) -> DataFrame:
        """Rows that pass the text stages and fail exactly one threshold by at most ``tolerance_pct`` of
        it (of 1 if it is 0): key, failed, actual, threshold, margin_pct; the nearest first."""
        base = reduce(lambda df, s: df.filter(s[1]), self.text_stages(), self.universe)
        tests = [(c, v, F.col(c) < v, (F.lit(float(v)) - F.col(c))) for c, v in self.least.items()]
        tests += [(c, v, F.col(c) > v, (F.col(c) - F.lit(float(v)))) for c, v in self.most.items()]
        failed = [
            F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("failed"), F.col(c).cast("double").alias("actual"), F.lit(float(v)).alias("threshold"), (gap / F.lit(abs(v) or 1.0) * 100).alias("margin_pct")))
            for c, v, bad, gap in tests
        ]
        out = base.select(key, F.array_compact(F.array(*failed)).alias("f")).filter(F.size("f") == 1).select(key, F.col("f")[0].alias("f")).select(key, "f.*")
        return out.filter(F.col("margin_pct") <= tolerance_pct).orderBy("margin_pct", key).limit(limit)

    def top(self, sort_by: str, key: str, limit: int = 25, ascending: bool = False) -> DataFrame:
        order = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()
        return self.matches().orderBy(order, key).limit(limit)


def exclusion_reason(categories: dict[str, list[str]], columns: list[str]) -> Column:
    """The first category (in order) one of whose words a column holds; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(categories.items()):
        out = F.when(contains_any(columns, words), name).otherwise(out)
    return out


def sector_summary(universe: DataFrame, by: str) -> DataFrame:
    """Per group: n, total and median market value, median pe (missing values ignored)."""
    return universe.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("market_cap_cr").alias("total_mcap"), F.median("market_cap_cr").alias("median_mcap"), F.median("pe").alias("median_pe")
    )


def top_per_group(df: DataFrame, by: str, order: list[Column], k: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(out) <= k)


def consistency(history: DataFrame, key: str, year: str, metric: str, least: float, n_years: int = 10, max_violations: int = 0, min_years: int = 5) -> DataFrame:
    """Keys whose ``metric`` fell below ``least`` in at most ``max_violations`` of the last ``n_years``
    years known: years, violations, worst value and year (the earliest of equals), mean, latest."""
    known = history.filter(F.col(metric).isNotNull())
    w = Window.partitionBy(key).orderBy(F.col(year).desc())
    recent = known.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n_years)
    out = recent.groupBy(key).agg(
        F.count(F.lit(1)).alias("years"), F.count_if(F.col(metric) < least).alias("violations"), F.min(metric).alias("worst"),
        F.min(F.struct(F.col(metric).alias("m"), F.col(year).alias("y")))["y"].alias("worst_year"), F.avg(metric).alias("mean"), F.max_by(metric, year).alias("latest"),
    )
    return out.filter((F.col("years") >= min_years) & (F.col("violations") <= max_violations))


def growth_on_last_known(df: DataFrame, key: str, order: str, value: str) -> Column:
    """Percent growth on the last known earlier value, gaps skipped; zero counts as missing and only a
    positive base counts."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value) != 0, F.col(value))
    base = F.last(known, ignorenulls=True).over(w)
    return F.when(known.isNotNull() & (base > 0), (known / base - 1) * 100)
