"""Exact vector retrieval: filtered top-k, per-group cap, timeline, each for one query or a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def scored(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``score``, the cosine similarity to ``query`` for unit vectors; the vector itself
    is dropped right after."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", dot(F.col(vector), q)).drop(vector)


def top_k(vectors: DataFrame, query: list[float], key: str, k: int = 8, where: Column | None = None) -> DataFrame:
    """The ``k`` most similar rows after the filter; ties go to the smaller key. A distributed top-k."""
    base = vectors if where is None else vectors.filter(where)
    return scored(base, query).orderBy(F.col("score").desc(), key).limit(k)


def top_k_capped(vectors: DataFrame, query: list[float], key: str, group: str, k: int = 8, most: int = 2, fetch: int = 5) -> DataFrame:
    """As ``top_k``, with at most ``most`` rows per group, chosen among the ``fetch * k`` best."""
    best = top_k(vectors, query, key, k * fetch)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc(), key))
    return best.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n").orderBy(F.col("score").desc(), key).limit(k)


def timeline(vectors: DataFrame, query: list[float], key: str, date: str, n_dates: int = 8, per_date: int = 1) -> DataFrame:
    """The best ``per_date`` rows of each of the newest ``n_dates`` known dates."""
    s = scored(vectors.filter(F.col(date) > 0), query)
    dates = s.select(date).distinct().orderBy(F.col(date).desc()).limit(n_dates)
    rank = F.row_number().over(Window.partitionBy(date).orderBy(F.col("score").desc(), key))
    return s.join(dates, date).withColumn("_n", rank).filter(F.col("_n") <= per_date).drop("_n")


def scored_all(vectors: DataFrame, queries: DataFrame, query_key: str, vector: str = "embedding") -> DataFrame:
    """Every row of ``vectors`` with every row of ``queries`` (``query_key`` and ``vector``) and their
    ``score``. Spark broadcasts the queries or, if they are many, joins blocks of both sides."""
    q = queries.select(query_key, F.col(vector).alias("_q"))
    return vectors.crossJoin(q).withColumn("score", dot(F.col(vector), F.col("_q"))).drop(vector, "_q")


def _first(rows: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The ``n`` best rows of each group; the limit is applied to each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), key))
    return rows.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def top_k_all(vectors: DataFrame, queries: DataFrame, query_key: str, key: str, k: int = 8, where: Column | None = None) -> DataFrame:
    """``top_k`` for every row of ``queries``."""
    base = vectors if where is None else vectors.filter(where)
    return _first(scored_all(base, queries, query_key), [query_key], key, k)


def top_k_capped_all(vectors: DataFrame, queries: DataFrame, query_key: str, key: str, group: str, k: int = 8, most: int = 2, fetch: int = 5) -> DataFrame:
    """``top_k_capped`` for every row of ``queries``."""
    best = top_k_all(vectors, queries, query_key, key, k * fetch)
    return _first(_first(best, [query_key, group], key, most), [query_key], key, k)


def timeline_all(vectors: DataFrame, queries: DataFrame, query_key: str, key: str, date: str, n_dates: int = 8, per_date: int = 1) -> DataFrame:
    """``timeline`` for every row of ``queries``."""
    known = vectors.filter(F.col(date) > 0)
    dates = known.select(date).distinct().orderBy(F.col(date).desc()).limit(n_dates)
    return _first(scored_all(known.join(F.broadcast(dates), date), queries, query_key), [query_key, date], key, per_date)


def where(doc_types: list | None = None, date_from: int | None = None, date_to: int | None = None, date_eq: int | None = None,
          type_column: str = "doc_type", date_column: str = "date_int") -> Column:
    """Metadata conditions as one predicate that scans can push down; an exact date overrides a range."""
    out = F.lit(True)
    if doc_types:
        out = out & F.col(type_column).isin(*doc_types)
    if date_eq is not None:
        return out & (F.col(date_column) == date_eq)
    if date_from is not None:
        out = out & (F.col(date_column) >= date_from)
    if date_to is not None:
        out = out & (F.col(date_column) <= date_to)
    return out
