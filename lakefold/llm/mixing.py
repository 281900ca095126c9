"""Combine sources to target shares of all tokens by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions.tokens import TOKENIZER, encoding, shipped
from lakefold.session import stored

def token_counts(docs: DataFrame, keep: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens``: the tokens of each whole text. Narrow; null texts have 0."""
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint"

    file = shipped(docs.sparkSession, tokenizer)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(file())
        for frame in frames:
            sizes = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in frame["_text"]]
            yield frame.drop(columns="_text").assign(n_tokens=pd.Series(sizes, dtype="int64", index=frame.index))

    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(count, schema)


def source_key(source: Column) -> Column:
    """One spelling of a source name: case, blanks and the kind of separator don't matter."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")


def mix_to_targets(
    docs: DataFrame, targets: DataFrame, doc_id: str, source: str, text: str,
    budget: int | None = None, seed: int = 0, slices: int = 1024, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """The mixture: ``doc_id``, ``source`` (as in ``targets``), ``copy`` (from 1), ``n_tokens``,
    ``finish`` (virtual finish time; sorting by it interleaves the sources to their shares at every
    point) and ``running`` (tokens up to and with the row).

    ``targets`` has source, target_share and max_repeats, one row per source and so few rows that
    joining them costs nothing. Weighted fair queueing: the documents of a source are queued in random
    order, its second copies behind its first ones; a document's virtual finish time is the source's
    tokens up to and with it, divided by the source's weight. All copies are range-sorted by finish time
    over the cluster and cut where the running total passes ``budget`` tokens. Without a budget it is the
    largest at which no source that has text is exhausted, so that every one of them holds its share.

    A running sum over a source, which may hold a third of all rows, is never made in one task: random
    keys cut each source into ``slices``; slice totals (sources x slices rows, which is what is joined to
    every document) are summed up first, then each slice on its own. The running total over the sort
    likewise: range partitions on their own, begun at the totals of those before. Copies that finish after
    the budget is surely used up are not sorted. Token counts are stored once. Results do not depend on
    partitioning.

    Defined results: null or unknown sources and documents without tokens take no part; a share of 0 or
    ``max_repeats`` below 1 gives nothing; of targets that repeat a source the largest share counts;
    documents that repeat are queued as often as they stand; an empty source leaves its share to the
    others in proportion, and so does an exhausted one when a budget is given, which ``mixture_shares``
    reports.
    """
    plan = targets.select(
        source_key(F.col("source")).alias("_key"), F.struct(F.col("target_share").alias("w"), F.col("max_repeats").alias("r"), F.col("source").alias("s")).alias("x")
    ).groupBy("_key").agg(F.max("x").alias("x")).select("_key", F.col("x.s").alias("_source"), F.col("x.w").alias("_weight"), F.col("x.r").alias("_most"))
    plan = plan.filter("_key is not null and _weight > 0 and _most >= 1")
    sized = token_counts(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_raw"), F.col(text).alias("_body")), ["_id", "_raw"], "_body", tokenizer)
    sized = sized.filter("n_tokens > 0 and _raw is not null").withColumn("_key", source_key(F.col("_raw"))).drop("_raw")
    sized = stored(sized.withColumn("_rand", F.xxhash64("_id", F.lit(seed))), "tokens").join(plan, "_key")
    sized = sized.withColumn("_slice", F.pmod(F.col("_rand"), F.lit(slices)))

    # total of every slice, then where each slice begins in its source
    totals = sized.groupBy("_source", "_weight", "_most", "_slice").agg(F.sum("n_tokens").alias("_part"), F.max("n_tokens").alias("_largest"))
    along = Window.partitionBy("_source").orderBy("_slice")
    totals = totals.withColumn("_start", F.sum("_part").over(along) - F.col("_part"))
    totals = totals.withColumn("_total", F.sum("_part").over(Window.partitionBy("_source")))
    totals = stored(totals, "totals")

    sources = totals.groupBy("_source").agg(F.first("_weight").alias("w"), F.first("_most").alias("r"), F.first("_total").alias("n"), F.max("_largest").alias("d"))
    state = [(r["w"], r["r"] * r["n"], r["d"]) for r in sources.collect()]  # one row per source
    if budget is None:
        budget = int(min((n / w for w, n, _ in state), default=0) * sum(w for w, _, _ in state))
    # a source has at most one document under way, so by this time the budget is used up
    horizon = _time_at(budget + sum(d for _, _, d in state), [(w, n) for w, n, _ in state])

    within = Window.partitionBy("_source", "_slice").orderBy("_rand", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = sized.select("_id", "_source", "_slice", "_rand", "n_tokens").join(
        totals.select("_source", "_slice", "_weight", "_most", "_start", "_total"), ["_source", "_slice"]
    )
    queued = queued.withColumn("_mark", F.col("_start") + F.sum("n_tokens").over(within))
    reach = F.lit(horizon) * F.col("_weight") * (1 + 1e-9)
    rounds = F.least(F.col("_most").cast("bigint"), F.floor(F.greatest(reach - F.col("_mark"), F.lit(-1.0)) / F.col("_total")) + 1)
    copies = queued.withColumn("_rounds", F.when(F.col("_mark") <= reach, rounds).otherwise(F.lit(0)))
    copies = copies.filter("_rounds > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_rounds").cast("int"))))
    copies = copies.select(
        F.col("_id").alias(doc_id), F.col("_source").alias("source"), "copy", "n_tokens",
        (((F.col("copy") - 1) * F.col("_total") + F.col("_mark")) / F.col("_weight")).alias("finish"), "_rand",
    )
    order = ["finish", "source", "copy", "_rand", doc_id]
    ranges = stored(copies.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("_range").agg(F.sum("n_tokens").alias("_sum"))  # one row per range partition
    before = before.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    upto = F.sum("n_tokens").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = ranges.withColumn("_upto", upto).join(before, "_range").withColumn("running", F.col("_before") + F.col("_upto"))
    return ranges.filter(F.col("running") <= budget).select(doc_id, "source", "copy", "n_tokens", "finish", "running")


def _time_at(total: float, state: list[tuple[float, int]]) -> float:
    """The virtual time at which sources of (weight, tokens with repeats), each until it is exhausted, have used
    ``total`` tokens together; the last one's end if they never do."""
    time, used, weight = 0.0, 0.0, sum(w for w, _ in state)
    for end, w in sorted((n / w, w) for w, n in state):
        if used + (end - time) * weight >= total:
            return time + (total - used) / weight
        used, time, weight = used + (end - time) * weight, end, weight - w
    return time


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: ``source``, ``target_share``, ``actual_share``, ``n_tokens``, ``n_rows``,
    ``most_copies``. Sources without text report 0."""
    got = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"), F.max("copy").alias("most_copies")
    )
    out = targets.select("source", "target_share").join(got, "source", "left").fillna(0, ["n_tokens", "n_rows", "most_copies"])
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return out.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(F.lit(0.0)))
