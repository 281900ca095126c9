"""Attribute-value rows to wide typed tables by positional stitching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakefold.functions.parse import label_key, period_month, read_typed
from lakefold.session import stored

#: Value type of a catalogue -> field of a cell, type of the column.
TYPES = {"number": ("number", "double"), "percent": ("number", "double"), "date": ("day", "date"), "flag": ("flag", "boolean"), "text": ("text", "string")}


def global_ordinals(entities: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """``key`` and ``ordinal``: distinct keys numbered 0..n-1 without gaps, without a global sort. Hash
    buckets are numbered on their own and begin where the buckets before them end; only the bucket
    counts, ``buckets`` rows, are summed up in one place."""
    keys = entities.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    starts = keys.groupBy("_b").count().withColumn("_start", F.sum("count").over(Window.orderBy("_b")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return keys.withColumn("_r", rank).join(starts.select("_b", "_start"), "_b").select(key, (F.col("_start") + F.col("_r") - 1).alias("ordinal"))


def stitch_wide(cells: DataFrame, entities: DataFrame, key: str, columns: dict[str, str], block: int = 4096) -> DataFrame:
    """One row per entity, one typed column per attribute of ``columns`` (attribute -> value type).

    ``cells`` has ``key``, ``attribute``, ``cell`` (as of ``read_typed``), at most one per key and
    attribute. Positional stitching: every entity gets a global ordinal; within a range of ``block`` ordinals
    each attribute becomes one typed column, every value written at its entity's place, and the columns of a
    range are put side by side as they are: nothing is looked up by key. Groups are bounded by ``block`` times
    the attributes however skewed the input is, and there is no pivot over all attributes per entity.
    Entities without a cell keep a row of nulls.
    """
    numbered = stored(global_ordinals(entities, key), "ordinals")
    place = {"_block": F.floor(F.col("ordinal") / block), "_at": (F.col("ordinal") % block).cast("int")}
    number = F.create_map(*[x for i, a in enumerate(columns) for x in (F.lit(a), F.lit(i))]) if columns else F.lit(None)
    frame = numbered.withColumns(place).select("_block", "_at", key, F.lit(-1).alias("_column"))
    filled = cells.filter(F.col("cell").isNotNull() & F.col("attribute").isin(*columns)).join(numbered, key).withColumns(place)
    filled = filled.select("_block", "_at", F.try_element_at(number, "attribute").alias("_column"), *[F.col(f"cell.{f}").alias(f"_{f}") for f in ("number", "day", "flag", "text")])
    kinds = [TYPES[t] for t in columns.values()]
    key_type = dict(entities.dtypes)[key]
    schema = ", ".join([f"`{key}` {key_type}", *[f"`{a}` {kind}" for a, (_, kind) in zip(columns, kinds)]])

    def stitch(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        column, at = part["_column"].to_numpy(), part["_at"].to_numpy()
        order = np.argsort(column, kind="stable")
        starts = np.searchsorted(column[order], np.arange(-1, len(kinds) + 1))
        n = int(starts[1] - starts[0])

        def positions(i: int) -> pa.Array:
            rows = order[starts[i + 1] : starts[i + 2]]
            source = np.full(n, -1, dtype=np.int64)
            source[at[rows]] = rows
            return pa.array(source, mask=source < 0)

        out = [part[key].take(positions(-1)), *[part[f"_{field}"].take(positions(i)) for i, (field, _) in enumerate(kinds)]]
        return pa.Table.from_arrays(out, names=[key, *columns])

    return frame.unionByName(filled, allowMissingColumns=True).groupBy("_block").applyInArrow(stitch, schema)


def _catalog(catalog: DataFrame, src: str, most: int = 10_000) -> dict[str, str]:
    """Attribute -> value type. The catalogue names the columns of the result, so it is read to the
    driver; more than ``most`` rows are refused."""
    rows = catalog.filter(F.col("src") == src).select("attribute", "value_type").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a catalogue of over {most} attributes can't become columns")
    return {r["attribute"]: r["value_type"] for r in sorted(rows)}


def wide_companies(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per company of rows (slug, metrics, val, scraped_at, rec_id) with the catalogue's columns.

    Per slug and attribute the newest row decides, then the larger rec_id, also if its value is missing
    or unreadable. Defined results: rows without slug or with a label outside the catalogue are left
    out; a null time is the oldest; repeated rows count once; empty input gives no rows; other columns
    are ignored.
    """
    columns = _catalog(catalog, "tijori")
    labels = catalog.filter("src = 'tijori'").select(label_key(F.col("label")).alias("_k"), "attribute", "value_type").dropDuplicates(["_k"])
    known = rows.filter("slug is not null").select("slug", label_key(F.col("metrics")).alias("_k"), "val", "scraped_at", "rec_id").join(labels, "_k")
    newest = known.groupBy("slug", "attribute", "value_type").agg(F.max(F.struct("scraped_at", "rec_id", "val")).alias("m"))
    cells = stored(newest.select("slug", "attribute", read_typed(F.col("m.val"), F.col("value_type")).alias("cell")), "cells")
    return stitch_wide(cells, rows.select("slug"), "slug", columns)


def wide_statements(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per company, basis, statement and period of statement matrices, keyed by ``entity``
    (``symbol|basis|statement|yyyy-MM``), with the catalogue's columns.

    Per symbol, basis and statement the record with the newest scraped_at decides, then the larger
    rec_id. Defined results: TTM and unreadable period labels are no period; labels outside the
    catalogue are left out; if two cells of a record mean one the first readable line counts, then the smaller label;
    null parts of the key drop the record; null columns or rows give nothing.
    """
    columns = _catalog(catalog, "screener")
    labels = catalog.filter("src = 'screener'").select("statement", label_key(F.col("label")).alias("_k"), "attribute", "value_type").dropDuplicates(["statement", "_k"])
    latest = (
        records.filter("symbol is not null and basis is not null and statement is not null")
        .groupBy("symbol", "basis", "statement").agg(F.max_by("rows", F.struct("scraped_at", "rec_id")).alias("rows"))
    )
    lines = latest.select("symbol", "basis", "statement", F.posexplode("rows").alias("_pos", "_row"))
    lines = lines.withColumn("_k", label_key(F.col("_row")["metric"])).join(labels, ["statement", "_k"])
    values = lines.select("symbol", "basis", "statement", "attribute", "value_type", "_pos", F.explode("_row").alias("_label", "_value"))
    month = period_month(F.col("_label"))
    values = values.filter("_label <> 'metric'").withColumn("_month", month).filter("_month is not null")
    values = values.select(
        F.concat_ws("|", "symbol", "basis", "statement", "_month").alias("entity"), "attribute", F.struct("_pos", "_label").alias("_o"),
        read_typed(F.col("_value"), F.col("value_type")).alias("cell"),
    )
    cells = values.groupBy("entity", "attribute").agg(F.min_by("cell", F.when(F.col("cell").isNotNull(), F.col("_o"))).alias("cell"))
    cells = stored(cells, "cells")
    return stitch_wide(cells, cells.select("entity"), "entity", columns)


def filled_cells(wide: DataFrame, key: str) -> DataFrame:
    """``entity``, ``attribute`` of every non-null cell of a wide table."""
    names = [c for c in wide.columns if c != key]
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])
    return wide.select(F.col(key).alias("entity"), F.explode(F.array_compact(cells)).alias("attribute"))
