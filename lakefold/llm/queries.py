"""The queries of the training-data problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.functions.tokens import TOKENIZER
from lakefold.llm.encoding import repair_encoding
from lakefold.llm.leakage import leaked_passages
from lakefold.llm.matching import match_companies
from lakefold.llm.mixing import mix_to_targets, mixture_shares
from lakefold.llm.nearest_time import nearest_by_time
from lakefold.llm.personal import find_personal, mask_personal, session_key
from lakefold.llm.scanned import repair_scanned
from lakefold.llm.splitting import split_oversized
from lakefold.llm.transcripts import speaker_turns
from lakefold.sources import table

FIVE_DAYS_US = 5 * 86_400 * 1_000_000


def p1_matches(spark: SparkSession, root: str) -> DataFrame:
    """Companies of the second list found in the first, with a confidence each."""
    columns = ("company_name", "industry", "face_value", "listed_on")
    second = table(spark, root, "list_b", "bse_code", "scrip_name", *columns)
    master = table(spark, root, "company_master", "nse_symbol", *columns).withColumn("_code", F.col("nse_symbol"))
    return match_companies(second, master, "bse_code", "nse_symbol", "scrip_name", "_code")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_matches(spark, root).select("bse_code", "nse_symbol")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of every section and deck: at most 3,200 characters, up to 280 repeated."""
    parts = [
        split_oversized(table(spark, root, src), ["rec_id"], "text", limit=3200, overlap=280).withColumn("src", F.lit(src))
        for src in ("annual_report", "concall_presentation")
    ]
    return parts[0].unionByName(parts[1])


def p2_token_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The same with sizes in tokens of a public tokenizer: at most 800, up to 70 repeated."""
    parts = [
        split_oversized(table(spark, root, src), ["rec_id"], "text", limit=800, overlap=70, tokenizer=TOKENIZER).withColumn("src", F.lit(src))
        for src in ("annual_report", "concall_presentation")
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Records that had to be cut."""
    return p2_pieces(spark, root).filter("n_pieces > 1").select("src", "rec_id").distinct()


def p3_turns(spark: SparkSession, root: str) -> DataFrame:
    """Speaker turns of every call."""
    return speaker_turns(table(spark, root, "concall_transcript"), table(spark, root, "call_roster"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_turns(spark, root).select("call_id", "turn", "speaker")


def p4_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Noise and repaired text of every report section and rating note."""
    both = table(spark, root, "annual_report", "rec_id", "text").withColumn("src", F.lit("annual_report"))
    both = both.unionByName(table(spark, root, "credit_rating", "rec_id", "text").withColumn("src", F.lit("credit_rating")))
    return repair_scanned(both, ["src", "rec_id"], "text")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_repaired(spark, root).select("src", "rec_id", F.explode("noise").alias("noise")).distinct()


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The bar nearest to the end of each filing's period."""
    bars = table(spark, root, "prices", "symbol", "date", "close", "px_id").filter("close is not null")
    filings = table(spark, root, "xbrl", "xbrl_id", "symbol", "period_end")
    found = nearest_by_time(filings, bars, "symbol", "period_end", "date", "xbrl_id", "px_id", FIVE_DAYS_US)
    return found.select("xbrl_id", "px_id")


def p6_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Damaged texts of sectors, labels and values with what could be restored."""
    sectors = repair_encoding(table(spark, root, "entities"), "rec_id", "sector").withColumn("src", F.lit("entities"))
    cells = table(spark, root, "screener", "rec_id", "rows").select(
        "rec_id", F.flatten(F.transform("rows", lambda r: F.concat(F.map_keys(r), F.map_values(r)))).alias("cells")
    )
    cells = repair_encoding(cells, "rec_id", "cells").withColumn("src", F.lit("screener"))
    return sectors.unionByName(cells)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_repaired(spark, root).select("src", "rec_id").distinct()


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Which test items leaked into which documents, and how."""
    docs, items = table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text")
    return leaked_passages(docs, items, "doc_id", "item_id", window=20, span=10)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).select("item_id", "doc_id")


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """The mixture at the largest size at which every source with text holds its target share."""
    docs = table(spark, root, "documents", "doc_id", "source", "text")
    return mix_to_targets(docs, table(spark, root, "mix_targets"), "doc_id", "source", "text")


def p9_budget(spark: SparkSession, root: str) -> DataFrame:
    """The mixture at a budget of five million tokens; exhausted sources leave the rest to the others."""
    docs = table(spark, root, "documents", "doc_id", "source", "text")
    return mix_to_targets(docs, table(spark, root, "mix_targets"), "doc_id", "source", "text", budget=5_000_000)


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixture_shares(p9_mix(spark, root), table(spark, root, "mix_targets"))


def p10_mentions(spark: SparkSession, root: str) -> DataFrame:
    """Every mention of personal information in every document, with its surrogate."""
    people = table(spark, root, "call_roster", "speaker", "job").filter("job is null or job <> 'Operator'")
    docs = table(spark, root, "documents", "doc_id", "text")
    return find_personal(docs, "doc_id", "text", people, "speaker", session_key(spark)).drop("_h")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_mentions(spark, root).filter("surrogate is not null").select("doc_id", "kind", "start_pos").distinct()


def p10_masked(spark: SparkSession, root: str) -> DataFrame:
    """The documents concerned with typed placeholders, and with surrogates."""
    people = table(spark, root, "call_roster", "speaker", "job").filter("job is null or job <> 'Operator'")
    docs, key = table(spark, root, "documents", "doc_id", "text"), session_key(spark)
    return mask_personal(docs, "doc_id", "text", find_personal(docs, "doc_id", "text", people, "speaker", key), key)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_matches": p1_matches,
        "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_token_pieces": p2_token_pieces,
        "p3_found": p3_found, "p3_turns": p3_turns,
        "p4_found": p4_found, "p4_repaired": p4_repaired,
        "p5_found": p5_found,
        "p6_found": p6_found, "p6_repaired": p6_repaired,
        "p8_found": p8_found, "p8_leaks": p8_leaks,
        "p9_mix": p9_mix, "p9_budget": p9_budget, "p9_shares": p9_shares,
        "p10_found": p10_found, "p10_mentions": p10_mentions, "p10_masked": p10_masked,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            select distinct 'annual_report' as src, rec_id from annual_report where length(text) > 3200
            union select distinct 'concall_presentation', rec_id from concall_presentation where length(text) > 3200
        """,
        "p5_found": """
            with near as (
              select x.xbrl_id, p.px_id, row_number() over (
                partition by x.xbrl_id order by abs(epoch_us(p.date) - epoch_us(x.period_end)), p.date, p.px_id) as n
              from xbrl x join prices p on p.symbol = x.symbol and p.close is not null
                and abs(epoch_us(p.date) - epoch_us(x.period_end)) <= 432000000000)
            select xbrl_id, px_id from near where n = 1
        """,
    }
