"""Reference-data queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators import prices as P
from lakefold.operators import reference_data as R
from lakefold.operators.screening import newest
from lakefold.plans.prices import DAILY, _daily, rounded
from lakefold.plans.screening import ENT, _entities
from lakefold.sources import table

KINDS = ["annual_report", "announcement", "credit_rating", "presentation", "press", "research", "transcript", "order"]


def outer_master(spark, root):
    a = table(spark, root, "company_master").filter("series <> 'T0'")
    a = newest(a, ["nse_symbol"], F.col("cm_id").asc()).select("isin", F.col("company_name").alias("name"), F.col("nse_symbol").alias("code"))
    b = _entities(spark, root).select("isin", F.col("company_name").alias("name"), F.col("symbol").alias("code"))
    return R.outer_master(a, b, "isin", ("MASTER", "LAKE"))


def macro_panel(spark, root):
    """Monthly means of four series side by side."""
    m = _daily(spark, root).withColumn("month", F.last_day("d"))
    groups = [m.filter(F.pmod(F.length("symbol"), F.lit(4)) == i).groupBy("month").agg(F.avg("close").alias(f"s{i}")) for i in range(4)]
    return rounded(R.panel(groups, "month"), 8)


def cpi_yoy(spark, root):
    """Twelve-month change of a monthly series."""
    m = _daily(spark, root).groupBy(F.last_day("d").alias("month")).agg(F.avg("close").alias("v"))
    w = P.Window.orderBy("month")  # one row per month
    return rounded(m.select("month", (F.col("v") / F.lag("v", 12).over(w) * 100 - 100).alias("yoy_pct")), 5)


def industry_lookup(spark, root):
    docs = table(spark, root, "documents", "doc_id", "symbol")
    return R.two_key_lookup(docs, _entities(spark, root), "symbol", ["nse_symbol", "bse_code"], "industry")


def peers_topk(spark, root):
    return R.peers(_entities(spark, root), "symbol", "industry", "market_cap_cr", 6)


def bridge_weights(spark, root):
    e = _entities(spark, root).filter("nse_industry is not null and market_cap_cr is not null")
    return R.group_weights(e, "nse_industry", "market_cap_cr").select("symbol", "nse_industry", "weight_pct")


def entity_lookup(spark, root):
    docs = table(spark, root, "documents", "doc_id", "company", "symbol")
    return R.priority_lookup(docs, _entities(spark, root), "company", "symbol").select("doc_id", "entity", "step")


def completeness_check(spark, root):
    return R.completeness(table(spark, root, "entities", "symbol"), table(spark, root, "prices", "symbol"), "symbol")


def anti_new(spark, root):
    """Events of the later half that bring a (user, type) not seen in the earlier half."""
    e = table(spark, root, "events", "event_id", "user_id", "event_type", "ts")
    early, late = e.filter("ts < timestamp_ntz'2024-01-03'"), e.filter("ts >= timestamp_ntz'2024-01-03'")
    return R.new_rows(late.select("user_id", "event_type"), early.select("user_id", "event_type"), ["user_id", "event_type"])


def semi_intersect(spark, root):
    """Symbols with both filings and prices."""
    return table(spark, root, "xbrl", "symbol").intersect(table(spark, root, "prices", "symbol"))


def price_only_symbols(spark, root):
    """Symbols with prices but no filing, by anti join."""
    return table(spark, root, "prices", "symbol").distinct().join(table(spark, root, "xbrl", "symbol").distinct(), "symbol", "left_anti")


def group_lists(spark, root):
    """Members per industry as one text, in order."""
    g = _entities(spark, root).filter("industry is not null").groupBy("industry").agg(F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("members"))
    return g


def invert_map(spark, root):
    """Items of filings turned round: per item how many filings and which symbols."""
    x = table(spark, root, "xbrl", "symbol", "facts").select("symbol", F.explode(F.map_keys("facts")).alias("item"))
    return x.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("n_symbols"))


def value_counts_top(spark, root):
    c = _entities(spark, root).filter("industry is not null").groupBy("industry").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), "industry").limit(12)


def table_status(spark, root):
    d = table(spark, root, "documents", "doc_id", "date_int", "source", "lang")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("date_int") > 0, F.col("date_int"))).alias("n_dates"), F.min(F.when(F.col("date_int") > 0, F.col("date_int"))).alias("first"),
                 F.max("date_int").alias("last"), F.count_if(F.col("lang").isNull()).alias("n_no_lang"))


def availability_manifest(spark, root):
    d = table(spark, root, "documents", "symbol", "doc_type").filter("symbol is not null")
    return R.manifest(d, "symbol", "doc_type", KINDS)


def union_keep_first(spark, root):
    """Names from two lists, the first list winning per code."""
    a = _entities(spark, root).select(F.col("nse_symbol").alias("code"), F.col("company_name").alias("name"), F.lit(0).alias("rank"))
    b = table(spark, root, "company_master").select(F.col("nse_symbol").alias("code"), F.col("company_name").alias("name"), F.lit(1).alias("rank"))
    return newest(a.unionByName(b).filter("code is not null"), ["code"], F.col("rank").asc(), F.col("name").asc())


def overlay_precedence(spark, root):
    """Quarter facts over year-to-date facts: per filing the number of items and the revenue kept."""
    x = table(spark, root, "xbrl", "xbrl_id", "facts", "ytd").withColumn("m", R.overlay(F.col("facts"), F.col("ytd")))
    return x.select("xbrl_id", F.size("m").alias("n_items"), F.try_element_at("m", F.lit("RevenueFromOperations")).alias("revenue"))


def dedupe_keys(spark, root):
    """One document per symbol and text (case and spacing aside): the earliest by sequence and id."""
    d = table(spark, root, "documents", "doc_id", "symbol", "seq", "text").filter("text is not null").withColumn("dedupe_key", R.dedupe_key(F.col("text")))
    return newest(d, ["symbol", "dedupe_key"], F.col("seq").asc_nulls_last(), F.col("doc_id").asc()).select("doc_id", "symbol", "dedupe_key")


def item_first_seen(spark, root):
    """Statement lines by first appearance over all records of a statement."""
    s = table(spark, root, "screener", "statement", "rows").select("statement", F.posexplode("rows").alias("pos", "row"))
    return s.select("statement", F.col("row")["metric"].alias("label"), "pos").filter("label is not null").groupBy("statement", "label").agg(F.min("pos").alias("first_pos"))


def index_first_snapshot(spark, root):
    """The first of a company's listed periods that a filing exists for."""
    s = table(spark, root, "screener", "rec_id", "symbol", "columns").select("rec_id", "symbol", F.posexplode("columns").alias("pos", "label"))
    have = table(spark, root, "xbrl", "symbol", "period_end").select("symbol", F.date_format("period_end", "MMM yyyy").alias("label")).distinct()
    return s.join(have, ["symbol", "label"]).groupBy("rec_id").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))


def weekday_calendar(spark, root):
    """All weekdays between the first and the last price."""
    span = table(spark, root, "prices", "date").agg(F.min(F.col("date").cast("date")).alias("a"), F.max(F.col("date").cast("date")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).filter("dayofweek(day) between 2 and 6")


def category_lists(spark, root):
    """Attributes of the catalogue per source and statement, as one text."""
    c = table(spark, root, "metric_catalog")
    return c.groupBy("src", "statement").agg(F.array_join(F.sort_array(F.collect_list("attribute")), ",").alias("attributes"))


def slug_to_symbol(spark, root):
    """Slugs of one source resolved to symbols through the normalised company name."""
    slugs = table(spark, root, "tijori", "slug").filter("slug is not null").distinct().withColumn("_nk", R.name_key(F.col("slug")))
    names = newest(_entities(spark, root).withColumn("_nk", R.name_key(F.col("company_name"))), ["_nk"], F.col("symbol").asc()).select("_nk", "symbol")
    return slugs.join(names, "_nk", "left").select("slug", "symbol")


QUERIES = {f.__name__: f for f in (
    outer_master, macro_panel, cpi_yoy, industry_lookup, peers_topk, bridge_weights, entity_lookup, completeness_check, anti_new, semi_intersect, price_only_symbols, group_lists, invert_map,
    value_counts_top, table_status, availability_manifest, union_keep_first, overlay_precedence, dedupe_keys, item_first_seen, index_first_snapshot, weekday_calendar, category_lists, slug_to_symbol,
)}


def _nk(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\\b(limited|ltd|the|co|company|india|private|pvt)\\b', ' ', 'g'), '\\s+', '', 'g')"


SQL = {
    "outer_master": f"""with {ENT}, a as (select isin, company_name as name, nse_symbol as code from (select *, row_number() over (partition by nse_symbol order by cm_id) as n_ from company_master where series <> 'T0') where n_ = 1),
        b as (select isin, company_name as name, symbol as code from ent),
        f as (select a.isin as i1, b.isin as i2, a.name as n1, b.name as n2, a.code as c1, b.code as c2 from a full join b on a.isin = b.isin)
        select coalesce(i1, i2) as isin, coalesce(n1, n2) as name, c1 as code_a, c2 as code_b, case when c1 is not null and c2 is not null then 'MASTER+LAKE' when c1 is not null then 'MASTER' else 'LAKE' end as listed_on from f""",
    "macro_panel": f"with {DAILY}, m as (select last_day(d) as month, length(symbol) % 4 as g, avg(close) as v from daily group by 1, 2) select month, " + ", ".join(f"round(max(v) filter (g = {i}), 8) as s{i}" for i in range(4)) + " from m group by 1",
    "cpi_yoy": f"with {DAILY}, m as (select last_day(d) as month, avg(close) as v from daily group by 1) select month, round(v / lag(v, 12) over (order by month) * 100 - 100, 5) as yoy_pct from m",
    "industry_lookup": f"""with {ENT}, a as (select nse_symbol as k, min(industry) as v from ent where nse_symbol is not null group by 1), b as (select bse_code as k, min(industry) as v from ent where bse_code is not null group by 1)
        select doc_id, symbol, coalesce(a.v, b.v) as industry from documents left join a on symbol = a.k left join b on symbol = b.k""",
    "peers_topk": f"""with {ENT}, r as (select symbol, industry, row_number() over (partition by industry order by market_cap_cr desc nulls last, symbol) as n from ent where industry is not null),
        p as (select x.symbol, y.symbol as peer, row_number() over (partition by x.symbol order by y.n)::int as rank from r x join r y on x.industry = y.industry and x.symbol <> y.symbol) select * from p where rank <= 6""",
    "bridge_weights": f"with {ENT} select symbol, nse_industry, round(market_cap_cr / sum(market_cap_cr) over (partition by nse_industry) * 100, 2) as weight_pct from ent where nse_industry is not null and market_cap_cr is not null",
    "entity_lookup": f"""with {ENT}, k as (select {_nk('company_name')} as nk, min(symbol) as s from ent group by 1) select doc_id, coalesce(k.s, e.symbol) as entity, case when k.s is not null then 'name' when e.symbol is not null then 'symbol' else 'none' end as step
        from documents left join k on k.nk <> '' and {_nk('company')} = k.nk left join ent e on e.symbol = documents.symbol""",
    "completeness_check": """with a as (select distinct symbol from entities where symbol is not null), b as (select distinct symbol from prices where symbol is not null)
        select symbol, 'missing' as side from a where symbol not in (select symbol from b) union all select symbol, 'extra' from b where symbol not in (select symbol from a)""",
    "anti_new": """select distinct user_id, event_type from events l where ts >= timestamp '2024-01-03' and not exists (select 1 from events e where e.ts < timestamp '2024-01-03' and e.user_id = l.user_id and e.event_type = l.event_type)""",
    "semi_intersect": "select symbol from xbrl intersect select symbol from prices",
    "price_only_symbols": "select distinct symbol from prices where symbol not in (select symbol from xbrl where symbol is not null)",
    "group_lists": f"with {ENT} select industry, string_agg(symbol, ',' order by symbol) as members from ent where industry is not null group by 1",
    "invert_map": "with x as (select symbol, unnest(map_keys(facts)) as item from xbrl) select item, count(*) as n, count(distinct symbol) as n_symbols from x group by 1",
    "value_counts_top": f"with {ENT} select industry, count(*) as n from ent where industry is not null group by 1 order by n desc, industry limit 12",
    "table_status": """select count(*) as n_rows, count(distinct date_int) filter (date_int > 0) as n_dates, min(date_int) filter (date_int > 0) as "first", max(date_int) as "last", count(*) filter (lang is null) as n_no_lang from documents""",
    "availability_manifest": "select symbol, " + ", ".join(f"count(*) filter (doc_type = '{k}') as \"{k}\"" for k in KINDS) + " from documents where symbol is not null group by 1",
    "union_keep_first": f"""with {ENT}, u as (select nse_symbol as code, company_name as name, 0 as rank from ent union all select nse_symbol, company_name, 1 from company_master)
        select code, name, rank from (select *, row_number() over (partition by code order by rank, name) as n from u where code is not null) where n = 1""",
    "overlay_precedence": """select xbrl_id, case when facts is null and ytd is null then null else len(list_distinct(list_concat(coalesce(map_keys(facts), []), coalesce(map_keys(ytd), []))))::int end as n_items,
        case when facts is not null and list_contains(map_keys(facts), 'RevenueFromOperations') then facts['RevenueFromOperations'] else ytd['RevenueFromOperations'] end as revenue from xbrl""",
    "dedupe_keys": """with d as (select doc_id, symbol, seq, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as dedupe_key from documents where text is not null)
        select doc_id, symbol, dedupe_key from (select *, row_number() over (partition by symbol, dedupe_key order by seq nulls last, doc_id) as n from d) where n = 1""",
    "item_first_seen": """with l as (select statement, unnest(range(len(rows)))::int as pos, unnest(rows)['metric'] as label from screener) select statement, label, min(pos) as first_pos from l where label is not null group by 1, 2""",
    "index_first_snapshot": """with s as (select rec_id, symbol, unnest(range(len(columns)))::int as pos, unnest(columns) as label from screener), h as (select distinct symbol, strftime(period_end, '%b %Y') as label from xbrl)
        select rec_id, arg_min(label, pos) as label, min(pos) as pos from s join h using (symbol, label) group by 1""",
    "weekday_calendar": """with s as (select min(date::date) as a, max(date::date) as b from prices), x as (select unnest(generate_series(a, b, interval 1 day))::date as day from s) select day from x where isodow(day) <= 5""",
    "category_lists": "select src, statement, string_agg(attribute, ',' order by attribute) as attributes from metric_catalog group by 1, 2",
    "slug_to_symbol": f"""with {ENT}, k as (select {_nk('company_name')} as nk, min(symbol) as symbol from ent group by 1), s as (select distinct slug from tijori where slug is not null)
        select slug, k.symbol from s left join k on {_nk('slug')} = k.nk""",
}
