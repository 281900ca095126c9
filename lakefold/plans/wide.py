"""Queries over the wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.operators.wide import filled_cells, wide_companies, wide_statements
from lakefold.sources import table


def p7_companies(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "tijori", "rec_id", "slug", "metrics", "val", "scraped_at")
    return wide_companies(rows, table(spark, root, "metric_catalog"))


def p7_statements(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "screener", "rec_id", "symbol", "basis", "statement", "rows", "scraped_at")
    return wide_statements(records, table(spark, root, "metric_catalog"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """The filled cells of both wide tables."""
    companies = filled_cells(p7_companies(spark, root), "slug").withColumn("src", F.lit("tijori"))
    statements = filled_cells(p7_statements(spark, root), "entity").withColumn("src", F.lit("screener"))
    return companies.unionByName(statements).select("src", "entity", "attribute").distinct()


QUERIES = {"p7_found": p7_found, "p7_companies": p7_companies, "p7_statements": p7_statements}


def _key_sql(label: str) -> str:
    return f"regexp_replace(regexp_replace(lower({label}), '[(\\[{{][^)\\]}}]*[)\\]}}]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_TIDY = "trim(translate(regexp_replace(val, '[\\s\\x{00a0}\\x{2007}\\x{202f}\\x{200b}]+', ' ', 'g'), '０１２３４５６７８９०१२३४५६७८९−', '01234567890123456789-'))"
_CURRENCY_SQL = "(₹|rs\\.?|inr|\\$|â‚¹|â\\x{82}¹|‚Çπ|Γé╣|Ã¢â€šÂ¹)?\\s*"
_PLAIN = "[-+]?\\s?(\\d[\\d,]*(\\.\\d*)?|\\.\\d+)(e[-+]?\\d{1,3})?"
_READABLE = f"""case when lower(v) in ('', '-', '--', '–', '—', 'na', 'n/a', 'n.a.', 'n.a', 'nil', 'null', 'none', 'nan') then false
    when value_type = 'text' then true
    when value_type = 'flag' then lower(regexp_replace(v, '[.\\s]+$', '')) in ('yes', 'y', 'true', 't', '1', 'no', 'n', 'false', 'f', '0')
    when value_type = 'number' then regexp_full_match(v, '(?i){_CURRENCY_SQL}{_PLAIN}(\\s*[*†‡#^]+)?|\\(\\s*{_CURRENCY_SQL}{_PLAIN}\\s*\\)(\\s*[*†‡#^]+)?')
    when value_type = 'percent' then regexp_full_match(v, '(?i){_PLAIN}\\s*(%|pct\\.?|per\\s?cent)?|\\(\\s*{_PLAIN}\\s*(%|pct\\.?|per\\s?cent)?\\s*\\)')
    when value_type = 'date' then coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%d %b %Y'), try_strptime(v, '%d-%b-%Y'), try_strptime(v, '%B %d, %Y'), try_strptime(v, '%b %d, %Y')) is not null
      or regexp_full_match(v, '-?\\d{{1,15}}') end"""
_CUR = "(₹|rs\\.?|inr|\\$|â‚¹|â\\x{82}¹|‚çπ|γé╣|ã¢â€šâ¹)"


def _number_sql(v: str) -> str:
    """A number as the reader of decorated numbers sees it, of tidy lower-case text."""
    y = f"regexp_replace(trim(regexp_replace(regexp_replace({v}, '^([(\\-+ ]*){_CUR}\\s*', '\\1'), '\\s*[*†‡#^]+$', '')), '\\s*(cr\\.?|crores?|nos\\.?|units?|days?)$', '')"
    z = f"regexp_replace({y}, '^\\(\\s*(.*?)\\s*\\)$', '\\1')"
    return f"case when regexp_full_match({z}, '[-+]?\\s?(\\d[\\d,]*(\\.\\d*)?|\\.\\d+)(e[-+]?\\d{{1,3}})?') then try_cast(regexp_replace({z}, '[,\\s]', '', 'g') as double) * case when {y} like '(%' then -1 else 1 end end"


_EMPTY = "('', '-', '--', '–', '—', 'na', 'n/a', 'n.a.', 'n.a', 'nil', 'null', 'none', 'nan')"
_PCT = "regexp_replace(lv, '\\s*(%|pct\\.?|per\\s?cent)\\s*(\\)?)\\s*$', '\\2')"
_MONTH = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], mon)"
_LABEL = "'^(\\d{1,2}[ -])?([a-z]{3})[a-z]*[ ,''-]+(\\d{4}|\\d{2})$'"
#: The catalogue's columns, which SQL has to name.
NUMBERS = "order_book store_count capacity_utilisation installed_capacity employee_count export_share r_d_spend dealer_count promoter_pledge receivable_days water_use renewable_share net_interest_margin gross_npa casa_ratio branch_count arpu subscriber_count same_store_growth attrition top_client_share molecules_filed plant_count fleet_size room_count occupancy clinker_ratio freight_cost brand_count".split()
TEXTS = "statutory_auditor head_office rating_agency registrar dividend_policy largest_brand".split()
DAYS = "incorporated_on last_agm_date rating_date next_capex_date".split()
FLAGS = "listed_subsidiary forensic_flag export_house".split()
LINES = "sales expenses operating_profit opm other_income interest depreciation profit_before_tax tax net_profit eps_in_rs equity_capital reserves borrowings other_liabilities fixed_assets cwip investments total_assets cash_from_operating_activity cash_from_investing_activity cash_from_financing_activity net_cash_flow".split()
DATE_FORMS = (("\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%m-%d"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "%d/%m/%Y"), ("\\d{1,2}\\.\\d{1,2}\\.\\d{4}", "%d.%m.%Y"), ("\\d{1,2} [A-Za-z]{3} \\d{4}", "%d %b %Y"), ("\\d{1,2}-[A-Za-z]{3}-\\d{4}", "%d-%b-%Y"),
              ("\\d{1,2} [A-Za-z]{4,9} \\d{4}", "%d %B %Y"), ("[A-Za-z]{4,9} \\d{1,2}, \\d{4}", "%B %d, %Y"), ("[A-Za-z]{3} \\d{1,2}, \\d{4}", "%b %d, %Y"))
_CELL = f"case when lv in {_EMPTY} then null when value_type = 'percent' then {_number_sql(_PCT)} when value_type = 'number' then {_number_sql('lv')} end"
_DAY = f"""case when lv in {_EMPTY} or value_type <> 'date' then null {' '.join(f"when regexp_full_match(v, '{r}') then try_strptime(v, '{f}')::date" for r, f in DATE_FORMS)} when regexp_full_match(v, '-?\\d{{1,15}}') then date '1970-01-01' + floor(v::bigint / 86400000.0)::int end"""
_YES = "regexp_replace(lv, '[.\\s]+$', '')"
#: Cells of every record that decides, with all entities, also those without a readable cell.
CELLS = f"""
  cat as (select src, statement, attribute, value_type, {_key_sql('label')} as k from metric_catalog),
  w0 as (select *, row_number() over (partition by symbol, basis, statement order by scraped_at desc nulls last, rec_id desc) as n from screener where symbol is not null and basis is not null and statement is not null),
  w1 as (select symbol, basis, statement, unnest(range(len(rows))) as pos, unnest(rows) as r from w0 where n = 1),
  w2 as (select symbol, basis, w1.statement, attribute, value_type, pos, unnest(map_entries(r)) as e from w1 join cat on cat.src = 'screener' and cat.statement = w1.statement and {_key_sql("r['metric']")} = cat.k),
  w3 as (select *, e.key as label, e.value as val, lower(trim(regexp_replace(e.key, '[\\s\\x{{00a0}}\\x{{2007}}\\x{{202f}}\\x{{200b}}]+', ' ', 'g'))) as p from w2 where e.key <> 'metric'),
  w4 as (select *, lower({_TIDY}) as lv, regexp_extract(p, {_LABEL}, 2) as mon, regexp_extract(p, {_LABEL}, 3) as y from w3),
  w5 as (select *, case when regexp_full_match(p, '\\d{{4}}-\\d{{2}}(-\\d{{2}})?') then p[1:7] when mon <> '' and {_MONTH} > 0 then lpad(y, 4, '20') || '-' || lpad({_MONTH}::varchar, 2, '0') end as month, {_CELL} as value from w4),
  cells as (select symbol, basis, statement, month, attribute, arg_min(value, (pos, label)) filter (value is not null) as value from w5 where month is not null group by 1, 2, 3, 4, 5)
"""
SQL = {
    "p7_found": f"""with cat as (select src, statement, attribute, value_type, {_key_sql('label')} as k from metric_catalog),
      t0 as (select slug, attribute, value_type, val, row_number() over (partition by slug, attribute order by scraped_at desc nulls last, rec_id desc) as n
        from tijori join cat on cat.src = 'tijori' and {_key_sql('metrics')} = cat.k where slug is not null),
      t1 as (select slug, attribute, value_type, {_TIDY} as v from t0 where n = 1 and val is not null),
      s0 as (select *, row_number() over (partition by symbol, basis, statement order by scraped_at desc nulls last, rec_id desc) as n from screener where symbol is not null and basis is not null and statement is not null),
      s1 as (select symbol, basis, statement, unnest(rows) as r from s0 where n = 1),
      s2 as (select symbol, basis, s1.statement, attribute, value_type, unnest(map_entries(r)) as e from s1 join cat on cat.src = 'screener' and cat.statement = s1.statement and {_key_sql("r['metric']")} = cat.k),
      s3 as (select symbol, basis, statement, attribute, value_type, e.value as val, lower(trim(e.key)) as p from s2 where e.key <> 'metric' and e.value is not null),
      s4 as (select *, regexp_extract(p, '^(\\d{{1,2}}[ -])?([a-z]{{3}})[a-z]*[ ,''-]+(\\d{{4}}|\\d{{2}})$', 2) as mon, regexp_extract(p, '^(\\d{{1,2}}[ -])?([a-z]{{3}})[a-z]*[ ,''-]+(\\d{{4}}|\\d{{2}})$', 3) as y from s3),
      s5 as (select symbol, basis, statement, attribute, value_type, {_TIDY} as v, case when regexp_full_match(p, '\\d{{4}}-\\d{{2}}') then p
        when mon <> '' then lpad(y, 4, '20') || '-' || lpad(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], mon)::varchar, 2, '0') end as month from s4)
      select distinct 'tijori' as src, slug as entity, attribute from t1 where {_READABLE}
      union select distinct 'screener', concat_ws('|', symbol, basis, statement, month), attribute from s5 where month is not null and {_READABLE}""",
    "p7_statements": f"""with {CELLS} select symbol || '|' || basis || '|' || statement || '|' || month as entity, {', '.join(f"max(value) filter (attribute = '{a}') as {a}" for a in LINES)} from cells group by 1""",
    "p7_companies": f"""with cat as (select attribute, value_type, {_key_sql('label')} as k from metric_catalog where src = 'tijori'),
      t0 as (select slug, attribute, value_type, val, row_number() over (partition by slug, attribute order by scraped_at desc nulls last, rec_id desc) as n from tijori join cat on {_key_sql('metrics')} = cat.k where slug is not null),
      t1 as (select slug, attribute, value_type, {_TIDY} as v, lower({_TIDY}) as lv from t0 where n = 1 and val is not null),
      t2 as (select slug, attribute, {_CELL} as number, {_DAY} as day, case when value_type = 'flag' then case when {_YES} in ('yes', 'y', 'true', 't', '1') then true when {_YES} in ('no', 'n', 'false', 'f', '0') then false end end as flag,
        case when value_type = 'text' and lv not in {_EMPTY} then v end as txt from t1), s as (select distinct slug from tijori where slug is not null)
      select slug, {', '.join([f"max(number) filter (attribute = '{a}') as {a}" for a in NUMBERS] + [f"max(txt) filter (attribute = '{a}') as {a}" for a in TEXTS] + [f"max(day) filter (attribute = '{a}') as {a}" for a in DAYS] + [f"bool_or(flag) filter (attribute = '{a}') as {a}" for a in FLAGS])}
      from s left join t2 using (slug) group by 1""",
}
