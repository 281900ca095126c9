"""Document and metric-map queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.functions import strings as X
from lakefold.operators import cleaning as C
from lakefold.operators import documents as D
from lakefold.operators import metric_map as M
from lakefold.operators.metric_map import flat_metrics
from lakefold.operators.text import LETTERHEAD
from lakefold.plans.prices import rounded
from lakefold.plans.text import lines_sql
from lakefold.plans.wide import CELLS, LINES, p7_statements
from lakefold.sources import table

THEMES = {"demand": ["demand", "volume", "orders"], "margins": ["margin", "cost"], "capex": ["outlay", "capacity", "capital work"], "debt": ["borrowings", "debt", "liquidity"], "outlook": ["outlook", "expects", "guidance"]}


def _docs(spark: SparkSession, root: str, *more: str) -> DataFrame:
    return table(spark, root, "documents", "doc_id", "text", *more).filter("text is not null")


def topic_classify(spark, root):
    return _docs(spark, root).select("doc_id", D.topic(F.col("text")).alias("topic"))


def page_kinds(spark, root):
    return _docs(spark, root).select("doc_id", D.page_kind(F.col("text")).alias("kind"))


def cover_letter(spark, root):
    return _docs(spark, root).select("doc_id", D.cover_letter_end(F.col("text")).alias("n_cover_lines"))


def letter_fields(spark, root):
    f = D.letter_fields(F.col("text"))
    return _docs(spark, root).select("doc_id", f["scrip_code"].alias("scrip_code"), f["isin"].alias("isin"), f["regulation"].alias("regulation"))


def letter_subjects(spark, root):
    return _docs(spark, root).select("doc_id", D.letter_fields(F.col("text"))["subject"].alias("subject"))


def document_dates(spark, root):
    return _docs(spark, root).select("doc_id", D.document_date(F.col("text")).alias("date_int"))


def handoff_cut(spark, root):
    return table(spark, root, "concall_transcript", "call_id", "text").filter("text is not null").select("call_id", F.length(D.cut_handoff(F.col("text"))).alias("n_chars"))


def fiscal_quarters(spark, root):
    d = table(spark, root, "documents", "doc_id", "date_int").filter("date_int > 0")
    return d.select("doc_id", D.fiscal_quarter((F.floor(F.col("date_int") / 100) % 100).cast("int")).alias("quarter"))


def section_labels(spark, root):
    """Lines of every section of every slide deck, headings recognised by their form."""
    d = table(spark, root, "concall_presentation", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    return D.deck_sections(d, "rec_id", "text").groupBy("rec_id", "section_pos", "section").agg(F.count(F.lit(1)).alias("n_lines"))


def boilerplate_skip(spark, root):
    d = table(spark, root, "credit_rating", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    return D.skip_boilerplate(d, "rec_id", "text", "(?i)press release", r"^\s*$").groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_lines"))


def numeric_blocks(spark, root):
    d = table(spark, root, "annual_report", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    blocks = D.numeric_blocks(d, "rec_id", "text", 2, 0.5)
    return rounded(blocks.withColumn("dropped", (F.col("n") >= 15) & (F.col("numeric_share") >= 0.6)))


def quality_gate(spark, root):
    """The quality gate over documents taken as the turns of their symbol."""
    d = table(spark, root, "documents", "symbol", "source", "text").filter("symbol is not null and source is not null and text is not null")
    q = D.quality_reasons(d, "symbol", "source", "text")
    return q.select("symbol", F.array_join("reasons", ",").alias("reasons"), "parse_quality")


def stale_or_missing(spark, root):
    have = table(spark, root, "xbrl", "symbol", "filing_date")
    return D.stale_or_missing(table(spark, root, "entities", "symbol").filter("symbol is not null"), have, "symbol", "filing_date", F.lit("2025-06-01").cast("timestamp_ntz"))


def parsed_form_first(spark, root):
    d = table(spark, root, "documents", "doc_id", "symbol", "doc_type").filter("symbol is not null")
    d = d.withColumn("form", F.when(F.col("doc_type") == "transcript", "json").otherwise("md"))
    return D.prefer_parsed(d, "symbol", "form").select("doc_id", "form")


def guidance_tracker(spark, root):
    return D.guidance(_docs(spark, root, "date_int"), THEMES, "doc_id", "text", "date_int")


def flat_metric_map(spark, root):
    """The flat metric map of every company and basis, from all its statements."""
    w = p7_statements(spark, root)
    part = F.split("entity", r"\|")
    w = w.withColumns({"company": F.concat_ws("|", part[0], part[1]), "period": part[3]})
    columns = [c for c, t in w.dtypes if t == "double"]
    one = w.groupBy("company", "period").agg(*[F.max(c).alias(c) for c in columns])
    return rounded(flat_metrics(one, "company", "period"), 4)


def deck_blocks(spark, root):
    d = table(spark, root, "concall_presentation", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    return C.clean_presentation(d, "rec_id", "text").select("rec_id", "block", "n_lines", F.md5("text").alias("digest"))


def report_paragraphs(spark, root):
    d = table(spark, root, "annual_report", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    return C.clean_report(d, "rec_id", "text").select("rec_id", "paragraph", F.md5("text").alias("digest"))


def rating_notes(spark, root):
    """Rating notes cut to their rationale, with their date."""
    d = table(spark, root, "credit_rating", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    return C.clean_rating(d, "rec_id", "text").select("rec_id", F.md5("text").alias("digest"), "quality", "non_cooperation")


def introduced_analysts(spark, root):
    return C.introduced(table(spark, root, "concall_transcript", "call_id", "text").filter("text is not null"), "call_id", "text")


def announcement_bodies(spark, root):
    return _docs(spark, root, "doc_type").filter("doc_type = 'announcement'").select("doc_id", F.length(C.announcement_body(F.col("text"))).alias("n_chars"))


def string_functions(spark, root):
    """Listing keys, context lines, file suffixes and fiscal labels of entities and documents."""
    e = table(spark, root, "entities", "rec_id", "nse_symbol", "bse_code", "loaded_at", "symbol")
    return e.select("rec_id", X.listing_key(F.col("nse_symbol"), F.col("bse_code")).alias("listing_key"), X.fiscal_label(F.date_format("loaded_at", "yyyy-MM-dd")).alias("fy"),
                    X.context_line(F.col("symbol"), F.lit("Q1 FY24"), F.lit("qa")).alias("context"), X.suffix_after(F.concat("symbol", F.lit("_A.pdf"))).alias("suffix"))


def fact_labels(spark, root):
    """Names of facts in words, and the last known value of each filing's margins."""
    x = table(spark, root, "xbrl", "facts").select(F.explode(F.map_keys("facts")).alias("item")).distinct()
    return x.select("item", X.camel_words(F.col("item")).alias("label"))


def headline_types(spark, root):
    first = F.split("text", r"\r\n|\r|\n")[0]
    h = X.headline_parts(first)
    return _docs(spark, root).select("doc_id", h["kind"].alias("kind"), F.length(h["description"]).alias("n_chars"))


def fact_search(spark, root):
    """The facts of each filing whose name holds 'profit'."""
    x = table(spark, root, "xbrl", "xbrl_id", "facts")
    return x.select("xbrl_id", F.explode(X.keys_with(F.col("facts"), "profit")).alias("item", "value"))


QUERIES = {f.__name__: f for f in (
    deck_blocks, report_paragraphs, rating_notes, introduced_analysts, announcement_bodies, string_functions, fact_labels, headline_types, fact_search,
    topic_classify, page_kinds, cover_letter, letter_fields, letter_subjects, document_dates, handoff_cut, fiscal_quarters, boilerplate_skip, numeric_blocks, quality_gate,
    stale_or_missing, parsed_form_first, guidance_tracker, flat_metric_map, section_labels,
)}


_M3 = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def _compact(y: str, m: str, d: str) -> str:
    return f"case when {y} between 2000 and 2035 and {m} between 1 and 12 and {d} between 1 and 31 then {y} * 10000 + {m} * 100 + {d} end"


def _figures() -> str:
    """The rules of the flat metric map as SQL."""
    at = lambda c, n: f"(max({c}) filter (n = {n}))"
    out = []
    for name, shape, c, n in M.rules():
        if c not in LINES:
            continue
        now, then, few = at(c, 0), at(c, n), f"count({c}) filter (n < {n}) = {n}"
        sql = {
            "offset": then, "growth": f"case when {then} > 0 then ({now} / {then} - 1) * 100 end", "cagr": f"case when {then} > 0 and {now} > 0 then (pow({now} / {then}, 1.0 / {n or 1}) - 1) * 100 end",
            "mean": f"case when {few} then avg({c}) filter (n < {n}) end", "sum": f"case when {few} then sum({c}) filter (n < {n}) end",
        }[shape]
        out.append(f"round({sql}, 4) as {name}")
    equity = f"({at('equity_capital', 0)} + coalesce({at('reserves', 0)}, 0))"
    for name, top, bottom, scale in M.RATIOS:
        den = equity if bottom == "_equity" else at(bottom, 0)
        out.append(f"round(case when {den} > 0 then {at(top, 0)} / {den} * {scale} end, 4) as {name}")
    return ", ".join(out)


_TOPIC = "case " + " ".join("when " + " or ".join(f"lower(text) like '%{w}%'" for w in words) + f" then '{name}'" for name, words in D.TOPICS.items()) + " else 'other' end"
_FIRST = "split_part(split_part(text, E'\\r', 1), E'\\n', 1)"
_MARKS = "(" + " + ".join(f"regexp_matches(low, '{p}')::int" for p in LETTERHEAD) + ")"
_MARKED = " or ".join(f"regexp_matches(lower(line), '{p}')" for p in LETTERHEAD)
_HEADING = D.DECK_HEADING.replace("'", "''")
SQL = {
    "section_labels": f"""with {lines_sql('concall_presentation', 'rec_id')}, h as (select rec_id, pos, lower(trim(concat({', '.join(f"regexp_extract(trim(line, ' '), '{_HEADING}', {i})" for i in range(1, 5))}), ' ')) as h from l),
        s as (select rec_id, pos, last_value(case when h <> '' then pos end ignore nulls) over (partition by rec_id order by pos rows unbounded preceding) as section_pos from h)
        select s.rec_id, s.section_pos, h.h as section, count(*) as n_lines from s join h on h.rec_id = s.rec_id and h.pos = s.section_pos group by 1, 2, 3""",
    "cover_letter": f"""with {lines_sql('documents', 'doc_id')} select doc_id, coalesce(max(pos + 1) filter (pos < 120 and ({_MARKED})), 0)::int as n_cover_lines from l group by 1""",
    "handoff_cut": """select call_id, length(trim(text[1:greatest(length(text) - 250, 0)] || regexp_replace(right(text, 250), '(?is)\\b(thank you\\.?\\s*)?(the )?(next|our next) question (is|comes) from\\b.*$', ''), ' '))::int as n_chars
        from concall_transcript where text is not null""",
    "boilerplate_skip": f"""with {lines_sql('credit_rating', 'rec_id')}, s as (select *, coalesce(last_value(case when regexp_matches(line, '(?i)press release') then true when regexp_matches(line, '^\\s*$') then false end ignore nulls)
        over (partition by rec_id order by pos rows unbounded preceding), false) as skip from l) select rec_id, count(*) as n_lines from s where not skip group by 1""",
    "numeric_blocks": f"""with {lines_sql('annual_report', 'rec_id')}, b as (select *, sum((trim(line, ' ') = '')::int) over (partition by rec_id order by pos) as block from l),
        n as (select *, (regexp_matches(line, '\\d') and length(regexp_replace(line, '[\\d.,%()\\s-]', '', 'g')) <= 0.4 * length(line))::int::double as num from b where trim(line, ' ') <> '')
        select rec_id, min(pos) as first_pos, count(*) as n, round(avg(num), 6) as numeric_share, count(*) >= 15 and avg(num) >= 0.6 as dropped from n group by rec_id, block having count(*) >= 2 and avg(num) >= 0.5""",
    "letter_subjects": "select doc_id, trim(regexp_extract(text, '(?im)^\\s*sub(?:ject)?\\s*[-:]\\s*(.+)$', 1)) as subject from documents where text is not null",
    "headline_types": f"""select doc_id, regexp_extract({_FIRST}, '^(.*?)\\s+[-–:]\\s+(.*)$', 1) as kind,
        case when regexp_matches({_FIRST}, '\\s+[-–:]\\s+') then length(regexp_extract({_FIRST}, '^(.*?)\\s+[-–:]\\s+(.*)$', 2)) else length({_FIRST}) end::int as n_chars from documents where text is not null""",
    "announcement_bodies": """select doc_id, length(trim(regexp_replace(regexp_replace(text, '(?is)^.*?\\b(dear (sir|madam)[^\\n]*)\\n', ''), '(?is)\\n\\s*(yours (faithfully|sincerely|truly)|thanking you|for and on behalf of)\\b.*$', '')))::int as n_chars
        from documents where text is not null and doc_type = 'announcement'""",
    "string_functions": """select rec_id, coalesce(nullif(trim(nse_symbol), ''), floor(try_cast(bse_code as double))::bigint::varchar) as listing_key, 'FY' || strftime(loaded_at, '%y') as fy,
        '[' || concat_ws(' ', symbol, 'Q1 FY24', 'questions and answers') || ']' as context, case when symbol is not null then 'A' end as suffix from entities""",
    "fact_labels": "select distinct item, regexp_replace(item, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') as label from (select unnest(map_keys(facts)) as item from xbrl)",
    "fact_search": "with x as (select xbrl_id, unnest(map_entries(facts)) as e from xbrl) select xbrl_id, e.key as item, e.value as value from x where lower(e.key) like '%profit%' and e.value is not null",
    "topic_classify": f"select doc_id, {_TOPIC} as topic from documents where text is not null",
    "page_kinds": "select doc_id, case when length(text) < 250 then 'thin' when length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) > 0.16 then 'table' else 'text' end as kind from documents where text is not null",
    "letter_fields": """select doc_id, regexp_extract(text, '(?i)\\bscrip code[^0-9]{0,12}(\\d{6,7})\\b', 1) as scrip_code, regexp_extract(text, '\\b([A-Z]{3}\\d{10}|IN[EF][A-Z0-9]{9})\\b', 1) as isin,
        regexp_extract(text, '(?i)\\bregulation\\s+(\\d+)', 1) as regulation from documents where text is not null""",
    "fiscal_quarters": "select doc_id, ['Q3', 'Q4', 'Q1', 'Q2'][((date_int // 100) % 100 - 1) // 3 + 1] as quarter from documents where date_int > 0 and (date_int // 100) % 100 between 1 and 12",
    "quality_gate": """with t as (select symbol, source, count(*) as n, sum(length(text)) as c, max(length(text)) as m from documents where symbol is not null and source is not null and text is not null group by 1, 2),
        g as (select symbol, sum(n) as n, count(*) as speakers, sum(c) as c, max(c) as top, max(m) as m from t group by 1),
        r as (select symbol, concat_ws(',', case when n < 6 then 'few_turns' end, case when speakers < 3 then 'few_speakers' end, case when top > 0.9 * c then 'one_voice' end, case when m > 0.6 * c then 'giant_turn' end, case when c < 1500 then 'little_text' end) as reasons from g)
        select symbol, reasons, case when reasons = '' then 'good' else 'weak' end as parse_quality from r""",
    "stale_or_missing": "select distinct symbol from entities where symbol is not null and symbol not in (select symbol from xbrl where symbol is not null and filing_date >= timestamp '2025-06-01')",
    "parsed_form_first": """select doc_id, case when doc_type = 'transcript' then 'json' else 'md' end as form from documents d where symbol is not null
        and (doc_type = 'transcript' or symbol not in (select symbol from documents where doc_type = 'transcript' and symbol is not null))""",
    "document_dates": f"""with l as (select doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(x, ' ') <> '')[1:8], chr(10)) as h from documents where text is not null),
        x as (select *, regexp_extract(h, '\\b(\\d{{1,2}})(?:st|nd|rd|th)?[ -]([A-Za-z]{{3,9}})[ ,-]+(20\\d{{2}})\\b', ['d', 'm', 'y']) as a, regexp_extract(h, '\\b([A-Za-z]{{3,9}}) (\\d{{1,2}}), ?(20\\d{{2}})\\b', ['m', 'd', 'y']) as b,
          regexp_extract(h, '\\b(\\d{{1,2}})[/.-](\\d{{1,2}})[/.-](20\\d{{2}})\\b', ['d', 'm', 'y']) as c from l),
        y as (select *, list_position({_M3}, lower(a.m[1:3])) as am, list_position({_M3}, lower(b.m[1:3])) as bm from x)
        select doc_id, coalesce({_compact('try_cast(a.y as int)', 'am', 'try_cast(a.d as int)')}, {_compact('try_cast(b.y as int)', 'bm', 'try_cast(b.d as int)')}, {_compact('try_cast(c.y as int)', 'try_cast(c.m as int)', 'try_cast(c.d as int)')}, 0)::int as date_int from y""",
    "guidance_tracker": f"""with a as (select doc_id, date_int, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as a from documents where date_int > 0 and text is not null),
        s as (select doc_id, date_int, unnest(range(len(a))) as pos, unnest(a) as statement from a), t as (select *, lower(statement) as low from s where length(statement) > 30),
        h as ({' union all '.join(f"select {i} as i, '{t}' as theme, doc_id, date_int, pos, statement, " + ' + '.join(f"contains(low, '{w}')::int" for w in words) + " as score from t" for i, (t, words) in enumerate(THEMES.items()))}),
        d as (select *, dense_rank() over (partition by theme order by date_int desc) as d from h where score > 0), n as (select *, row_number() over (partition by theme, date_int order by score desc, doc_id, pos) as n from d where d <= 6),
        o as (select *, row_number() over (partition by statement[1:120] order by i, date_int desc, doc_id, pos) as o from n where n <= 2) select theme, date_int, doc_id, statement from o where o = 1""",
    "flat_metric_map": f"""with {CELLS}, one as (select symbol || '|' || basis as company, month as period, {', '.join(f"max(value) filter (attribute = '{a}') as {a}" for a in LINES)} from cells group by 1, 2),
        r as (select *, row_number() over (partition by company order by period desc) - 1 as n from one), g as (select company, {_figures()} from r group by 1) select * from g""",
    "introduced_analysts": f"""with x as (select call_id, unnest(regexp_extract_all(text, '{C.INTRODUCED.replace("'", "''")}', 1)) as name, unnest(regexp_extract_all(text, '{C.INTRODUCED.replace("'", "''")}', 2)) as firm from concall_transcript where text is not null)
        select call_id, regexp_replace(name, '\\.+$', '') as name, coalesce(max(trim(regexp_replace(firm, '(?i)\\b(please|thank|go ahead|you (can|may))\\b.*$', ''), ' ')), '') as firm from x group by 1, 2""",
    "deck_blocks": f"""with {lines_sql('concall_presentation', 'rec_id')}, k as (select rec_id, row_number() over (partition by rec_id order by pos) - 1 as pos, line from l where not regexp_matches(line, '^\\s*[-+]?[\\d.,%]+\\s*$')),
        b as (select *, sum((trim(line, ' ') = '')::int) over (partition by rec_id order by pos) as block from k), g as (select rec_id, block, min(pos) as first_pos, count(*) as n_lines, string_agg(trim(line, ' '), chr(10) order by pos) as text from b where trim(line, ' ') <> '' group by 1, 2),
        ab as (select *, max(first_pos) over (partition by rec_id) as n, lower(text) as low from g)
        select rec_id, block, n_lines, md5(text) as digest from ab where not (regexp_matches(low, 'disclaimer|forward[- ]looking|safe harbou?r') or {_MARKS} >= 2 or (case when n > 0 then first_pos / n else 0 end >= 0.85 and regexp_matches(low, '^\\W*(thank you|contact)'))) and length(text) > 30""",
    "report_paragraphs": f"""with {lines_sql('annual_report', 'rec_id')}, k as (select *, lower(trim(line, ' ')) as bare from l), m as (select *, count(*) over (partition by rec_id, bare) as n, row_number() over (partition by rec_id, bare order by pos) as i from k),
        f as (select * from m where (bare = '' or n < 8 or i = 1) and not regexp_matches(bare, '^(page )?\\d{{1,4}}( of \\d{{1,4}})?$')), w as (select *, lag(line) over (partition by rec_id order by pos) as before from f),
        p as (select *, sum((trim(line, ' ') = '' or before is null or trim(before, ' ') = '' or regexp_matches(before, '[.!?:]\\s*$'))::int) over (partition by rec_id order by pos) as paragraph from w)
        select rec_id, paragraph, md5(string_agg(trim(line, ' '), ' ' order by pos)) as digest from p where trim(line, ' ') <> '' group by 1, 2""",
    "rating_notes": f"""with {lines_sql('credit_rating', 'rec_id')}, w as (select *, min(case when regexp_matches(lower(line), 'rationale') then pos end) over (partition by rec_id) as a, min(case when regexp_matches(lower(line), '^\\W*(annexure|about the company|disclaimer)') then pos end) over (partition by rec_id) as z from l),
        t as (select rec_id, string_agg(line, chr(10) order by pos) as text from w where pos >= coalesce(a, 0) and (z is null or pos < z or z <= coalesce(a, 0)) group by 1)
        select rec_id, md5(text) as digest, case when length(text) < 600 then 'stub' else 'full' end as quality, contains(lower(text), 'not cooperating') as non_cooperation from t""",
}
