"""Text and retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.functions.parse import read_date, read_number
from lakefold.functions.tokens import TOKENIZER
from lakefold.operators import retrieval as V
from lakefold.operators import text as T
from lakefold.plans.prices import rounded
from lakefold.plans.wide import _TIDY
from lakefold.sources import table


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", "doc_id", "text")


def text_normalize(spark, root):
    x = T.normalise_text(F.col("text"))
    return _docs(spark, root).select("doc_id", F.md5(x).alias("digest"), F.length(x).alias("n_chars"))


def line_frequency(spark, root):
    return T.line_frequency(table(spark, root, "annual_report", "rec_id", "text").dropDuplicates(["rec_id"]), "rec_id", "text", 2)


def strip_page_headers(spark, root):
    d = table(spark, root, "credit_rating", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    return T.strip_frequent_lines(d, "rec_id", "text", 3).select("rec_id", F.length("text").alias("n_chars"))


def numeric_runs(spark, root):
    """Every run of numeric lines, and whether it is long enough to be axis ticks."""
    runs = T.numeric_runs(table(spark, root, "annual_report", "rec_id", "text").dropDuplicates(["rec_id"]), "rec_id", "text", 1)
    return runs.withColumn("dropped", F.col("n") >= 4)


def letterhead_markers(spark, root):
    return _docs(spark, root).filter("text is not null").select("doc_id", T.letterhead_markers(F.col("text")).alias("n_markers"))


def leak_scrub(spark, root):
    """Which documents a scrub by letter-head marks would drop: three marks in reports, two elsewhere,
    announcements exempt."""
    d = table(spark, root, "documents", "doc_id", "doc_type", "text").filter("text is not null")
    n = T.letterhead_markers(F.col("text"))
    drop = F.when(F.col("doc_type") == "announcement", False).when(F.col("doc_type") == "annual_report", n >= 3).otherwise(n >= 2)
    return d.withColumn("dropped", F.coalesce(drop, F.lit(False))).groupBy("doc_type", "dropped").agg(F.count(F.lit(1)).alias("n"))


def html_to_text(spark, root):
    """Documents wrapped in mark-up and read back."""
    html = F.concat(F.lit("<html><style>p {}</style><body><h1>T &amp; Co</h1><p>"), F.replace("text", F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p><p>end</p><p>end</p></body></html>"))
    return _docs(spark, root).filter("text is not null").select("doc_id", F.md5(T.html_to_text(html)).alias("digest"))


def numeric_parse(spark, root):
    """The number in every value; null where there is none to read."""
    return rounded(table(spark, root, "tijori", "rec_id", "val").select("rec_id", read_number(F.col("val")).alias("number")))


def date_parse(spark, root):
    """The day in every value; null where there is none to read."""
    return table(spark, root, "tijori", "rec_id", "val").select("rec_id", read_date(F.col("val")).alias("day"))


def label_date(spark, root):
    return table(spark, root, "concall_transcript", "call_id", "period").distinct().select("call_id", T.label_date(F.col("period")).alias("date_int"))


def filing_year(spark, root):
    return _docs(spark, root).filter("text is not null").select("doc_id", T.latest_year(F.col("text")).alias("year"))


def token_stats(spark, root):
    """Tokens per kind of document: count, least, median, most."""
    d = table(spark, root, "documents", "doc_type", "text").filter("text is not null").withColumn("n", T.token_length(F.col("text")))
    return d.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n_docs"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


def prose_yield(spark, root):
    d = table(spark, root, "concall_presentation", "rec_id", "text").dropDuplicates(["rec_id"]).filter("text is not null")
    return d.select("rec_id", T.prose_yield(F.col("text")).alias("n_prose"), (T.prose_yield(F.col("text")) < 2000).alias("image_only"))


def roster_lines(spark, root):
    d = table(spark, root, "call_roster", "call_id", "speaker", "job").groupBy("call_id").agg(F.array_join(F.sort_array(F.collect_list("job")), ", ").alias("jobs"))
    return d.select("call_id", T.roster_like(F.col("jobs")).alias("is_roster"))


def exchange_grouping(spark, root):
    """Exchanges of each user's events: every error opens one."""
    e = table(spark, root, "events", "event_id", "user_id", "event_type")
    return T.exchanges(e, "user_id", "event_id", "event_type", "error")


def chunk_sliding(spark, root):
    return T.sliding_chunks(_docs(spark, root), "doc_id", "text").select("doc_id", "seq", "n_tokens", "chunk")


def chunk_function(spark, root):
    """The same chunks through the table function of SQL."""
    T.register_functions(spark)
    _docs(spark, root).filter("text is not null").createOrReplaceTempView("_chunk_docs")
    return spark.sql("select d.doc_id, c.seq, c.n_tokens, c.chunk from _chunk_docs d, lateral chunk_text(d.text, 400, 800, 70) c")


def chunk_tokens(spark, root):
    """Chunks with sizes in tokens of a public tokenizer."""
    return T.sliding_chunks(_docs(spark, root), "doc_id", "text", tokenizer=TOKENIZER)


def pack_blocks(spark, root):
    d = table(spark, root, "documents", "doc_id", "source", "n_chars").filter("source is not null")
    b = d.withColumn("group", F.concat_ws("/", "source", F.pmod(F.col("doc_id"), F.lit(64)).cast("string")))
    return T.pack_blocks(b, "group", "doc_id", "n_chars", 8000)


def corpus_stats(spark, root):
    """Counts by kind and quality with all totals."""
    d = table(spark, root, "documents", "doc_type", "quality", "symbol")
    return d.rollup("doc_type", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("n_symbols"), F.grouping_id().alias("level"))


def metadata_filter(spark, root):
    d = table(spark, root, "documents", "doc_id", "doc_type", "date_int")
    return d.filter(V.where(["transcript", "presentation"], date_from=20230101, date_to=20241231)).select("doc_id", "doc_type", "date_int")


def recency_gate(spark, root):
    """Newest documents: the last thirty announcements per symbol, everything else from 2022 on."""
    d = table(spark, root, "documents", "doc_id", "symbol", "doc_type", "date_int").filter("symbol is not null")
    ann = d.filter("doc_type = 'announcement'").withColumn("n", F.row_number().over(V.Window.partitionBy("symbol").orderBy(F.col("date_int").desc(), "doc_id"))).filter("n <= 30").drop("n")
    rest = d.filter("doc_type <> 'announcement' and date_int >= 20220101")
    return ann.unionByName(rest)


def latest_dates(spark, root):
    d = table(spark, root, "documents", "date_int").filter("date_int > 0").distinct()
    return d.orderBy(F.col("date_int").desc()).limit(20)


def _query_vector(spark: SparkSession, root: str) -> list[float]:
    return table(spark, root, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return e.withColumns({"grp": F.pmod(F.col("vec_id"), F.lit(20)), "day": F.pmod(F.col("vec_id"), F.lit(30))})


def vector_topk(spark, root):
    return rounded(V.top_k(_vectors(spark, root), _query_vector(spark, root), "vec_id", 8, F.col("label") < 7).select("vec_id", "label", "score"), 4)


def vector_topk_capped(spark, root):
    return rounded(V.top_k_capped(_vectors(spark, root), _query_vector(spark, root), "vec_id", "grp", 8, 1).select("vec_id", "grp", "score"), 4)


def timeline_topk(spark, root):
    return rounded(V.timeline(_vectors(spark, root), _query_vector(spark, root), "vec_id", "day", 8, 2).select("vec_id", "day", "score"), 4)


def _query_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Every vector whose number is divisible by 100 is a query."""
    return table(spark, root, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk_all(spark, root):
    s = V.top_k_all(_vectors(spark, root), _query_vectors(spark, root), "query_id", "vec_id", 8, F.col("label") < 7)
    return rounded(s.select("query_id", "vec_id", "label", "score"), 4)


def vector_topk_capped_all(spark, root):
    s = V.top_k_capped_all(_vectors(spark, root), _query_vectors(spark, root), "query_id", "vec_id", "grp", 8, 1)
    return rounded(s.select("query_id", "vec_id", "grp", "score"), 4)


def timeline_topk_all(spark, root):
    s = V.timeline_all(_vectors(spark, root), _query_vectors(spark, root), "query_id", "vec_id", "day", 8, 2)
    return rounded(s.select("query_id", "vec_id", "day", "score"), 4)


QUERIES = {f.__name__: f for f in (
    text_normalize, line_frequency, strip_page_headers, numeric_runs, letterhead_markers, leak_scrub, html_to_text, label_date, filing_year, token_stats, prose_yield,
    roster_lines, exchange_grouping, chunk_sliding, chunk_function, chunk_tokens, pack_blocks, corpus_stats, metadata_filter, recency_gate, latest_dates, vector_topk, vector_topk_capped, timeline_topk,
    vector_topk_all, vector_topk_capped_all, timeline_topk_all, numeric_parse, date_parse,
)}

_MARKERS = " + ".join(f"regexp_matches(lower(text), '{p}')::int" for p in T.LETTERHEAD)
_Q = "q as (select embedding::double[] as q from embeddings where vec_id = 0), s as (select vec_id, label, vec_id % 20 as grp, vec_id % 30 as day, list_dot_product(embedding::double[], q) as score from embeddings, q)"
_QA = """q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0),
        s as (select query_id, vec_id, label, vec_id % 20 as grp, vec_id % 30 as day, list_dot_product(embedding::double[], q) as score from embeddings, q)"""



def lines_sql(source: str, key: str) -> str:
    """Lines of one text per key, with their position."""
    return f"""d as (select {key}, any_value(text) as text from {source} where text is not null group by 1), a as (select {key}, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as a from d),
      l as (select {key}, unnest(range(len(a)))::int as pos, unnest(a) as line from a)"""


_CURRENCY = "(?:₹|rs\\.?|inr|\\$|â‚¹|â\\x{82}¹|‚çπ|‚Çπ|γé╣|Γé╣|ã¢â€šâ¹|Ã¢â€šÂ¹)"
_VALUES = f"v as (select rec_id, case when lower({_TIDY}) not in ('', '-', '--', '–', '—', 'na', 'n/a', 'n.a.', 'n.a', 'nil', 'null', 'none', 'nan') then {_TIDY} end as v from tijori)"
_DATES = (("\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%m-%d"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "%d/%m/%Y"), ("\\d{1,2}\\.\\d{1,2}\\.\\d{4}", "%d.%m.%Y"), ("\\d{1,2} [A-Za-z]{3} \\d{4}", "%d %b %Y"), ("\\d{1,2}-[A-Za-z]{3}-\\d{4}", "%d-%b-%Y"),
          ("\\d{1,2} [A-Za-z]{4,9} \\d{4}", "%d %B %Y"), ("[A-Za-z]{4,9} \\d{1,2}, \\d{4}", "%B %d, %Y"), ("[A-Za-z]{3} \\d{1,2}, \\d{4}", "%b %d, %Y"))
SQL = {
    "text_normalize": f"""with a as (select doc_id, regexp_replace(regexp_replace(text, '\\r\\n?', E'\\n', 'g'), '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}\\x{{00ad}}]', '', 'g') as x from documents),
        b as (select doc_id, replace(translate(x, '{T.ODD_SIGNS}', '   ' || chr(39) || chr(39) || chr(34) || chr(34)), '**', '') as x from a),
        c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(x, '(?m)^#+[ \\t]+', '', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', E'\\n', 'g') as x from b),
        e as (select doc_id, trim(regexp_replace(x, '\\n{{3,}}', E'\\n\\n', 'g'), ' ') as x from c) select doc_id, md5(x) as digest, length(x)::int as n_chars from e""",
    "html_to_text": """with h as (select doc_id, '<html><style>p {}</style><body><h1>T &amp; Co</h1><p>' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p><p>end</p><p>end</p></body></html>' as h from documents where text is not null),
        a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</(p|div|tr|li|h[1-6]|table)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') as x from h),
        b as (select doc_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&') as x from a),
        l as (select doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda v: trim(regexp_replace(v, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ')), lambda v: v <> '') as l from b)
        select doc_id, md5(array_to_string(list_filter(l, lambda v, i: i = 1 or v <> l[i - 1]), chr(10))) as digest from l""",
    "pack_blocks": """with recursive b as (select source || '/' || (doc_id % 64) as "group", doc_id, n_chars, row_number() over (partition by source || '/' || (doc_id % 64) order by doc_id) as n from documents where source is not null),
        r as (select "group", doc_id, n, 0 as bin, n_chars as fill from b where n = 1
          union all select b."group", b.doc_id, b.n, case when r.fill > 0 and r.fill + b.n_chars > 8000 then r.bin + 1 else r.bin end, case when r.fill > 0 and r.fill + b.n_chars > 8000 then b.n_chars else r.fill + b.n_chars end
          from r join b on b."group" = r."group" and b.n = r.n + 1) select "group", doc_id, bin from r""",
    "strip_page_headers": f"""with {lines_sql('credit_rating', 'rec_id')}, c as (select *, count(*) over (partition by rec_id, trim(line, ' ')) as n from l), k as (select * from c where trim(line, ' ') = '' or n < 3)
        select rec_id, (coalesce(sum(length(line)), 0) + greatest(count(pos) - 1, 0))::int as n_chars from d left join k using (rec_id) group by 1""",
    "numeric_runs": f"""with {lines_sql('annual_report', 'rec_id')}, n as (select *, regexp_matches(line, '^\\s*[-+]?[\\d.,%]+\\s*$') as num from l where trim(line, ' ') <> ''),
        i as (select *, sum((not num)::int) over (partition by rec_id order by pos) as island from n) select rec_id, min(pos) as first_pos, count(*) as n, count(*) >= 4 as dropped from i where num group by rec_id, island""",
    "line_frequency": """with d as (select rec_id, any_value(text) as text from annual_report group by 1), l as (select rec_id, trim(unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), E' ') as line from d)
        select rec_id, line, count(*) as n from l where line <> '' group by 1, 2 having count(*) >= 2""",
    "letterhead_markers": f"select doc_id, ({_MARKERS})::int as n_markers from documents where text is not null",
    "leak_scrub": f"""with m as (select doc_type, {_MARKERS} as n from documents where text is not null)
        select doc_type, coalesce(case when doc_type = 'announcement' then false when doc_type = 'annual_report' then n >= 3 else n >= 2 end, false) as dropped, count(*) as n from m group by 1, 2""",
    "label_date": """with d as (select distinct call_id, period from concall_transcript), x as (select call_id, lower(regexp_extract(period, '([A-Za-z]{3})[A-Za-z]*[_ -]?(20\\d{2})', 1)) as m, try_cast(regexp_extract(period, '([A-Za-z]{3})[A-Za-z]*[_ -]?(20\\d{2})', 2) as int) as y from d)
        select call_id, coalesce(case when list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], m) > 0 then y * 10000 + list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], m) * 100 + 1 end, 0)::int as date_int from x""",
    "filing_year": """select doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, '\\b(20[0-3]\\d)\\b', 1), lambda x: x::int), lambda x: x <= 2035)) as year from documents where text is not null""",
    "token_stats": """with d as (select doc_type, greatest(length(text) // 4, 1) as n from documents where text is not null) select doc_type, count(*) as n_docs, min(n)::int as least, median(n) as median, max(n)::int as most from d group by 1""",
    "prose_yield": """with d as (select rec_id, any_value(text) as text from concall_presentation group by 1), p as (select rec_id, coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: length(x) > 40), lambda x: length(x))), 0)::int as n_prose from d where text is not null)
        select rec_id, n_prose, n_prose < 2000 as image_only from p""",
    "roster_lines": """with d as (select call_id, string_agg(job, ', ' order by job) as jobs from call_roster group by 1), t as (select *, len(regexp_extract_all(lower(jobs), '\\b(officer|director|chairman|secretary|manager|head|president|analyst)\\b')) as k, len(regexp_split_to_array(trim(jobs), '\\s+')) as w from d)
        select call_id, length(jobs) < 160 and k >= 4 and k > 0.12 * w as is_roster from t""",
    "exchange_grouping": """with t as (select *, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows unbounded preceding) as exchange from events)
        select user_id, exchange::bigint as exchange, min(event_id) as "first", max(event_id) as "last", count(*) as n_turns, count(*) filter (event_type <> 'error') as n_answers from t where exchange > 0 group by 1, 2""",
    "corpus_stats": """select doc_type, quality, count(*) as n, count(distinct symbol) as n_symbols, grouping_id(doc_type, quality)::bigint as level from documents group by rollup (doc_type, quality)""",
    "metadata_filter": "select doc_id, doc_type, date_int from documents where doc_type in ('transcript', 'presentation') and date_int between 20230101 and 20241231",
    "recency_gate": """with a as (select doc_id, symbol, doc_type, date_int, row_number() over (partition by symbol order by date_int desc, doc_id) as n from documents where symbol is not null and doc_type = 'announcement')
        select doc_id, symbol, doc_type, date_int from a where n <= 30 union all select doc_id, symbol, doc_type, date_int from documents where symbol is not null and doc_type <> 'announcement' and date_int >= 20220101""",
    "latest_dates": "select distinct date_int from documents where date_int > 0 order by date_int desc limit 20",
    "vector_topk": f"with {_Q} select vec_id, label, round(score, 4) as score from s where label < 7 order by s.score desc, vec_id limit 8",
    "vector_topk_capped": f"""with {_Q}, b as (select * from s order by score desc, vec_id limit 40), r as (select *, row_number() over (partition by grp order by score desc, vec_id) as n from b)
        select vec_id, grp, round(score, 4) as score from r where n <= 1 order by r.score desc, vec_id limit 8""",
    "timeline_topk": f"""with {_Q}, d as (select distinct day from s where day > 0 order by day desc limit 8), r as (select s.*, row_number() over (partition by day order by score desc, vec_id) as n from s join d using (day))
        select vec_id, day, round(score, 4) as score from r where n <= 2""",
    "vector_topk_all": f"""with {_QA}, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s where label < 7)
        select query_id, vec_id, label, round(score, 4) as score from r where n <= 8""",
    "vector_topk_capped_all": f"""with {_QA}, b as (select *, row_number() over (partition by query_id order by score desc, vec_id) as i from s), r as (select *, row_number() over (partition by query_id, grp order by score desc, vec_id) as n from b where i <= 40),
        c as (select *, row_number() over (partition by query_id order by score desc, vec_id) as m from r where n <= 1) select query_id, vec_id, grp, round(score, 4) as score from c where m <= 8""",
    "timeline_topk_all": f"""with {_QA}, d as (select distinct day from s where day > 0 order by day desc limit 8), r as (select s.*, row_number() over (partition by query_id, day order by score desc, vec_id) as n from s join d using (day))
        select query_id, vec_id, day, round(score, 4) as score from r where n <= 2""",
    "numeric_parse": f"""with {_VALUES}, a as (select rec_id, trim(regexp_replace(regexp_replace(lower(v), '^([(\\-+ ]*){_CURRENCY}\\s*', '\\1'), '\\s*[*†‡#^]+$', '')) as y from v),
        b as (select rec_id, regexp_replace(y, '\\s*(?:cr\\.?|crores?|nos\\.?|units?|days?)$', '') as y from a), c as (select rec_id, case when y like '(%' then -1 else 1 end as sign, regexp_replace(y, '^\\(\\s*(.*?)\\s*\\)$', '\\1') as z from b)
        , d as (select rec_id, case when regexp_full_match(z, '[-+]?\\s?(\\d[\\d,]*(\\.\\d*)?|\\.\\d+)(e[-+]?\\d{{1,3}})?') then round(try_cast(regexp_replace(z, '[,\\s]', '', 'g') as double) * sign, 6) end as number from c)
        select rec_id, case when number = 0 then 0 else number end as number from d -- no negative zero""",
    "date_parse": f"""with {_VALUES} select rec_id, case {' '.join(f"when regexp_full_match(v, '{r}') then try_strptime(v, '{f}')::date" for r, f in _DATES)}
        when regexp_full_match(v, '-?\\d{{1,15}}') then date '1970-01-01' + floor(v::bigint / 86400000.0)::int end as day from v""",
}
