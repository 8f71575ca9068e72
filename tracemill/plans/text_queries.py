"""Text functions, retrieval and vector search on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import signal as S
from tracemill.functions import text as X
from tracemill.functions import values as V
from tracemill.operators import retrieval as R
from tracemill.operators import tfidf as I
from tracemill.plans.registry import Tables, long, query


@query("select doc_id, md5(text) as content_md5, sha256(text) as content_sha256, substr(sha256(doc_id::varchar), 1, 12) as short_id from documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("content_md5"), F.sha2("text", 256).alias("content_sha256"), X.deterministic_id(F.col("doc_id").cast("string")).alias("short_id"))


@query("""
with i as (select ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 4096 as b, doc_id || ':' || md5(coalesce(text, '')) as i from documents),
h as (select b, sha256(string_agg(i, '|' order by i)) as h from i group by 1)
select sha256(string_agg(h, '|' order by b)) as corpus_sha256 from h
""")
def corpus_hash(t: Tables) -> DataFrame:
    """One hash of all documents, by way of buckets."""
    return R.corpus_hash(t.documents, "doc_id", "text")


@query(r"""
select c_custkey, lower(trim(regexp_replace(regexp_replace(x, '(#\w+|\$[\d,.]+|\b\d[\d,.]*\b|''[^'']*''|"[^"]*")', '', 'g'), '\s+', ' ', 'g'))) as clean
from (select c_custkey, 'Refund of $' || c_custkey || '.50 for order #W' || c_custkey || '  to ''' || c_name || ''' must be ' || c_nationkey || ' DAYS' as x from customer)
""")
def denoise(t: Tables) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    x = F.concat(F.lit("Refund of $"), k, F.lit(".50 for order #W"), k, F.lit("  to '"), F.col("c_name"), F.lit("' must be "), F.col("c_nationkey").cast("string"), F.lit(" DAYS"))
    return t.customer.select("c_custkey", X.denoise_value(x).alias("clean"))


@query(r"""
select conv_id, turn, substr(lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '(#\w+|\$[\d,.]+|\b\d[\d,.]*\b|`[^`]*`)', ' ', 'g'), '[^a-zA-Z ]+', ' ', 'g'), '\s+', ' ', 'g'))), 1, 200) as clean from conversations
""")
def denoise_free(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.denoise_free(F.col("text")).alias("clean"))


@query("select event_id, (json_extract_string(props, '$.k'))::bigint as k, 'got ' || event_id as message from events")
def json_extract(t: Tables) -> DataFrame:
    wrapped = F.concat(F.lit('{"message": "got '), F.col("event_id").cast("string"), F.lit('"}'))
    k = F.get_json_object(X.json_in(F.concat(F.lit("text before "), F.col("props"), F.lit(" after"))), "$.k")
    return t.events.select("event_id", k.cast("long").alias("k"), X.unwrap_message(wrapped).alias("message"))


@query("select doc_id as doc, len(regexp_extract_all(lower(text), '\\bth\\w*e\\b'))::double as score from documents where score > 0")
def grep_count(t: Tables) -> DataFrame:
    return R.grep(t.documents, "doc_id", "text", r"\bth\w*e\b")


@query("select doc_id as doc, (length(text) - length(replace(text, '***', ''))) / 3.0 as score from documents where contains(text, '***') order by 2 desc, 1 limit 10")
def grep_literal(t: Tables) -> DataFrame:
    return R.grep(t.documents, "doc_id", "text", "***", 10)


_BM25 = r"""
tok as (select doc_id as doc, list_filter(regexp_split_to_array(lower(text), '[\s\x0b]+'), lambda x: x <> '') as ts from documents),
dl as (select doc, len(ts) as dl from tok), p as (select doc, term, count(*) as tf from (select doc, unnest(ts) as term from tok) group by 1, 2),
n as (select count(*) as n, avg(dl) as avgdl from dl), df as (select term, count(*) as df from p group by 1),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, n), m as (select avg(raw) as mean from raw),
idf as (select term, case when raw < 0 then mean * 0.25 else raw end as idf from raw, m),
q as (select item_id as query, term, count(*) as qtf from (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\x0b]+'), lambda x: x <> '')) as term from benchmark where item_id % 50 = 0) group by 1, 2),
s as (select query, p.doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from q join idf using (term) join p using (term) join dl on dl.doc = p.doc cross join n group by 1, 2),
r as (select *, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from s)
"""


@query(f"with {_BM25} select query, doc, round(score, 6) as score, rank from r where rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    d = R.bm25_top_k(t.documents.select("doc_id", "text"), t.benchmark.where("item_id % 50 = 0"), 10, "doc_id", "text", "item_id", "text")
    return d.select("query", "doc", F.round("score", 6).alias("score"), long("rank").alias("rank"))


_COS = """
e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
c as (select q.vec_id as query, d.vec_id as doc, round(list_cosine_similarity(q.v, d.v), 6) as score from e q, e d where q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by query order by score desc, doc desc) as rank from c)
"""


@query(f"with {_COS} select query, doc, score, rank from k where rank <= 10")
def cosine_topk(t: Tables) -> DataFrame:
    d = R.cosine_top_k(t.embeddings, "vec_id", "embedding", t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return d.select("query", "doc", F.round("score", 6).alias("score"), long("rank").alias("rank"))


@query(f"""
with {_BM25}, {_COS}, u as (select query, doc, round(score, 6) as score from r where rank <= 10 union all select query, doc, score from k where rank <= 10), g as (select query, doc, max(score) as score from u group by 1, 2),
f as (select *, row_number() over (partition by query order by score desc, doc) as rank from g) select * from f where rank <= 12
""")
def fusion_max(t: Tables) -> DataFrame:
    a, b = bm25_topk(t), cosine_topk(t)
    return R.fuse_max(a, b, k=12).select("query", "doc", "score", long("rank").alias("rank"))


@query(f"""
with {_COS}, s as (select query, doc, least(10.0, greatest(0.0, score * 12 - 1)) as score from k where rank <= 10),
f as (select *, row_number() over (partition by query order by score desc, doc) as rank from s where score >= 2) select query, doc, round(score, 6) as score, rank from f where rank <= 5
""")
def rerank_topk(t: Tables) -> DataFrame:
    base = cosine_topk(t)
    scores = base.select("query", "doc", (F.col("score") * 12 - 1).alias("score"))
    docs = t.embeddings.select("vec_id", F.lit("content").alias("text"))
    return R.rerank(base, scores, docs, "vec_id", "text", 2.0, 5).select("query", "doc", F.round("score", 6).alias("score"), long("rank").alias("rank"))


@query("select doc_id, doc_id % 3 = 0 as cached from documents")
def cache_split(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    cache = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("old")).alias("content_md5"))
    hit, miss = R.cache_split(docs, cache, "doc_id", "text")
    return hit.select("doc_id", F.lit(True).alias("cached")).unionByName(miss.select("doc_id", F.lit(False).alias("cached")))


_TFIDF = """
with d as (select doc_id as doc, list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b]+'), lambda x: x <> '') as ts from documents),
u as (select doc, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) as term from d),
tf as (select doc, term, count(*) as tf from u group by 1, 2), df as (select term, count(*) as df from tf group by 1),
w as (select doc, term, tf * (ln((select count(*) from documents) + 1) - ln(df + 1) + 1) as w from tf join df using (term)), nm as (select doc, sqrt(sum(w * w)) as nm from w group by 1),
x as (select doc, term, w / nm as weight from w join nm using (doc))
"""


@query(_TFIDF + "select a.doc as query, b.doc, round(sum(a.weight * b.weight), 6) as score from x a join x b using (term) where a.doc <> b.doc and a.doc % 50 = 0 group by 1, 2")
def tfidf_cosine(t: Tables) -> DataFrame:
    return I.cosines(t.documents, "doc_id", "text", F.col("doc_id") % 50 == 0, 6)


@query(r"""
with d as (select item_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0b]+'), lambda x: x <> '') as ts from benchmark), w as (select item_id, ' ' || unnest(ts) || ' ' as p from d),
g as (select item_id, unnest(list_transform(range(1, greatest(1, length(p) - n + 1) + 1), lambda i: substr(p, i, n))) as g from w, (select unnest([3, 4, 5]) as n) where n = 3 or length(p) >= n)
select item_id, count(*) as grams, count(distinct g) as different from g group by 1
""")
def char_grams(t: Tables) -> DataFrame:
    d = t.benchmark.select("item_id", F.explode(X.char_grams(R.tokens(F.col("text")), 3, 5)).alias("g"))
    return d.groupBy("item_id").agg(F.count("*").alias("grams"), F.count_distinct("g").alias("different"))


@query("select o_orderkey, 'update(' || 'id=' || o_orderkey || ', status=' || o_orderstatus || ')' as written, o_orderkey::varchar as id, o_orderstatus as status from orders")
def call_codec(t: Tables) -> DataFrame:
    args = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"))
    d = t.orders.select("o_orderkey", X.call_text(F.lit("update"), args).alias("written")).withColumn("c", X.call_parse(F.col("written")))
    return d.select("o_orderkey", "written", F.col("c.arguments")["id"].alias("id"), F.col("c.arguments")["status"].alias("status"))


@query(r"""
select item_id, case when length(s) > 60 then substr(s, 1, 60) || '…' else s end as snippet, case when length(trim(text)) > 50 then rtrim(substr(trim(text), 1, 50)) || ' …(+' || (length(trim(text)) - 50) || ' chars)' else trim(text) end as cut,
  case when length(text) > 40 then rtrim(substr(text, 1, 26)) || chr(10) || '… (' || (length(text) - 40) || ' chars elided) …' || chr(10) || ltrim(right(text, 14)) else text end as middle
from (select item_id, text, replace(trim(text), chr(10), ' ') as s from benchmark)
""")
def snippets(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", X.snippet(F.col("text"), 60).alias("snippet"), X.truncate(F.col("text"), 50).alias("cut"), X.truncate_middle(F.col("text"), 40).alias("middle"))


@query("""
select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped, length(html) as n from pages
""")
def html_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.html_escape(F.col("html")).alias("escaped"), long(F.length("html")).alias("n"))


@query("select c_custkey, contains(replace(lower(c_name || ', 1,000 units'), ',', ''), lower('1000 UNITS')) as plain, contains(replace(lower(c_name || ', 1,000 units'), ',', ''), '1,000') as comma from customer")
def communicate_check(t: Tables) -> DataFrame:
    said = F.array(F.concat(F.col("c_name"), F.lit(", 1,000 units")))
    return t.customer.select("c_custkey", X.mentions(said, F.lit("1000 UNITS")).alias("plain"), X.mentions(said, F.lit("1,000")).alias("comma"))


@query(r"select conv_id, count(*) filter (where regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(the|le|der|los)([^\p{L}\p{N}_]|$)')) as hits from conversations where role = 'user' group by 1")
def confirm_phrases(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.count_if(X.confirms(F.col("text"), ("the", "le", "der", "los"))).alias("hits"))


@query("""
select conv_id, turn, (ceil(length(text) / 100.0))::bigint as parts, text as joined, substr(text, 1, (length(text) // 3 + case when length(text) % 3 > 0 then 1 else 0 end)::bigint) as first_third from conversations
""")
def text_chunks(t: Tables) -> DataFrame:
    c = V.chunks(F.col("text"), 100)
    return t.conversations.select("conv_id", "turn", long(F.size(c)).alias("parts"), F.array_join(c, "").alias("joined"), F.get(V.n_chunks(F.col("text"), 3), F.lit(0)).alias("first_third"))


@query("""
with x as (select conv_id, turn, text, (turn // 3)::varchar as id, lag((turn // 3)::varchar) over (partition by conv_id order by turn) as b from conversations)
select conv_id, string_agg(case when b is not null and b <> id then ' ' else '' end || text, '' order by turn) as text from x group by 1
""")
def merge_chunks(t: Tables) -> DataFrame:
    chunk = F.struct("turn", "text", F.array(F.floor(F.col("turn") / 3).cast("string")).alias("ids"))
    d = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(chunk)).alias("cs"))
    return d.select("conv_id", X.merge_chunks(F.transform("cs", lambda c: F.struct(c["text"].alias("text"), c["ids"].alias("ids")))).alias("text"))


@query("""
select o_orderkey, last_day(o_orderdate::date) as cycle_end, case when month(o_orderdate) = 12 then make_date(year(o_orderdate), 1, 1) - 1 else last_day(o_orderdate::date) end as same_year,
       strftime(o_orderdate::date + 1, '%Y-%m-%d') as next_day, strftime(o_orderdate, '%Y-%m-') || (day(o_orderdate) + 1) as unpadded, greatest(0, date_diff('day', o_orderdate::date, date '2026-01-01')) * 1 as age, 0 as bad_age from orders
""")
def date_arithmetic(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    age = V.age_days(F.date_format("o_orderdate", "MM/dd/yyyy"), "2026-01-01")
    return t.orders.select(
        "o_orderkey", V.cycle_end(day).alias("cycle_end"), V.cycle_end(day, True).cast("date").alias("same_year"), V.next_day_text(text).alias("next_day"), V.next_day_text(text, False).alias("unpadded"),
        long(F.greatest(F.lit(0), age)).alias("age"), V.age_days(F.lit("soon"), "2026-01-01").alias("bad_age"),
    )


@query("""
select event_id, case when value < 20 then false when value >= 60 then true else event_id % 10 / 10.0 < (value - 20) / 40.0 end as ramp, event_id % 10 / 10.0 < 1 - exp(-0.02 * value) as poisson,
       greatest(0.0, least(10.0, value / 5 - 3)) as clamped, greatest(1, floor(value / 0.2))::bigint as ticks from events
""")
def probability_rules(t: Tables) -> DataFrame:
    draw, v = F.col("event_id") % 10 / 10.0, F.col("value")
    return t.events.select("event_id", V.ramp(v, 20, 40, draw).alias("ramp"), V.poisson_trigger(F.lit(0.02), v, draw).alias("poisson"), V.clamp(v / 5 - 3).alias("clamped"), V.ticks(v, 0.2).alias("ticks"))


@query("""
select event_id, round((sin(value * 2 * pi() * 0.5) * 0.6 + sin(value * 2.3 * 2 * pi() * 0.5) * 0.3 + sin(value * 0.37 * 2 * pi() * 0.5) * 0.1) * 3 + 15, 6) as snr from events
""")
def snr_envelope(t: Tables) -> DataFrame:
    """The level of noise at the time of each event."""
    return t.events.select("event_id", F.round(S.snr_envelope(F.col("value"), 0.5, 15.0, 3.0, (0.6, 1.0), (0.3, 2.3), (0.1, 0.37)), 6).alias("snr"))


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double * 1000) as a from embeddings)
select vec_id, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 6) as rms, list_sum(list_transform(a, lambda x: trunc(greatest(-32768, least(32767, x * 1.5)))::bigint))::bigint as mixed from v
""")
def audio_levels(t: Tables) -> DataFrame:
    a = F.transform("embedding", lambda x: x.cast("double") * 1000)
    total = F.aggregate(S.mix(a, a, 0.5), F.lit(0).cast("long"), lambda s, x: s + x)
    return t.embeddings.select("vec_id", F.round(S.rms(a), 6).alias("rms"), total.alias("mixed"))


@query("""
with x as (select event_id, value::double / 600 as loss, 20.0::double + event_id % 500 as burst from events)
select event_id, round(1000 / burst, 6) as r_rate, round(case when loss < 0.2 and loss >= 0 then 1000 / burst * loss / (0.2::double - loss) end, 6) as p_rate, round(case when loss < 0.2 and loss >= 0 then loss / 0.2::double end, 6) as bad_share from x
""")
def loss_model(t: Tables) -> DataFrame:
    """Rates of the two-state loss model, for a loss and a length of bursts a row."""
    m = S.loss_rates(F.col("value") / 600, F.lit(20.0) + F.col("event_id") % 500)
    return t.events.select("event_id", *[F.round(m[c], 6).alias(c) for c in ("r_rate", "p_rate", "bad_share")])


@query("""
with d as (select doc_id, '# ' || doc_id || chr(10) || text as t from documents where text is not null),
r as (select *, sum(length(t)) over (order by doc_id, t rows unbounded preceding) as z from d)
select ((z - length(t)) // 1000000)::bigint as part, string_agg(t, chr(10) || chr(10) order by z) as knowledge_base from r group by 1
""")
def knowledge_base_text(t: Tables) -> DataFrame:
    """All documents as one text, in parts of a million characters."""
    return R.full_text(t.documents.withColumn("title", F.col("doc_id").cast("string")), "doc_id", "title", "text", 1_000_000)
