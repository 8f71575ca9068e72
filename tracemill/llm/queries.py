"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import chat, decontaminate, embeddings, html_text, langid, mixing, pii, quality, quality_rules, ranked_search, sharding, simhash, whitening
from tracemill.llm.common import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # The result holds no texts, so they are measured once and left behind.
    measured = cut(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), mixing.letter_share(F.col("text")).alias("letters")))
    out = mixing.mix_sources(measured, size=F.col("words"), quality=F.col("letters"), weights=(1, 2, 3), cap=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = embeddings.embedding_clusters(vectors, threshold=0.9)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_text.extract_text(pages, F.col("html"), page_id=F.col("page_id"), url=F.col("url"))
    return out.select("page_id", "url", "text", html_text.char_count(F.col("text")).alias("n_chars"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_clusters(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.personal_data(docs, F.col("text"), doc_id=F.col("doc_id"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it leaks; ``match_end`` counts in the normalised text (words joined by single spaces)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance", "match_end")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.chat_digest(chat.chat_windows(turns, stride=512, history=128))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = sharding.shard_rows(docs, 40, keys=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _remainder(n: int) -> Column:
    """crc32 of the document id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(_remainder(4) != 2), F.col("doc_id"), F.col("text"), F.col("lang"))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    return langid.identify(docs, model, F.col("text"), doc_id=F.col("doc_id"), held_out=held_out)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = quality.learn(docs, labels.where(_remainder(5) != 0))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    out = quality.score(docs, net, F.col("text"), doc_id=F.col("doc_id"), held_out=held_out)
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ranked_search.ranked(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, k=4).withColumnRenamed("id", "vec_id")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs, keep=["doc_id"])


QUERIES = {f.__name__: f for f in (op1_mixing, op2_embedding_dedup, op3_html_text, op4_simhash, op5_pii, op6_decontamination, op7_chat_format, op8_sharding, op9_language, op10_quality, op11_ranked_search, op12_whitening, op13_quality_rules)}

ORACLES = {
    "op1_mixing": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         case when length(text) > 0
              then greatest(0.1, 1.0::double - length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g'))::double / length(text)::double)
              else 0.1::double end as q
  from documents),
k as (
  select *, -ln((('0x' || substr(md5('11|' || coalesce(doc_id::varchar, '') || '|' || size::varchar), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double) / q as key
  from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (
  select *, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as w,
         source_size::double * 3.0::double as most, sum(source_size) over ()::double as total
  from s),
c as (
  select *, row_number() over o as pos, sum(most) over (o rows unbounded preceding) - most as spent,
         sum(w) over (o rows between current row and unbounded following) as w_left
  from w window o as (order by most / w, source is null, source)),
l as (select *, (total - spent) / w_left as level from c),
f as (select min(pos) as pos, arg_min(level, pos) as level from l where most / w > level),
t as (
  select l.source, l.source_size, case when f.pos is null or l.pos < f.pos then l.most else f.level * l.w end as target
  from l, f),
p as (
  select k.doc_id, k.size, t.source_size, t.target, k.key,
         case when t.source_size > 0 then least(3, floor(t.target / t.source_size))::bigint else 0 end as epochs,
         sum(k.size) over (partition by k.source order by k.key, k.doc_id rows unbounded preceding) - k.size as before
  from k join t on k.source is not distinct from t.source),
r as (
  select *, epochs + case when epochs < 3 and size > 0 and 2 * before + size <= 2 * (target - epochs * source_size) then 1 else 0 end as repeats
  from p)
select doc_id, size, source_size, target, (repeats * size)::bigint as taken, repeats::bigint as repeats from r
""",
    "op2_embedding_dedup": r"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by 1),
n as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on c.a = vec_id left join n on n.a = vec_id
""",
    "op8_sharding": r"""
with recursive t as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: case when x % 2 = 1 then xor(3988292384, x >> 1) else x >> 1 end)) as t),
y as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
z as (select doc_id, length(h) // 2 + 16 as size, list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)) as b from y),
d as (select doc_id, size::bigint as size, xor(list_reduce(b, lambda x, k: xor(t[(xor(x, k) & 255) + 1], x >> 8)), 4294967295)::bigint as crc from z, t),
c as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || size || '|' || crc), 1, 12))::bigint as h from d),
n as (select count(*) as n, greatest(64, least(1048576, count(*) // 2000)) as buckets from c),
r as (select c.*, row_number() over (order by h % buckets, h, doc_id nulls first, size, crc) - 1 as number, n.n, ceil(sqrt(n.n))::bigint as a from c, n),
s as (select *, (n + a - 1) // a as b from r),
w(doc_id, size, crc, number, n, a, b, step, l, r, done) as (
  select doc_id, size, crc, number, n, a, b, 0, number // b, number % b, false from s
  union all
  select doc_id, size, crc, number, n, a, b, (step + 1) % 6,
         case when step % 2 = 0 then (l + ('0x' || substr(md5('7|' || step || '|' || r), 1, 12))::bigint % a) % a else l end,
         case when step % 2 = 1 then (r + ('0x' || substr(md5('7|' || step || '|' || l), 1, 12))::bigint % b) % b else r end,
         step = 5 and case when step % 2 = 0 then 0 else l * b + (r + ('0x' || substr(md5('7|' || step || '|' || l), 1, 12))::bigint % b) % b end < n
  from w where not done),
p as (select doc_id, size, crc, l * b + r as p from w where done)
select doc_id, size, crc as text_crc32, 'rows' as law, (p % 40)::int as shard, (p // 40)::bigint as slot, null::int as grown_shard from p
""",
    "op7_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, (ceil(length(text) / 4.0) + 4)::bigint as n,
         length(replace(replace(replace(replace(role || text, '\', '\e'), '<', '\l'), '[', '\b'), '|', '\p')) + 10 as w
  from t),
p as (
  select *, row_number() over o as pos, sum(n) over (o rows unbounded preceding) - n as start
  from e window o as (partition by conv_id order by turn nulls first, role, text)),
s as (
  select *, (start // 512)::bigint as span, min(pos) filter (where role = 'system') over (partition by conv_id) as system_pos from p),
x as (
  select *, min(start) over (partition by conv_id order by span range between 1 following and unbounded following) as next_start,
         dense_rank() over (partition by conv_id order by span) as rank,
         row_number() over (partition by conv_id, span order by pos) as nth,
         max(case when pos = system_pos then w end) over (partition by conv_id) as system_w
  from s)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
       (sum(w) + sum(case when next_start is not null and start >= next_start - 128 and pos is distinct from system_pos then w else 0 end)
        + sum(case when nth = 1 and rank > 1 and system_pos < pos then system_w else 0 end))::bigint as formatted_chars,
       max(rank)::int as n_windows
from x group by conv_id
""",
    "op11_ranked_search": r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents),
s as (select count(*) as docs, sum(len(t))::bigint as terms from d where len(t) > 0),
q as (
  select row_number() over () as q, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from benchmark),
qt as (select q, item_id, term, count(*) as times from (select q, item_id, unnest(t) as term from q) group by all),
tf as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(t) as n, unnest(t) as term from d) where term in (select term from qt) group by all),
w as (select term, floor(1000.0::double * ln((2 * any_value(s.docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by 1),
x as (
  select q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * s.docs) // s.terms))))::bigint as score
  from qt join tf using (term) join w using (term), s group by all),
k as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
""",
    "op13_quality_rules": r"""
with d as (
  select row_number() over () as r, doc_id, lang, coalesce(text, '') as text, length(coalesce(text, '')) as chars,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t,
         string_split(coalesce(text, ''), chr(10)) as lines
  from documents),
e as (
  select *, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as full_lines,
         [length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')),
          length(regexp_replace(text, '[^.,;:!?''\x22()\x2D]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g')),
          length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F#$%&*+/<=>@\x5B-\x60{|}~\x7F]', '', 'g')),
          chars - length(array_to_string(w, ''))] as c
  from d),
f as (select *, list_append(c, chars - list_sum(c)::bigint) as classes from e),
win as (select r, i, array_to_string(w[i + 1:i + 5], ' ') as x from (select r, w, unnest(range(len(w) - 4)) as i from d where len(w) >= 5)),
twice as (select r, x from win group by 1, 2 having count(*) > 1),
again as (select r, count(distinct p) as n from (select r, i + unnest(range(5)) as p from win join twice using (r, x)) group by 1),
terms as (select lang, unnest(t) as term from d where lang is not null),
seen as (select lang, term, count(*) as n from terms group by 1, 2),
ranked as (select *, row_number() over (partition by lang order by n desc, term) as k, sum(n) over (partition by lang)::double as total from seen),
common as (select lang, term, k, n / total as q from ranked where k <= 24),
rest as (select lang, greatest(1.0::double - sum(q), 0) as q from common group by 1),
shares as (select lang, k, (1000 * classes[k]) // chars as share from f, range(1, 8) as x(k) where lang is not null and chars > 0),
counted as (
  select lang, k, share, sum(count(*)) over (partition by lang, k order by share) as up_to, sum(count(*)) over (partition by lang, k) as docs
  from shares group by 1, 2, 3),
median as (select lang, k, min(share)::double as m from counted where 2 * up_to >= docs and docs >= 20 group by 1, 2),
class_ref as (select lang, k, m / sum(m) over (partition by lang) as q from median),
class_pairs as (select r, classes[k] / chars::double as p, q from f join class_ref using (lang) where chars >= 100),
hits as (select r, term, count(*) as n from (select r, lang, unnest(t) as term from d where len(t) >= 100 and chars >= 100) join common using (lang, term) group by 1, 2),
long as (select r, lang, len(t) as n from d where len(t) >= 100 and chars >= 100),
term_pairs as (
  select r, coalesce(h.n, 0) / l.n::double as p, c.q from long l join common c using (lang) left join hits h using (r, term)
  union all
  select l.r, (l.n - coalesce(h.n, 0)) / l.n::double, q from long l join rest using (lang) left join (select r, sum(n) as n from hits group by 1) h using (r)),
class_far as (
  select r, sqrt(greatest(sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end) / 2 / ln(2), 0)) as far
  from class_pairs group by 1),
term_far as (
  select r, sqrt(greatest(sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end) / 2 / ln(2), 0)) as far
  from term_pairs group by 1),
out as (
  select f.*, len(w)::bigint as n_words, coalesce(a.n, 0)::bigint as n_repeat_words, x.far as x_far, y.far as y_far,
         len(w) < 10 or 100 * coalesce(a.n, 0) > 20 * len(w) as base_failed
  from f left join again a using (r) left join class_far x using (r) left join term_far y using (r))
select doc_id, n_words, word_chars, n_symbols, (len(full_lines) - len(list_distinct(full_lines)))::bigint as n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(x_far > 0.17::double + 20.0::double / chars, false) and not coalesce(y_far > 0.3::double + 10.0::double / len(t), false) as kept,
       round(x_far, 6) as chars_distance, round(y_far, 6) as terms_distance
from out
""",
}
