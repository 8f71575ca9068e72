"""Evaluation, reporting feeds, projections and the configurable retrieval pipeline on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators import clustering as C
from tracemill.operators import evaluate as E
from tracemill.operators import projection as P
from tracemill.operators import reports as Y
from tracemill.plans import registries as G
from tracemill.plans.registry import Tables, long, query


@query("""
with l as (select l_orderkey, l_linenumber % 3 as name, l_suppkey % 5 as a from lineitem)
select l_orderkey, bool_or(name = 0 and a = 1) as first, bool_or(name = 1) as second, case when bool_or(name = 0 and a = 1) and bool_or(name = 1) then 1.0 else 0.0 end::double as reward from l group by 1
""")
def action_evaluator(t: Tables) -> DataFrame:
    call = F.struct((F.col("l_linenumber") % 3).cast("string").alias("name"), F.create_map(F.lit("a"), (F.col("l_suppkey") % 5).cast("string"), F.lit("noise"), F.col("l_linenumber").cast("string")).alias("arguments"))
    d = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(call).alias("calls"))
    gold = lambda n, a, c: F.struct(F.lit(n).alias("name"), F.create_map(F.lit("a"), F.lit(a)).alias("arguments"), F.array(*[F.lit(x) for x in c]).cast("array<string>").alias("compare_args"))
    d = E.action_checks(d.withColumn("gold", F.array(gold("0", "1", ["a"]), gold("1", "", []))), "gold", "calls")
    from tracemill.operators.metrics import all_true

    return d.select("l_orderkey", F.col("action_match")[0].alias("first"), F.col("action_match")[1].alias("second"), all_true(F.col("action_match")).alias("reward"))


@query(r"""
with m as (select conv_id, bool_or(contains(lower(replace(text, ',', '')), 'the')) filter (where role = 'assistant') as a, bool_or(contains(lower(replace(text, ',', '')), 'que de')) filter (where role = 'assistant') as b from conversations group by 1)
select conv_id, coalesce(a, false) as first, coalesce(b, false) as second from m
""")
def communicate_evaluator(t: Tables) -> DataFrame:
    said = F.collect_list(F.when(F.col("role") == "assistant", F.col("text")))
    d = t.conversations.groupBy("conv_id").agg(said.alias("said")).withColumn("info", F.array(F.lit("THE"), F.lit("Que de")))
    d = E.communicate_checks(d, "info", "said")
    return d.select("conv_id", F.col("communicate_met")[0].alias("first"), F.col("communicate_met")[1].alias("second"))


@query("""
with x as (select o_orderkey as run_id, o_orderkey % 7 = 0 as early, o_orderkey % 5 <> 0 as db, o_orderkey % 3 <> 0 as act, o_orderkey % 4 <> 0 as nl, o_orderkey % 2 as basis, o_orderkey % 11 = 0 as none from orders)
select run_id, case when early then 0.0 when none then 1.0 else db::int * (case when basis = 0 then 1 else act::int end) * (case when basis = 0 then nl::int else 1 end) end::double as reward_all,
       case when early then 0.0 when none then 1.0 else act::int end::double as reward_action, case when early then 0.0 when none then 1.0 else (db and act and nl)::int end::double as reward_all_with_nl_assertions_ignore_basis from x
""")
def evaluation_kinds(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    one = lambda c: F.array(c)
    basis = F.when(k % 11 == 0, F.lit(None).cast("array<string>")).when(k % 2 == 0, F.array(F.lit("DB"), F.lit("NL_ASSERTION"))).otherwise(F.array(F.lit("DB"), F.lit("ACTION")))
    d = t.orders.select(
        k.alias("run_id"), F.when(k % 7 == 0, "max_steps").otherwise("user_stop").alias("termination_reason"), basis.alias("reward_basis"), (k % 5 != 0).alias("db_match"),
        F.array().cast("array<boolean>").alias("env_met"), one(k % 3 != 0).alias("action_match"), F.lit(None).cast("array<boolean>").alias("communicate_met"), one(k % 4 != 0).alias("nl_met"),
    )
    return E.reevaluate(d, ["all", "action", "all_with_nl_assertions_ignore_basis"]).select("run_id", "reward_all", "reward_action", "reward_all_with_nl_assertions_ignore_basis")


@query("""
with c as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('click', 'purchase')) select user_id, n, event_id::varchar as call_id, 'r' || event_id as content from c
""")
def call_result_zip(t: Tables) -> DataFrame:
    e = t.events.where(F.col("event_type").isin("click", "purchase"))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    i = F.col("event_id").cast("string")
    e = e.withColumn("p", pos)
    calls = e.select(F.col("user_id").alias("run_id"), (F.col("p") * 2).alias("pos"), F.lit("assistant").alias("role"), F.array(F.struct(i.alias("id"), F.col("event_type").alias("name"))).alias("calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("content"))
    got = e.select(F.col("user_id").alias("run_id"), (F.col("p") * 2 + 1).alias("pos"), F.lit("tool").alias("role"), F.lit(None).cast(calls.schema["calls"].dataType).alias("calls"), i.alias("tool_call_id"), F.concat(F.lit("r"), i).alias("content"))
    d = E.call_results(calls.unionByName(got))
    return d.where(F.col("name").isNotNull()).select(F.col("run_id").alias("user_id"), long("n").alias("n"), "call_id", "content")


@query("""
with x as (select conv_id, turn, text, case when turn % 4 = 3 then null else turn // 2 end as id from conversations),
y as (select *, last_value(id ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as held from x),
z as (select *, sum(case when id is not null and held is not null and id <> held then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as m from y)
select conv_id, count(distinct m) as messages, sum(length(text))::bigint as chars from z group by 1
""")
def utterance_messages(t: Tables) -> DataFrame:
    ids = F.when(F.col("turn") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.floor(F.col("turn") / 2).cast("string")))
    d = E.spoken(t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), "text", ids.alias("ids")))
    return d.select(F.col("run_id").alias("conv_id"), long(F.size("said")).alias("messages"), long(F.aggregate("said", F.lit(0), lambda a, m: a + F.length(m))).alias("chars"))


@query("""
select doc_id, case when quality = 1 then 'pass' when doc_id % 2 = 0 then 'c_' || doc_id % 5 else '' end as cluster_id from labels
""")
def runs_with_clusters(t: Tables) -> DataFrame:
    f = t.labels.select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("db_only").alias("failure_type"))
    a = t.labels.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("c_"), (F.col("doc_id") % 5).cast("string")).alias("cluster_id"))
    return Y.runs_with_clusters(f, a, "doc_id").select("doc_id", "cluster_id")


@query("""
select c_custkey, case when c_acctbal <= 2000 then null when c_nationkey % 3 > 0 and c_nationkey % 2 = 0 then 'VAD-MISS' when c_nationkey % 3 = 0 then 'NO-USER' else 'OTHER' end as flag from customer
""")
def outlier_flags(t: Tables) -> DataFrame:
    d = t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("silence"), (F.col("c_nationkey") % 3 > 0).alias("user_audio"), (F.col("c_nationkey") % 2 == 1).alias("detected"))
    return Y.outlier_report(d).select("c_custkey", "flag")


@query("""
select event_id, array_to_string(list_filter([case when event_type <> 'error' and event_id % 10 / 10.0 < 1 - exp(-0.5 * 0.4) then 'burst_noise' end, case when event_type = 'view' and event_id % 7 / 7.0 < 1 - exp(-0.9 * 0.4) then 'out_of_turn_speech' end, case when event_id % 13 = 0 then 'frame_drop' end], lambda x: x is not null), ',') as effects from events
""")
def effect_schedule(t: Tables) -> DataFrame:
    d = t.events.select("event_id", F.lit(0.4).alias("seconds"), (F.col("event_type") == "view").alias("is_silence"), (F.col("event_type") == "error").alias("burst_active"))
    i = F.col("event_id")
    return Y.schedule_effects(d, 0.5, 0.9, i % 10 / 10.0, i % 7 / 7.0, i % 13 == 0).select("event_id", F.array_join("effects", ",").alias("effects"))


@query("select event_id, round(floor(value * 4) / 160, 4) as fill, case when floor(value * 4) = 0 then 'silent' when floor(value * 4) < 160 then 'short' when floor(value * 4) = 160 then 'whole' else 'long' end as state from events")
def tick_audio(t: Tables) -> DataFrame:
    return Y.tick_audio(t.events.select("event_id", F.floor(F.col("value") * 4).alias("bytes")), 160).select("event_id", "fill", "state")


@query("""
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from embeddings),
m as (select label, k, avg(x) as x from p group by 1, 2), c as (select label, list(x order by k) as c from m group by 1)
select a.label as a, b.label as b, round(list_cosine_similarity(a.c, b.c), 6) as cosine from c a join c b on a.label < b.label
""")
def centroid_similarity(t: Tables) -> DataFrame:
    return P.centroid_similarity(t.embeddings, "label", "embedding").withColumn("cosine", F.round("cosine", 6))


@query()
def pca_2d(t: Tables) -> DataFrame:
    return P.pca2(t.embeddings, "vec_id", "embedding")


@query()
def latent_space(t: Tables) -> DataFrame:
    return P.latent(t.embeddings, "vec_id", "embedding", 8)


@query()
def cluster_sweep(t: Tables) -> DataFrame:
    """Thresholds by structure, and the best sane one."""
    cuts = C.cluster_groups(t.embeddings, "vec_id", "embedding", "label", (0.3, 0.5, 0.7, 0.9))
    sizes = cuts.groupBy(F.col("threshold").alias("distance"), "label", "cluster").agg(F.count("*").alias("n"))
    grid = C.structure_of_sizes(sizes, "distance").withColumn("score", -F.abs(F.col("mean_size") - 5.0))
    return C.best_setting(grid, "score")


@query("""
select 'a' as switch, avg(value) filter (where event_id % 2 = 0) - avg(value) filter (where event_id % 2 = 1) as delta from events union all select 'b', avg(value) filter (where event_id % 3 = 0) - avg(value) filter (where event_id % 3 > 0) from events
""")
def ablation_deltas(t: Tables) -> DataFrame:
    d = t.events.select((F.col("event_id") % 2 == 0).alias("a"), (F.col("event_id") % 3 == 0).alias("b"), "value")
    return C.marginal(d, ["a", "b"], "value")


@query()
def retrieval_pipeline(t: Tables) -> DataFrame:
    config = {"document_preprocessors": [{"type": "bm25_indexer"}], "retrievers": [{"type": "bm25", "params": {"top_k": 5}}, {"type": "grep", "params": {"top_k": 5}}]}
    p = G.RetrievalPipeline(config)
    p.index(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return p.retrieve(t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text"), top_k=6)
