"""States, scripts, recordings and run features on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import blocks as B
from tracemill.functions import canonical as N
from tracemill.functions import gold as G
from tracemill.functions import signal as S
from tracemill.operators import clustering as C
from tracemill.operators import guards as GD
from tracemill.operators import reports as RP
from tracemill.operators import statediff as SD
from tracemill.operators import traces as TR
from tracemill.plans.registry import Tables, long, query


@query("""
with s as (select o_orderkey, '{"bills": [{"due": ' || o_totalprice::varchar || ', "id": "B' || o_orderkey || '"}, null], "day": "' || strftime(o_orderdate, '%Y-%m-%d') || '", "n": ' || (o_orderkey % 5)::varchar || ', "name": "' ||
  case o_orderkey % 4 when 0 then 'caf\\u00e9 \\"x\\"' when 1 then '\\ud83d\\ude00\\n' when 2 then 'a\\\\b' else 'plain' end || '", "open": ' || case when o_orderstatus = 'O' then 'true' else 'false' end || ', "share": ' || case o_orderkey % 3 when 0 then '1e-07' when 1 then '0.1' else '1e+16' end ||
  ', "tags": {"' || o_orderpriority || '": 1, "A": null}}' as j from orders)
select o_orderkey, j as canonical, sha256(j) as hash from s
""")
def canonical_states(t: Tables) -> DataFrame:
    """Nested states as canonical JSON, and their hash."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, 'caf\u00e9 "x"').when(k % 4 == 1, "\U0001f600\n").when(k % 4 == 2, "a\\b").otherwise("plain")
    share = F.when(k % 3 == 0, 1e-7).when(k % 3 == 1, 0.1).otherwise(1e16)
    bill = F.struct(F.concat(F.lit("B"), k.cast("string")).alias("id"), F.col("o_totalprice").alias("due"))
    tags = F.map_from_arrays(F.array(F.lit("A"), F.col("o_orderpriority")), F.array(F.lit(None).cast("int"), F.lit(1)))
    state = F.struct(name.alias("name"), (F.col("o_orderstatus") == "O").alias("open"), (k % 5).alias("n"), share.alias("share"), F.array(bill, F.lit(None)).alias("bills"), F.col("o_orderdate").cast("date").alias("day"), tags.alias("tags"))
    d = t.orders.select("o_orderkey", state.alias("state"))
    return d.select("o_orderkey", N.canonical_json("state").alias("canonical"), N.canonical_hash(F.col("state")).alias("hash"))


@query("""
with m as (select conv_id, turn // 3 as u, min(turn) as place, arg_min(role, turn) as role, list_sort(list_distinct(flatten(list([turn % 4, (turn * 7) % 5])))) as ids from conversations group by 1, 2)
select conv_id, string_agg('<message uuid="' || conv_id || '-' || u || '" active="' || array_to_string(ids, ',') || '"><chunk id=0>' || role || '</chunk><chunk id=3> says</chunk></message>', '' order by place) as script,
  string_agg(case when list_contains(ids, 0) then role else '' end || case when list_contains(ids, 3) then ' says' else '' end, '' order by place) as received_text, string_agg(role || ' says', '' order by place) as plain, sum(len(ids))::bigint as received from m group by 1
""")
def gold_scripts(t: Tables) -> DataFrame:
    """Scripts of a conversation's turns in one, three turns a message: ids that any turn has received, chunks of the first."""
    n = lambda c: c.cast("string")
    script = F.concat(F.lit('<message uuid="'), n(F.col("conv_id")), F.lit("-"), n(F.floor(F.col("turn") / 3)), F.lit('" active="'), n(F.col("turn") % 4), F.lit(","), n((F.col("turn") * 7) % 5), F.lit('"><chunk id=0>'), "role", F.lit("</chunk><chunk id=3> says</chunk></message>"))
    d = G.merge(t.conversations.select("conv_id", "turn", script.alias("script")), ["conv_id"], "turn", "script")
    return d.select("conv_id", "script", G.received_text(F.col("script")).alias("received_text"), G.plain_text(F.col("script")).alias("plain"), long("received").alias("received"))


def _count(state: dict, name: str, args: dict) -> object:
    if args["value"] > 99:
        raise ValueError(f"{name} is too large")
    state[name] = state.get(name, 0) + 1
    return None


@query("""
with p as (select user_id, count(*) filter (where event_type = 'purchase') as pp, count(*) filter (where event_type = 'signup') as ps, count(*) filter (where event_type = 'purchase' and event_id % 2 = 0) as gp, count(*) filter (where event_type = 'signup' and event_id % 5 > 0) as gs,
  arg_min(event_type, event_id) filter (where event_type in ('purchase', 'signup') and value > 99) as bad, arg_min(event_type, event_id) filter (where value > 99 and (event_type = 'purchase' and event_id % 2 = 0 or event_type = 'signup' and event_id % 5 > 0)) as gbad from events group by 1),
k as (select *, case when pp <> gp then case when gp = 0 then 'extra' when pp = 0 then 'missed' else 'wrong' end end as kp, case when ps <> gs then case when gs = 0 then 'extra' when ps = 0 then 'missed' else 'wrong' end end as ks from p)
select user_id, case when bad is null then coalesce(array_to_string(list_sort(list_filter([kp || ':purchase', ks || ':signup'], lambda x: x is not null)), ';'), '') || case when kp is null and ks is null then 'no_db_diff' else '' end end as db_signature,
  case when gbad is not null then 'gold: ValueError: ' || gbad || ' is too large' when bad is not null then 'predicted: ValueError: ' || bad || ' is too large' end as reason from k
""")
def replay_and_diff(t: Tables) -> DataFrame:
    """Two trajectories of each user replayed and compared; those that fail give their reason and the others go on."""
    calls = t.events.select("user_id", "event_id", F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.to_json(F.struct("value")).alias("arguments"), F.lit(None).cast("string").alias("response"))
    gold = calls.where("name = 'purchase' and event_id % 2 = 0 or name = 'signup' and event_id % 5 > 0")
    initial = t.events.select("user_id").distinct().withColumn("state", F.lit('{"version": 1}'))
    d = SD.replay_and_diff(initial, gold, calls, "user_id", _count, ["purchase", "signup"], ["purchase", "signup"])
    return d.select("user_id", "db_signature", "reason")


# --- recordings -------------------------------------------------------------------

_SAMPLES = """
h as (select doc_id, hex(encode(text)) as h, octet_length(encode(text)) // 2 as n from documents where octet_length(encode(text)) > 1),
s as (select doc_id, i, ('0x' || substr(h, 4 * i + 1, 2))::int + 256 * ('0x' || substr(h, 4 * i + 3, 2))::int as u from h, unnest(range(n)) as r(i)),
x as (select doc_id, i, case when u > 32767 then u - 65536 else u end as x from s)
"""


@query(f"""
with {_SAMPLES}, y as (select doc_id % 10 as mix, doc_id * 37 + i as spot, sum(x) as y from x group by 1, 2)
select mix, (spot // 500)::bigint as cell, sum(greatest(-32768, least(32767, y)))::bigint as total, max(greatest(-32768, least(32767, y)))::bigint as loudest from y group by 1, 2
""")
def overlay_tracks(t: Tables) -> DataFrame:
    """Tracks laid over each other by the clock of their mix, in cells of half a thousand samples."""
    d = t.documents.select((F.col("doc_id") % 10).alias("mix"), "doc_id", F.encode("text", "utf-8").alias("pcm"))
    cells = B.overlay(d, "mix", F.col("doc_id") * 37, "pcm", 500)
    d = cells.select("mix", "cell", B.samples(F.col("pcm")).alias("s"))
    # A cell has silence where no track is; the loudest sample is one that a track made.
    return d.select("mix", "cell", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), long(F.array_max(F.filter("s", lambda x: x != 0))).alias("loudest"))


@query(f"""
with {_SAMPLES}, y as (select a.doc_id, a.i, greatest(-32768, least(32767, round_even((a.x * 2.0 + coalesce(b.x, 0) * 1.0 - coalesce(c.x, 0) * 0.5) / 4, 0))) as y from x a left join x b on b.doc_id = a.doc_id and b.i = a.i - 1 left join x c on c.doc_id = a.doc_id and c.i = a.i - 2)
select doc_id, (i // 64)::int as block, count(*) as samples, sum(y)::bigint as total from y group by 1, 2
""")
def filter_blocks(t: Tables) -> DataFrame:
    """A filter over tracks that are cut into blocks of 64 samples."""
    d = B.cut_blocks(t.documents.select("doc_id", F.encode("text", "utf-8").alias("pcm")), "doc_id", "pcm", 64)
    d = B.filter_blocks(d, "doc_id", [0.5, 0.25, -0.125])
    total = F.aggregate(B.samples(F.col("pcm")), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "block", long(F.octet_length("pcm") / 2).alias("samples"), total.alias("total"))


@query("select doc_id, octet_length(encode(text)) // 2 as samples, true as mulaw_stays, true as alaw_stays, true as close from documents where octet_length(encode(text)) % 2 = 0 and octet_length(encode(text)) > 0")
def audio_codecs(t: Tables) -> DataFrame:
    """Samples through both codecs and back: once through, a second time changes nothing, and the first changes no sample by more than a step."""
    d = t.documents.select("doc_id", F.encode("text", "utf-8").alias("pcm")).where("octet_length(pcm) % 2 = 0 and octet_length(pcm) > 0")
    d = d.withColumn("m", S.from_mulaw(S.to_mulaw("pcm"))).withColumn("a", S.from_alaw(S.to_alaw("pcm")))
    same = lambda c, there, back: F.col(c) == back(there(c))
    # A step of the loudest segment is 1,024 of the full scale's 65,536.
    close = F.forall(F.arrays_zip(B.samples(F.col("pcm")).alias("x"), B.samples(F.col("m")).alias("y")), lambda p: F.abs(p["x"] - p["y"]) <= 1024)
    return d.select("doc_id", long(F.octet_length("pcm") / 2).alias("samples"), same("m", S.to_mulaw, S.from_mulaw).alias("mulaw_stays"), same("a", S.to_alaw, S.from_alaw).alias("alaw_stays"), close.alias("close"))


# --- guards, traces, reports -----------------------------------------------------------


@query("""
with b as (select o_orderkey, 1 + o_orderkey % 3 as n, o_orderkey % 2 = 0 as insured, o_orderkey % 4 as bags, o_custkey % 7 as k1, o_orderkey % 5 as k2 from orders),
f as (select p_partkey as flight, p_size % 4 as available, p_retailprice as price from part where p_partkey <= 20),
legs as (select o_orderkey, n, unnest([1 + k1, 8 + k2]) as flight from b),
g as (select o_orderkey, bool_and(coalesce(available >= n, false)) as seats, sum(price) as fare from legs left join f using (flight) group by 1),
d as (select b.*, g.seats, g.fare * n + case when insured then n * 30.0 else 0 end + bags * 50.0 as due from b join g using (o_orderkey))
select o_orderkey as booking_id, round(due, 2) as due, case when not seats then 'no_seats' when o_orderkey % 6 = 0 then 'payment_mismatch' when o_orderkey % 3 = 1 and due - 100 > 3000 then 'balance' else 'ok' end as rule from d
""")
def booking_guards(t: Tables) -> DataFrame:
    """Bookings of two flights that go through as a whole or not at all."""
    k = F.col("o_orderkey")
    seats = t.part.where("p_partkey <= 20").select(F.col("p_partkey").alias("flight"), (F.col("p_size") % 4).alias("available"), F.col("p_retailprice").alias("price"))
    b = t.orders.select(k.alias("booking_id"), F.array(F.col("o_custkey") % 7 + 1, k % 5 + 8).alias("flights"), (k % 3 + 1).alias("passengers"), (k % 2 == 0).alias("insured"), (k % 4).alias("paid_bags"))
    legs = b.select("booking_id", "passengers", "insured", "paid_bags", F.explode("flights").alias("flight")).join(seats, "flight", "left").groupBy("booking_id", "passengers", "insured", "paid_bags").agg(F.sum("price").alias("fare"))
    due = F.col("fare") * F.col("passengers") + F.when(F.col("insured"), F.col("passengers") * 30.0).otherwise(0.0) + F.col("paid_bags") * 50.0
    pay = lambda m, a: F.struct(F.lit(m).alias("method"), a.alias("amount"))
    paid = legs.select("booking_id", F.when(F.col("booking_id") % 6 == 0, F.array(pay("free", due + 1.0))).when(F.col("booking_id") % 3 == 1, F.array(pay("free", F.lit(100.0)), pay("card", due - 100.0))).otherwise(F.array(pay("free", due))).alias("payments"))
    balances = t.region.where("r_regionkey = 0").select(F.lit("card").alias("method"), F.lit(3000.0).alias("balance"))
    return GD.booking_guard(b.join(paid, "booking_id"), seats, balances)


@query("""
with x as (select label, vec_id % 3 as truth, count(*) as n from embeddings group by 1, 2)
select label as cluster, round(max(n) / sum(n) * 4 + 1, 1) as cohesion, sum(n)::bigint as size from x group by 1
""")
def cluster_cohesion(t: Tables) -> DataFrame:
    """How much of a cluster is of one kind, from 1 to 5."""
    d = C.purity(t.embeddings.select(F.col("label").alias("p"), (F.col("vec_id") % 3).alias("t")), "t", "p")
    return d.select("cluster", C.cohesion(F.col("purity")).alias("cohesion"), long("size").alias("size"))


@query("select conv_id as run_id, count(*) filter (where role <> 'system' and turn % 3 = 0) as communication_errors, count(*) filter (where role = 'system' and turn % 2 = 0) as environment_errors from conversations group by 1")
def history_errors(t: Tables) -> DataFrame:
    """Errors of the parties and of tools in a history."""
    tool = F.col("role") == "system"
    bad = F.when(tool, F.col("turn") % 2 == 0).when(F.col("turn") % 3 == 0, True)
    return TR.error_counts(t.conversations.select(F.col("conv_id").alias("run_id"), F.when(tool, "tool").otherwise(F.col("role")).alias("role"), bad.alias("error")))


@query("""
with x as (select o_orderkey as k, o_orderkey % 2 = 0 as a, case o_orderkey % 3 when 0 then true when 1 then false end as c, o_orderkey % 5 > 0 as s, o_orderkey % 4 as e, ['', 'get', 'get,set'][(o_orderkey % 3 + 1)::int] as tools, o_orderstatus as f from orders)
select k as run_id, 'failure_type=' || f || ' | tools=' || coalesce(nullif(tools, ''), 'none') || ' | flags=' || concat_ws(',', case when a then 'auth_ok' else 'auth_missing' end, case when c then 'confirm_ok' when not c then 'confirm_missing' end, case when not s then 'multi_tool_turn' end, case when e > 0 then 'env_errors=' || e end)
  || ' | termination=' || case when k % 7 = 0 then 'none' else 'user_stop' end || case when k % 2 = 0 then ' | db_diff=wrong:x' else '' end || case when k % 11 = 0 then ' | nl_diff=says' else '' end as embedding_text from x
""")
def run_documents(t: Tables) -> DataFrame:
    """One line that describes a run for clustering, parts that are missing left out."""
    k = F.col("o_orderkey")
    flags = F.struct((k % 2 == 0).alias("auth_before_mutate"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("confirm_before_write"), (k % 5 > 0).alias("single_tool_per_turn"), (k % 4).alias("num_env_errors"))
    tools = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("get"))).otherwise(F.array(F.lit("get"), F.lit("set")))
    d = t.orders.select(k.alias("run_id"), F.col("o_orderstatus").alias("f"), flags.alias("flags"), tools.alias("tools"), F.when(k % 7 != 0, "user_stop").alias("reason"), F.when(k % 2 == 0, "wrong:x").alias("db"), F.when(k % 11 == 0, "says").alias("nl"))
    return d.select("run_id", TR.embedding_text(F.col("f"), F.col("tools"), F.col("flags"), F.col("reason"), F.col("db"), F.col("nl")).alias("embedding_text"))


@query("""
with m as (select conv_id, turn, case when role = 'system' then 'tool' else role end as role, text from conversations where conv_id % 3 > 0),
n as (select conv_id, turn as pos, 0 as k, case when role = 'tool' then 2 else 0 end as depth, case when role = 'tool' then 'result' else role end as kind, text from m
  union all select conv_id, turn, 1, 1, 'call', 'tool' || turn from m where role = 'assistant')
select conv_id as run_id, (row_number() over (partition by conv_id order by pos, k, depth) - 1)::bigint as node, depth, kind, text, 'f' || (conv_id % 3) as failure_type from n
""")
def viewer_nodes(t: Tables) -> DataFrame:
    """Trace nodes of the runs that have features: messages, their calls below them, results below those."""
    role = F.when(F.col("role") == "system", "tool").otherwise(F.col("role"))
    call = F.array(F.struct(F.concat(F.lit("tool"), F.col("turn").cast("string")).alias("name")))
    m = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), role.alias("role"), F.col("text").alias("content"), F.when(F.col("role") == "assistant", call).alias("calls"))
    features = t.conversations.select(F.col("conv_id").alias("run_id")).distinct().where("run_id % 3 > 0").withColumn("failure_type", F.concat(F.lit("f"), (F.col("run_id") % 3).cast("string")))
    return RP.viewer_rows(m, features).select("run_id", long("node").alias("node"), "depth", "kind", "text", "failure_type")


@query("""
with a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as seq, ['get', 'login', 'update'][((conv_id + turn) % 3 + 1)::int] as name, (conv_id + turn) % 5 = 0 as bad from conversations where role = 'assistant'),
c as (select *, lag(name) over (partition by conv_id order by seq) is distinct from name as new from a),
g as (select conv_id, coalesce(string_agg(name, '>' order by seq) filter (where new), '') as tools, max(name) filter (where name = 'update') as writes, min(seq) filter (where name = 'update') as w, min(seq) filter (where name = 'login') as l, count(*) filter (where bad) as errors from c group by 1),
u as (select u.conv_id, min((select count(*) from a where a.conv_id = u.conv_id and a.turn < u.turn)) as yes from conversations u where u.role = 'user' and u.conv_id % 2 = 0 group by 1),
r as (select distinct conv_id, ['pass', 'db_only', 'nl_only', 'mixed'][(conv_id % 4 + 1)::int] as failure from conversations)
select r.conv_id as run_id, failure as failure_type, coalesce(tools, '') as tools, coalesce(writes, '') as writes, case when g.conv_id is null then null when w is null then true else coalesce(l < w, false) end as auth_before_mutate, case when w is not null then coalesce(yes < w, false) end as confirm_before_write, errors as num_env_errors,
  case when failure = 'pass' then 'pass' when failure = 'nl_only' then 'comm_miss' when writes is null then 'stalled_no_action' else 'other' end as mechanism,
  case failure when 'db_only' then 'db=unknown' when 'nl_only' then 'nl=says hello' when 'mixed' then 'db=unknown | nl=says hello' else 'chain=' || coalesce(writes, nullif(replace(tools, '>', '->'), ''), 'no_tools') end as signature
from r left join g using (conv_id) left join u using (conv_id)
""")
def run_features(t: Tables) -> DataFrame:
    """One wide row a run, out of its messages, calls, results and reward: chains, flags, errors, class, mechanism, signature."""
    c = t.conversations
    run, none = F.col("conv_id").alias("run_id"), F.lit(None).cast("array<struct<id:string,name:string>>")
    n = F.col("conv_id") + F.col("turn")
    call = F.concat_ws("-", "conv_id", "turn")
    name = F.get(F.array(*[F.lit(x) for x in ("get", "login", "update")]), (n % 3).cast("int"))
    text = F.lit(None).cast("string")
    row = lambda pos, role, calls, ids, error, content: (run, pos.alias("pos"), F.lit(role).alias("role"), calls.alias("calls"), ids.alias("tool_call_id"), error.alias("error"), content.alias("content"))
    said = c.where("role = 'user'").select(*row(F.col("turn") * 2, "user", none, text, F.lit(False), F.when(F.col("conv_id") % 2 == 0, "yes, go on").otherwise("hm")))
    agent = c.where("role = 'assistant'")
    asked = agent.select(*row(F.col("turn") * 2, "assistant", F.array(F.struct(call.alias("id"), name.alias("name"))), text, F.lit(False), F.lit("")))
    got = agent.select(*row(F.col("turn") * 2 + 1, "tool", none, call, n % 5 == 0, F.lit("Error: no")))
    k = F.col("conv_id") % 4
    part = lambda x, bad: F.struct(F.lit(x).alias("key"), F.when(bad, 0.0).otherwise(1.0).alias("value"))
    info = F.struct(
        F.when(k == 0, 1.0).otherwise(0.0).alias("reward"), F.array(F.lit("DB"), F.lit("NL_ASSERTION")).alias("reward_basis"), F.map_from_entries(F.array(part("DB", k.isin(1, 3)), part("NL_ASSERTION", k.isin(2, 3)))).alias("reward_breakdown"),
        F.struct(F.lit(True).alias("db_match")).alias("db_check"), F.array(F.struct(F.lit("says hello").alias("nl_assertion"), (~k.isin(2, 3)).alias("met"))).alias("nl_assertions"), F.lit(None).cast("array<struct<met:boolean>>").alias("communicate_checks"),
    )
    runs = c.select("conv_id").distinct().select(run, info.alias("reward_info"), F.lit("user_stop").alias("termination_reason"))
    d = TR.features(runs, said.unionByName(asked).unionByName(got), ["update"], ["login"])
    return d.select("run_id", "failure_type", F.array_join("tool_chain", ">").alias("tools"), F.array_join("write_chain", ">").alias("writes"), "auth_before_mutate", "confirm_before_write", "num_env_errors", "mechanism", "signature")
