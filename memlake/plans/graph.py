"""Queries over the entity graph, provenance, rules, observations and vectors, and their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.operators import analytics as A
from memlake.operators import graph as G
from memlake.operators import provenance as P
from memlake.operators import recall as R
from memlake.operators import rules as U
from memlake.operators import vectors as V
from memlake.plans.records import REC, records
from memlake.sources.tables import Scratch, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f

    return add


ENT = "(select distinct on (id) * from memory_entities)"
RELN = "(select distinct on (id) * from memory_relations)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_entities").dropDuplicates(["id"])


def relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memory_relations").dropDuplicates(["id"])


@query("g5_j3_by_entity", f"select storage_key from {REC} where storage_key in (select memory_key from memory_entities where lower(entity_text) = (select min(lower(entity_text)) from memory_entities where entity_type = 'tool'))")
def g5(spark, d):
    m = mentions(spark, d)
    one = m.where("entity_type = 'tool'").agg(F.min(F.lower("entity_text")).alias("e"))
    hit = m.join(F.broadcast(one), F.lower("entity_text") == F.col("e")).select(F.col("memory_key").alias("storage_key"))  # one row
    return records(spark, d).join(hit, "storage_key", "left_semi").select("storage_key")


@query("g6_j4_by_relation", f"select distinct m.storage_key, s.entity_text src, t.entity_text dst, r.weight from {RELN} r join {ENT} s on s.id = r.src_entity_id join {ENT} t on t.id = r.dst_entity_id join {REC} m on m.storage_key = r.source_memory_key where r.relation_type = 'prefers'")
def g6(spark, d):
    return G.recall_by_relation(records(spark, d), relations(spark, d), mentions(spark, d), "prefers")


@query("j10_g11_relations", f"select r.id, s.entity_text src, t.entity_text dst, r.relation_type, r.weight from {RELN} r join {ENT} s on s.id = r.src_entity_id join {ENT} t on t.id = r.dst_entity_id")
def j10(spark, d):
    return G.named_relations(relations(spark, d), mentions(spark, d)).select("id", "src", "dst", "relation_type", "weight")


@query("a6_entities", f"select entity_text, entity_type, count(*) n, max(confidence) confidence from {ENT} group by 1, 2")
def a6(spark, d):
    return G.entity_listing(mentions(spark, d))


@query("a7_graph_stats", "select (select count(distinct entity_text) from memory_entities) n_entities, (select count(distinct memory_key) from memory_entities) n_memories, (select count(distinct id) from memory_relations) n_relations")
def a7(spark, d):
    return G.graph_stats(table(spark, d, "memory_entities"), table(spark, d, "memory_relations"))


@query("a5_g9_impact", f"""with m as (select memory_key, count(distinct entity_text) n_entities, count(distinct namespace) ns from {ENT} where memory_key is not null group by 1), r as (select source_memory_key k, count(distinct id) n from {RELN} where source_memory_key is not null group by 1)
 select m.memory_key, n_entities, coalesce(n, 0) n_relations, round(0.4*n_entities + 0.4*coalesce(n,0) + case when ns > 1 then 0.2 else 0.0 end, 6) impact from m left join r on r.k = m.memory_key""")
def a5(spark, d):
    return G.impact(mentions(spark, d), relations(spark, d))


_CO = f"""(select x.e a, y.e b, count(*) n from (select distinct memory_key m, lower(entity_text) e from {ENT} where memory_key is not null and trim(memory_key) <> '') x
 join (select distinct memory_key m, lower(entity_text) e from {ENT} where memory_key is not null and trim(memory_key) <> '') y on x.m = y.m and x.e < y.e group by 1, 2 having count(*) >= 1)"""


def pairs(spark, d):
    m = mentions(spark, d).where(F.trim("memory_key") != "")
    return G.co_occurrence(m, F.col("memory_key"), F.lower("entity_text"), 1)


@query("j5_a9_co_occurrence", f"select * from {_CO}")
def j5(spark, d):
    return pairs(spark, d)


@query("j5_lineitem_pairs", "with x as (select distinct l_orderkey m, l_suppkey e from lineitem) select x.e a, y.e b, count(*) n from x join x y on x.m = y.m and x.e < y.e group by 1, 2 having count(*) >= 10")
def j5l(spark, d):
    return G.co_occurrence(table(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_suppkey"), 10)


@query("g12_derived_facts", f"select a, b, round(least(0.6, 0.3 + 0.05*n), 6) confidence, a || ' co-occurs with ' || b fact from {_CO}")
def g12(spark, d):
    return G.derived_facts(pairs(spark, d))


@query("g13_reinforce", f"""with e as (select least(lower(s.entity_text), lower(t.entity_text)) a, greatest(lower(s.entity_text), lower(t.entity_text)) b, max(r.weight) w from {RELN} r join {ENT} s on s.id = r.src_entity_id join {ENT} t on t.id = r.dst_entity_id group by 1, 2)
 select p.a, p.b, round(case when e.w is not null then least(e.w + 0.1, 2.0) else least(0.1*p.n, 2.0) end, 6)::double weight from {_CO} p left join e on e.a = p.a and e.b = p.b""")
def g13(spark, d):
    named = G.named_relations(relations(spark, d), mentions(spark, d))
    edges = named.select(F.least(F.lower("src"), F.lower("dst")).alias("a"), F.greatest(F.lower("src"), F.lower("dst")).alias("b"), "weight")
    return G.reinforced_edges(edges, pairs(spark, d))


_UND = f"(select src_entity_id a, dst_entity_id b from {RELN} where src_entity_id <> dst_entity_id union select dst_entity_id, src_entity_id from {RELN} where src_entity_id <> dst_entity_id)"


@query("g7_k_hop", f"""with recursive e as {_UND}, s as (select min(a) v from e), w(v, hop) as (select v, 0 from s union select e.b, w.hop + 1 from w join e on e.a = w.v where w.hop < 3)
 select v, min(hop)::int hop from w group by v""")
def g7(spark, d):
    e = G.undirected(relations(spark, d), "src_entity_id", "dst_entity_id")
    return G.k_hop(e, e.agg(F.min("a").alias("v")), 3, Scratch(spark, "hops"))


@query("g8_shortest_path", """with recursive e as (select c_custkey + 1000000 a, c_nationkey b from customer union select s_suppkey + 2000000, s_nationkey from supplier union select n_nationkey, n_regionkey + 900 from nation), u as (select * from e union select b, a from e),
 w(v, hop) as (select 1000001::bigint, 0 union select u.b, hop + 1 from w join u on u.a = w.v where hop < 6) select 1000001::bigint source, 2000001::bigint target, min(hop)::int hops from w where v = 2000001""")
def g8(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("a"), F.col("c_nationkey").cast("long").alias("b"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 2000000).alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 900).cast("long").alias("b"))
    e = G.undirected(c.unionByName(s).unionByName(n), "a", "b")
    return G.shortest_path_length(e, 1000001, 2000001, 6, Scratch(spark, "path")).select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "hops")


@query("g15_cascade", f"select count(*) n from {ENT} where memory_key not in (select storage_key from memories where paused) and memory_key is not null")
def g15(spark, d):
    gone = table(spark, d, "memories").where("paused").select("storage_key")
    return G.cascade_delete(mentions(spark, d).where("memory_key is not null"), gone, "memory_key").agg(F.count("*").alias("n"))


@query("g16_similar_components")
def g16(spark, d):
    m = records(spark, d).withColumn("tok", L.word_tokens("content"))
    p = A.jaccard_pairs(m, "storage_key", "tok", ["namespace", "type"], 0.7)
    e = G.undirected(p, "key_a", "key_b")
    scratch = Scratch(spark, "similar")
    return G.min_label_components(scratch.write(e), scratch)


@query("a8_aliases", "select canonical_form, entity_type, count(*) alias_count, max(created_at) last_alias from (select distinct on (id) * from entity_aliases) group by 1, 2")
def a8(spark, d):
    return G.alias_counts(table(spark, d, "entity_aliases"))


_PAIR = "(select min(canonical_form) x, max(canonical_form) y from entity_aliases where canonical_form <> '')"


@query("g3_merge_entities", f"select distinct namespace, case when canonical_form = x then y else canonical_form end canonical_form, alias_form from entity_aliases, {_PAIR} where case when canonical_form = x then y else canonical_form end is distinct from alias_form")
def g3(spark, d):
    a = table(spark, d, "entity_aliases")
    x, y = a.where("canonical_form <> ''").agg(F.min("canonical_form"), F.max("canonical_form")).first()
    return G.merge_entities(a, x, y)


@query("j17_fuzzy_aliases")
def j17(spark, d):
    a = table(spark, d, "entity_aliases")
    return G.fuzzy_aliases(a, a)


# provenance on orders (targets) and line items (sources); live: not returned
@query("j7_live_evidence", "select l_orderkey, count(*) n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F') group by 1")
def j7(spark, d):
    live = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return P.live_evidence(table(spark, d, "lineitem"), live, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("j8_unsupported", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey) and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag <> 'R')")
def j8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("src"))
    return P.unsupported(o, li.select("o_orderkey", "src"), li.where("l_returnflag <> 'R'").select("src"), "o_orderkey", "src")


@query("j9_flag_unsupported", "select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey) and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag <> 'R') as unsupported from orders")
def j9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("src"))
    return P.flag_unsupported(o, li.select("o_orderkey", "src"), li.where("l_returnflag <> 'R'").select("src"), "o_orderkey", "src")


@query("e6_evidence_budget", f"""with l as (select memory_key storage_key, id, entity_text t from {ENT} where memory_key is not null), r as (select * from (select storage_key, id, t, row_number() over (partition by storage_key order by id) nth from l) where nth <= 3),
 b as (select *, coalesce(sum(length(t)) over (partition by storage_key order by id rows between unbounded preceding and 1 preceding), 0) before from r)
 select b.storage_key, b.id, substr(t, 1, greatest(0, 20 - before)::int) piece from b join {REC} m on m.storage_key = b.storage_key where length(t) > 0 and 20 - before > 0""")
def e6(spark, d):
    links = mentions(spark, d).where("memory_key is not null").select(F.col("memory_key").alias("storage_key"), "id", "entity_text")
    return P.expand_evidence(records(spark, d).select("storage_key"), links, "storage_key", 3, 20, "entity_text", F.asc("id")).select("storage_key", "id", "piece")


AT = datetime(2024, 1, 20, tzinfo=timezone.utc)
_OBS = "(select user_id as subject, event_type predicate, props value_json, ts observed_at, ts + interval 7 day expires_at, event_id from events)"


def observations(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("props").alias("value_json"), F.col("ts").alias("observed_at"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"), "event_id")


@query("f15_observations", f"select predicate, count(*) n from {_OBS} where observed_at <= timestamp '2024-01-20' and expires_at > timestamp '2024-01-20' group by 1")
def f15(spark, d):
    at = F.lit("2024-01-20").cast("timestamp")
    return P.valid_observations(observations(spark, d), at).groupBy("predicate").agg(F.count("*").alias("n"))


@query("q8_latest_observation", f"select subject, predicate, arg_max(value_json, (observed_at, event_id)) value_json, max(observed_at) observed_at, count(*) n from {_OBS} group by 1, 2")
def q8(spark, d):
    return P.latest_observation(observations(spark, d), "subject", "predicate")


@query("q8_conflicts", f"select subject, predicate, count(distinct value_json) n_values, count(*) n, true as auto from {_OBS} group by 1, 2 having count(distinct value_json) > 1")
def q8c(spark, d):
    return P.observation_conflicts(observations(spark, d), "subject", "predicate")


@query("k12_candidate_rank", f"select event_id, r::int as rank, count(*) filter (where r = 1) over (partition by subject, predicate) > 1 as open from (select *, rank() over (partition by subject, predicate order by observed_at::date desc, value_json) r from {_OBS})")
def k12(spark, d):
    return P.ranked_candidates(observations(spark, d), ["subject", "predicate"], F.desc(F.to_date("observed_at")), F.asc("value_json")).select("event_id", "rank", "open")


@query("f14_audit", "select event_id, event_type, user_id from events where event_type = 'error' and value > 100 and ts >= timestamp '2024-01-10'")
def f14(spark, d):
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("value") > 100) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")))
    return e.select("event_id", "event_type", "user_id")


@query("a13_audit_stats", "select event_type, value > 100 as result, count(*) n, arg_max(event_id, (ts, event_id)) last_event from events group by 1, 2")
def a13(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("value") > 100).alias("result")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("a12_percentiles", """with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 r, count(*) over (partition by event_type) n from events where value is not null)
 select event_type, max(n) n, max(case when r = least(floor(n*0.5), n-1) then value end) p50, case when max(n) > 20 then max(case when r = least(floor(n*0.95), n-1) then value end) end p95, max(case when r = least(floor(n*0.99), n-1) then value end) p99 from r group by 1""")
def a12(spark, d):
    return A.latency_percentiles(table(spark, d, "events"), "event_type", "value")


@query("r8_w10_rate_limit", """select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) n_hour, count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) n_day,
 count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) > 20 or count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) > 50 as blocked from events""")
def r8(spark, d):
    return A.rate_limits(table(spark, d, "events"), "ts", ["user_id"]).select("event_id", "n_hour", "n_day", "blocked")


@query("w8_d6_version_chain", "select o_orderkey, (row_number() over w)::int version_no, lead(o_orderdate) over w valid_to from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def w8(spark, d):
    return A.version_chain(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "version_no", "valid_to")


@query("w9_d8_rollback", "select o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) restored, count(*) + 1 as version from orders group by 1")
def w9(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("restored"), (F.count("*") + 1).alias("version"))


# rules from parts
_RULES = """(select p_partkey::varchar rule_id, case when p_partkey % 997 = 0 then '*' else lower(p_name || ' ' || replace(p_brand, '#', '')) end "trigger", lower(p_type) || ' ' || p_size as action,
 case p_size % 3 when 0 then 'company' when 1 then 'negotiated' else 'personal' end scope, p_size % 2 = 0 override, case p_size % 4 when 0 then 'always' when 1 then 'prefer' when 2 then 'avoid' else 'forbid' end rule_type,
 (p_size % 10)/10.0 confidence, p_size % 7 trigger_count, case when p_size % 10 = 9 then 'paused' else 'active' end status, case when p_size % 5 = 0 then lower(p_type) end "condition", p_brand from part)"""


def rules(spark, d):
    p, s = table(spark, d, "part"), F.col("p_size")
    name = F.lower(F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(""))))
    return p.select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.when(F.col("p_partkey") % 997 == 0, "*").otherwise(name).alias("trigger"), F.concat_ws(" ", F.lower("p_type"), s.cast("string")).alias("action"),
        F.when(s % 3 == 0, "company").when(s % 3 == 1, "negotiated").otherwise("personal").alias("scope"), (s % 2 == 0).alias("override"),
        F.when(s % 4 == 0, "always").when(s % 4 == 1, "prefer").when(s % 4 == 2, "avoid").otherwise("forbid").alias("rule_type"), ((s % 10) / F.lit(10.0)).alias("confidence"), (s % 7).alias("trigger_count"),
        F.when(s % 10 == 9, "paused").otherwise("active").alias("status"), F.when(s % 5 == 0, F.lower("p_type")).alias("condition"), "p_brand",
    )


_SCENES = """(select distinct s scene_id, s scene from (select lower(p_name || ' ' || p_type) s from part union all select lower(p_name || ' brand1') from part))"""


def scenes(spark, d):
    """What parts are called with their type, and with the first brand (which some triggers equal)."""
    p = table(spark, d, "part")
    c = F.explode(F.array(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lower(F.concat_ws(" ", "p_name", F.lit("brand1")))))
    return p.select(c.alias("scene")).distinct().select(F.col("scene").alias("scene_id"), "scene")


_ACTIVE = f"(select * from {_RULES} where status = 'active')"
_BM25 = rf"""(with d as (select rule_id, regexp_extract_all(lower("trigger" || ' ' || action), '[\p{{L}}\p{{N}}_]+') t from {_ACTIVE} where "trigger" <> '*'), st as (select count(*) n, avg(len(t)) a from d),
 p as (select rule_id, w, l, count(*) tf from (select rule_id, len(t) l, unnest(t) w from d) group by all), f as (select w, count(*) df from p group by w),
 q as (select scene_id, unnest(list_distinct(regexp_extract_all(scene, '[\p{{L}}\p{{N}}_]+'))) w from {_SCENES})
 select q.scene_id, p.rule_id, round(sum(ln(1 + (n - df + 0.5)/(df + 0.5)) * tf * 2.2 / (tf + 1.2*(0.25 + 0.75*l/a))), 9) bm25 from q join p using (w) join f using (w), st group by all)"""
_BONUS = "(case when override then 0.1 else 0.0 end) + least(trigger_count/10.0*0.02, 0.1) + 0.05*confidence"


@query("j11_r4_rule_search", f"select * from {_BM25}")
def j11(spark, d):
    q = scenes(spark, d).select(F.col("scene_id").alias("query_id"), F.col("scene").alias("query"))
    return U.search(q, U.active(rules(spark, d)).where("trigger <> '*'")).withColumnRenamed("query_id", "scene_id")


_MATCHES = rf"""(with r as (select *, {_BONUS} bonus from {_ACTIVE}), h as (
 select scene_id, rule_id, 'global' match_type, 0.6::double base, bonus from {_SCENES}, r where "trigger" = '*'
 union all select scene_id, rule_id, 'exact', 1.0, bonus from {_SCENES} s join r on r."trigger" = s.scene
 union all select scene_id, rule_id, 'fts', least(greatest(bm25/10, 0.3), 0.95), bonus from {_BM25} b join r using (rule_id)
 union all select scene_id, rule_id, 'partial', 0.5, bonus from {_SCENES} s join r on r."trigger" <> '*' and list_has_any(list_filter(regexp_extract_all(s.scene, '[a-z0-9_]+'), lambda x: length(x) >= 2), regexp_extract_all(r."trigger", '[a-z0-9_]+'))),
 b as (select scene_id, rule_id, max(row(round(least(1.0, base + bonus), 6)::double, base, match_type)) x from h group by 1, 2)
 select * from (select scene_id, rule_id, x[3] match_type, x[1] score, (row_number() over (partition by scene_id order by x[1] desc, rule_id))::int "rank" from b) where "rank" <= 5)"""


@query("r1_r2_match", f"select * from {_MATCHES}")
def r1(spark, d):
    return U.match(scenes(spark, d), U.active(rules(spark, d)))


@query("f13_conditions", f"""select rule_id from {_ACTIVE} where scope in ('company', 'personal') and ("condition" is null or "condition" in ('economy', 'small'))""")
def f13(spark, d):
    return U.active(rules(spark, d), scopes=("company", "personal"), conditions=("economy kind", "Small")).select("rule_id")


_CONFLICTS = f"""(with r as (select rule_id, lower(trim("trigger")) t, action, rule_type, list_distinct(regexp_split_to_array(lower(trim("trigger")), '\\s+')) w from {_ACTIVE}),
 p as (select a.rule_id ra, b.rule_id rb, a.t = b.t and a.action = b.action and a.rule_type = b.rule_type same, (a.rule_type in ('always','prefer') and b.rule_type in ('avoid','forbid')) or (b.rule_type in ('always','prefer') and a.rule_type in ('avoid','forbid')) opposed,
   a.rule_type = b.rule_type and a.action <> b.action over_
  from r a join r b on a.rule_id < b.rule_id and (a.t = b.t or a.t = '*' or b.t = '*' or contains(a.t, b.t) or contains(b.t, a.t) or (len(list_intersect(a.w, b.w)) >= 1 and len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::double >= 0.5)))
 select case when same then 'redundancy' when opposed then 'contradiction' when over_ then 'overlap' end kind, ra rule_a, rb rule_b from p where same or opposed or over_)"""


@query("r6_j16_conflicts", f"select kind, case kind when 'redundancy' then 'low' when 'contradiction' then 'critical' else 'medium' end severity, rule_a, rule_b from {_CONFLICTS}")
def r6(spark, d):
    return U.conflicts(U.active(rules(spark, d)))


@query("a22_severity", f"select case kind when 'redundancy' then 'low' when 'contradiction' then 'critical' else 'medium' end severity, count(*) n from {_CONFLICTS} group by 1")
def a22(spark, d):
    return U.health(U.active(rules(spark, d)))


@query("x13_rank_estimate", f"""with q as (select distinct scene q, list_distinct(regexp_split_to_array(scene, '\\s+')) qw from {_SCENES}), r as (select rule_id, "trigger" t, action a, list_distinct(regexp_split_to_array("trigger", '\\s+')) tw, list_distinct(regexp_split_to_array(action, '\\s+')) aw from {_RULES})
 select q query_id, rule_id, round(least(0.5 + case when contains(t, q) then 0.3 else 0 end + case when contains(a, q) then 0.1 else 0 end + 0.2 * len(list_intersect(qw, tw)) / len(qw)::double, 1.0), 6)::double score from q join r on list_has_any(qw, tw) or list_has_any(qw, aw)""")
def x13(spark, d):
    return U.rank_estimate(scenes(spark, d).select(F.col("scene_id").alias("query_id"), F.col("scene").alias("query")), rules(spark, d))


@query("r4_page", f"select rule_id, action from {_RULES} where rule_type = 'prefer' order by rule_id desc limit 25 offset 50")
def r4(spark, d):
    return U.listed(rules(spark, d), 25, 50, rule_type="prefer").select("rule_id", "action")


@query("r5_counters", f"select rule_id, trigger_count + coalesce(n, 0) trigger_count from {_RULES} left join (select l_partkey::varchar rule_id, count(*) n from lineitem group by 1) using (rule_id)")
def r5(spark, d):
    return U.counted(rules(spark, d), table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("rule_id"))).select("rule_id", "trigger_count")


_DOMAINS = {"colour": ("red", "blue", "green"), "heat": ("hot", "cold"), "size": ("small", "large")}


@query("r12_implicit_preferences", "with m as (select p_brand namespace, unnest([" + ", ".join(f"{{'d': '{d}', 'w': '{w}', 'n': len(regexp_extract_all(lower(p_name || ' ' || p_type), '\\b{w}\\b'))}}" for d, ws in _DOMAINS.items() for w in ws) + """]) x from part),
 e as (select namespace, x.d as domain, x.w choice, sum(x.n)::bigint n from m where x.n > 0 group by all), t as (select namespace, domain, sum(n)::bigint total, arg_min(choice, (-n, choice)) choice, max(n) n from e group by all)
 select namespace, domain, choice, n, round(n / total::double, 6) ratio, round(least(0.5 + 0.3 * n / total::double, 0.9), 6) confidence from t where n >= 3 and n / total::double >= 0.5""")
def r12(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("namespace"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return U.implicit_preferences(p, "text", _DOMAINS)


@query("r7_j15_merge", f"""with r as (select *, case when rule_id::int % 2 = 0 then 1 else 2 end side from {_RULES}) select rule_id, "trigger", action, scope, side::int side from (select *, row_number() over (partition by lower(trim("trigger"))
 order by case scope when 'company' then 3 when 'negotiated' then 2 else 1 end desc, confidence desc, side, rule_id) rn from r) where rn = 1""")
def r7(spark, d):
    r = rules(spark, d)
    even = F.col("rule_id").cast("int") % 2 == 0
    return U.merge(r.where(even), r.where(~even))


@query("r8_a16_limits", f"""select rule_type, count(*) n, count(*) filter (where override) n_override, greatest(50 - count(*), 0) left_of_type, greatest(200 - (select count(*) from {_RULES}), 0) left_of_all, greatest(3 - (select count(*) from {_RULES} where "trigger" = '*'), 0) left_of_global from {_RULES} group by 1""")
def r8l(spark, d):
    return U.limits(rules(spark, d))


@query("r8_accepted", f"""with a as (select * from (select *, row_number() over (partition by rule_type order by rule_id) n from {_RULES}) where n <= 50), b as (select * from (select *, sum(("trigger" = '*')::int) over (order by rule_id) g from a) where "trigger" <> '*' or g <= 3)
 select rule_id from (select rule_id, row_number() over (order by rule_id) n from b) where n <= 200""")
def r8a(spark, d):
    return U.accepted(rules(spark, d)).select("rule_id")


@query("a15_effectiveness", f"select rule_type, scope, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end bucket, count(*) n, count(*) filter (where trigger_count > 0) n_triggered from {_RULES} group by 1, 2, 3")
def a15(spark, d):
    return U.effectiveness(rules(spark, d))


_TOK = r"greatest(1, floor(len(regexp_extract_all({0}, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]'))/2.0 + (length({0}) - len(regexp_extract_all({0}, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]')))/4.0))::int"


@query("r9_q32_inject", f"""with m as (select scene_id, rule_id, score, override, case when override then "trigger" || ' ' || action else action end x from {_MATCHES} join {_RULES} using (rule_id)), t as (select *, {_TOK.format('x')} tokens from m)
 select scene_id, rule_id, tokens, used from (select *, (sum(tokens) over (partition by scene_id order by override desc, score desc, rule_id rows unbounded preceding))::bigint used from t) where override or used <= 8""")
def r9(spark, d):
    m = r1(spark, d).join(rules(spark, d).select("rule_id", "trigger", "action", "override"), "rule_id")
    return U.inject(m, 8)


@query("r10_a21_mining", f"select namespace, k keyword, count(distinct storage_key) n from (select storage_key, namespace, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z]{{3,}}'))) k from {REC} where not regexp_matches(content, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}]')) group by 1, 2 having count(distinct storage_key) >= 3")
def r10(spark, d):
    return U.mine_keywords(records(spark, d).where(~L.has_cjk("content")))


@query("r10_a21_all_mining")
def r10_all(spark, d):
    """As r10_a21_mining, with the records that hold CJK characters."""
    return U.mine_keywords(records(spark, d))


@query("j19_source_states", f"""with s as (select id::varchar rule_id, weight confidence, source_memory_key k from {RELN} where source_memory_key is not null)
 select rule_id, round(greatest(0.0, s.confidence - 0.1*count(*) filter (where m.storage_key is null) - 0.05*count(*) filter (where m.superseded)), 6) confidence, count(*) filter (where not m.superseded) n_active, count(*) filter (where m.superseded) n_superseded, count(*) filter (where m.storage_key is null) n_deleted
 from s left join {REC} m on m.storage_key = s.k group by rule_id, s.confidence""")
def j19(spark, d):
    r = relations(spark, d).where("source_memory_key is not null").select(F.col("id").cast("string").alias("rule_id"), F.col("weight").alias("confidence"), F.array("source_memory_key").alias("sources"))
    return U.source_states(r, records(spark, d).select("storage_key", "superseded"))


@query("x20_rule_extraction", r"select storage_key, nullif(trim(regexp_extract(lower(content), '\balways\s+([^.,;\n]{3,80})', 1)), '') always_action from " + REC)
def x20(spark, d):
    t = F.lower("content")
    return records(spark, d).select("storage_key", F.nullif(F.trim(F.regexp_extract(t, r"\balways\s+([^.,;\n]{3,80})", 1)), F.lit("")).alias("always_action"))


@query("r11_extracted_types", r"""select case when trim(regexp_extract(c, '\b(?:avoid|never|don''t)\s+([^.,;\n]{3,80})', 1)) <> '' then 'avoid' when trim(regexp_extract(c, '\b(?:prefer|rather have)\s+([^.,;\n]{3,80})', 1)) <> '' then 'prefer'
 when trim(regexp_extract(c, '\balways\s+([^.,;\n]{3,80})', 1)) <> '' then 'always' end rule_type, count(*) n from (select lower(content) c from """ + REC + ") group by 1")
def r11(spark, d):
    x = U.extracted_rule("content")
    return records(spark, d).groupBy(x["rule_type"].alias("rule_type")).agg(F.count("*").alias("n"))


@query("r14_bundle")
def r14(spark, d):
    return U.bundle(rules(spark, d), "parts")


@query("r15_sanitise", r"""select storage_key, length(content) <= 200 and not regexp_matches(content, '(?i)(<script|javascript:|\.\./|\bdrop\s+table\b|\bunion\s+select\b|\$\(|`)') and length(coalesce(raw_text, '')) <= 500
 and not regexp_matches(coalesce(raw_text, ''), '(?i)(<script|javascript:|\.\./|\bdrop\s+table\b|\bunion\s+select\b|\$\(|`)') and not regexp_matches(content, '(;|--|/\*|\*/)') as ok from """ + REC)
def r15(spark, d):
    return records(spark, d).select("storage_key", U.sanitised(F.col("content"), F.coalesce("raw_text", F.lit(""))).alias("ok"))


# vectors: the queries are all rows whose id is divisible by 50
_DIST = "sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
_COS = f"1 - {_DOT.format('q.embedding', 'v.embedding')} / sqrt({_DOT.format('q.embedding', 'q.embedding')} * {_DOT.format('v.embedding', 'v.embedding')})"
_NEAR = "(select query_id, vec_id, round(dist, 6) dist, rank from (select q.vec_id query_id, v.vec_id, {0} dist, (row_number() over (partition by q.vec_id order by {0}, v.vec_id))::int rank from embeddings q, embeddings v where q.vec_id % 50 = 0) where rank <= 20)"


def _near(spark, d, metric):
    e = table(spark, d, "embeddings")
    return V.nearest_all(e, e.where("vec_id % 50 = 0"), 20, metric=metric).withColumn("dist", F.round("dist", 6))


@query("s4_t17_knn", f"select * from {_NEAR.format(_DIST)}")
def s4(spark, d):
    return _near(spark, d, "l2")


@query("t16_cosine", f"select * from {_NEAR.format(_COS)}")
def t16(spark, d):
    return _near(spark, d, "cosine")


@query("w6_normalised", f"select storage_key, round(importance_score / max(importance_score) over (partition by namespace), 9) share from {REC}")
def w6(spark, d):
    m = records(spark, d)
    top = m.groupBy("namespace").agg(F.max("importance_score").alias("top"))  # combined before the shuffle; no namespace is sorted
    return m.join(top, "namespace").select("storage_key", F.round(F.col("importance_score") / F.col("top"), 9).alias("share"))
