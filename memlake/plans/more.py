"""Queries over text search, prompts and maintenance, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.operators import analytics as A
from memlake.operators import graph as G
from memlake.operators import prompt as P
from memlake.operators import ranks
from memlake.operators import search as S
from memlake.plans.records import AGE, CJK, DECAY, REC, _n, age, now, records
from memlake.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f

    return add


_TOK = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"


@query("t20_bm25", f"""with d as (select storage_key, {_TOK} t from {REC}), s as (select count(*) n, avg(len(t)) a from d), h as (select storage_key, len(t) l, w, count(*) tf from (select storage_key, t, unnest(t) w from d) where w in ('rollout','ledger','budget') group by 1, 2, 3),
 f as (select w, count(*) df from h group by 1) select storage_key, round(sum(ln(1 + (s.n - f.df + 0.5)/(f.df + 0.5)) * tf * 2.2 / (tf + 1.2*(0.25 + 0.75*l/s.a))), 6) bm25 from h join f using (w), s group by 1""")
def t20(spark, d):
    return S.bm25(records(spark, d), "storage_key", S.all_word_tokens("content"), ["rollout", "ledger", "budget"])


@query("t10_merger", f"""with o as (select storage_key from {REC} where contains(lower(content), 'rollout')), e as (select storage_key, round(0.8 * 0.9 * (0.5 + 0.5*confidence), 6) s from {REC} where contains(lower(content), 'release'))
 select storage_key, case when storage_key in (select storage_key from o) then 1.0::double else s::double end score, case when storage_key in (select storage_key from o) then 'original' else 'expanded' end as source from (select storage_key, null s from o union all select storage_key, s from e where s >= 0.3 and storage_key not in (select storage_key from o))""")
def t10(spark, d):
    m = records(spark, d)
    e = m.where(F.contains(F.lower("content"), F.lit("release"))).select("storage_key", "confidence", F.lit(0.8).alias("weight"), F.lit(0.9).alias("overlap"))
    return S.merge_results(m.where(F.contains(F.lower("content"), F.lit("rollout"))), e, "storage_key")


@query("g1_g4_entities", f"select storage_key, 'tool' kind, unnest(list_distinct(regexp_extract_all(content, '\\b[a-z]+-(?:hub|cli|lint|sync|forge)\\b'))) entity from {REC}")
def g1(spark, d):
    return S.entities(records(spark, d), "storage_key", "content").where("kind = 'tool'")


@query("g1_g4_all_entities")
def g1_all(spark, d):
    """As g1_g4_entities, of all four kinds."""
    return S.entities(records(spark, d), "storage_key", "content")


VOCABULARY = {"ops": ("rollout", "pipeline", "cluster"), "data": ("schema", "migration", "index"), "art": ("zzzz",)}


@query("a18_x4_domains", "select * from (" + " union all ".join(f"select '{k}' as domain, sum({' + '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})::bigint' for w in ws)})::bigint hits from {REC}" for k, ws in VOCABULARY.items()) + ") where hits >= 2")
def a18(spark, d):
    return S.domain_histogram(records(spark, d), "content", VOCABULARY)


@query("f10_x5_scope", f"select storage_key from {REC} where type <> 'user_preference' or confidence >= 0.9 or not (regexp_matches(lower(content), 'rollout|release') or regexp_matches(lower(content), 'schema|index')) or regexp_matches(lower(content), 'schema|index')")
def f10(spark, d):
    return S.scope_filter(records(spark, d), "content", {"deploy": "rollout|release", "data": "schema|index"}, ["data"]).select("storage_key")


@query("q4_leader_groups")
def q4(spark, d):
    m = records(spark, d).where("type = 'user_preference'").withColumn("tok", L.space_tokens("content"))
    return S.near_groups(m, ["namespace"], "storage_key", "tok", 0.4)


@query("q2_outdated", f"""with x as (select storage_key, namespace, type, created_at, list_distinct(regexp_extract_all(lower(content), '\\S+')) t, regexp_matches(lower(content), '(^|[^a-z0-9_])(now|currently|switched|changed|moved|updated|no longer|instead|replaced|new)($|[^a-z0-9_])') u from {REC})
 select count(*) n from x a join x b on a.namespace = b.namespace and a.type = b.type and a.created_at < b.created_at and b.u and len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::double >= 0.5""")
def q2(spark, d):
    m = records(spark, d).withColumn("tok", L.space_tokens("content"))
    p = A.jaccard_pairs(m, "storage_key", "tok", ["namespace", "type"], 0.5)
    side = lambda s: m.select(F.col("storage_key").alias(f"key_{s}"), F.col("created_at").alias(f"at_{s}"), A.is_update("content").alias(f"u_{s}"))
    x = p.join(side("a"), "key_a").join(side("b"), "key_b")
    return x.where("(at_a < at_b and u_b) or (at_b < at_a and u_a)").agg(F.count("*").alias("n"))


@query("x14_rendering", f"""select storage_key, case when superseded then '- NOTE: "' || substr(content, 1, 80) || '" is outdated' || d when type = 'user_preference' then '- [IMPORTANT] The user prefers: ' || content when type = 'correction' then '- Do not repeat: ' || content || d
 when type = 'decision' then '- Always follow: ' || content || d else '- ' || content || d end line from (select *, ' (' || strftime(created_at at time zone 'UTC', '%Y-%m-%d') || ')' d from {REC})""")
def x14(spark, d):
    return records(spark, d).select("storage_key", P.rendered().alias("line"))


_TOKENS = f"greatest(1, {_n('content', CJK)} + floor((length(content) - {_n('content', CJK)})/4))::int"


@query("e8_e12_prompt", f"""with x as (select *, case when superseded then 'outdated' when type in ('correction','decision','user_preference') then 'mandatory' when confidence >= 0.8 then 'important' else 'optional' end bucket, {_TOKENS} tok from {REC}),
 y as (select *, row_number() over (partition by namespace, bucket order by importance_score desc, storage_key) nth from x), z as (select *, case bucket when 'mandatory' then 0 when 'important' then 1 when 'optional' then 2 else 3 end o from y where bucket <> 'outdated' or nth <= 3)
 select namespace, bucket, storage_key, "position", used from (select namespace, bucket, storage_key, (row_number() over w)::int "position", (sum(tok) over (partition by namespace order by o, nth, storage_key rows unbounded preceding))::bigint used from z window w as (partition by namespace order by o, nth, storage_key)) where used <= 1000""")
def e8(spark, d):
    return P.prompt_lines(records(spark, d), 1000)


@query("e7_shortened", f"""with x as (select *, (type in ('correction','decision'))::int p from {REC}), y as (select *, coalesce(sum(length(content)) over (partition by namespace order by p desc, storage_key rows between unbounded preceding and 1 preceding), 0) before from x)
 select namespace, storage_key, substr(content, 1, greatest(0, 1500 - before)::int) shown from y where length(content) <= greatest(0, 1500 - before) or (p = 1 and 1500 - before > 0)""")
def e7(spark, d):
    return P.shortened(records(spark, d), 1500, "namespace", "storage_key", "content", F.col("type").isin("correction", "decision"))


@query("q9_hints", f"""with h as (select namespace, storage_key, 'stale' hint, -0.05::double change from {REC} where {AGE} > 500 union all select namespace, storage_key, 'conflict', -0.10::double from {REC} where superseded)
 select namespace, storage_key, hint, change from (select *, row_number() over (partition by namespace order by change, storage_key) rn from h) where rn <= 20""")
def q9(spark, d):
    m = records(spark, d)
    return P.hints(m, age() > 500, m.where("superseded"))


@query("q10_q11_proposals", f"select storage_key, 'expire_projection' proposal, 'low' risk, 7 grace_days from {REC} where round(confidence * {DECAY}, 6) < 0.1")
def q10(spark, d):
    return P.proposals(A.consolidation(records(spark, d), now()))


@query("d12_st5_access_log", "with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) p from events) select user_id::varchar storage_key, count(*) filter (where p is null or epoch_us(ts) - epoch_us(p) >= 60000000) access_count from l group by 1")
def d12(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("storage_key"), "ts")
    return P.access_log(log.select("storage_key", F.lit(0).alias("access_count")).distinct(), log, "ts")


@query("d9_cascade", f"""select (select count(*) from {REC} where not paused) n_records, (select count(*) from (select distinct on (id) * from memory_entities) where memory_key is null or memory_key not in (select storage_key from memories where paused)) n_mentions""")
def d9(spark, d):
    gone = table(spark, d, "memories").where("paused").select("storage_key")
    kept = records(spark, d).where(~F.col("paused")).agg(F.count("*").alias("n_records"))
    return kept.crossJoin(G.cascade_delete(table(spark, d, "memory_entities").dropDuplicates(["id"]), gone, "memory_key").agg(F.count("*").alias("n_mentions")))  # one row each


@query("a14_status", f"select suggested_action, source_layer, count(*) n from {REC} group by 1, 2")
def a14(spark, d):
    return records(spark, d).groupBy("suggested_action", "source_layer").agg(F.count("*").alias("n"))


@query("a20_whoami", f"with c as (select namespace, type, count(*) n, round(avg(confidence), 6) a from {REC} group by 1, 2) select namespace, arg_min(type, (-n, type)) top_type, sum(n)::bigint n from c group by 1")
def a20(spark, d):
    c = records(spark, d).groupBy("namespace", "type").agg(F.count("*").alias("n"))
    return c.groupBy("namespace").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("top_type"), F.sum("n").alias("n"))


@query("a24_token_total", f"select namespace, sum({_TOKENS})::bigint tokens from {REC} group by 1")
def a24(spark, d):
    return records(spark, d).groupBy("namespace").agg(F.sum(L.token_estimate("content")).alias("tokens"))


@query("k8_drop_order", f"select storage_key, (row_number() over (partition by namespace order by tier, created_at, importance_score desc, storage_key))::int drop_no from {REC}")
def k8(spark, d):
    m = records(spark, d).select("storage_key", "namespace", "tier", "created_at", "importance_score")
    return ranks.ranked(m, ["namespace"], [F.asc("tier"), F.asc("created_at"), F.desc("importance_score"), F.asc("storage_key")], "drop_no").select("storage_key", "drop_no")


@query("proj4_score", f"select storage_key, coalesce((recall_hint ->> '$.score')::double, (recall_hint ->> '$.boost')::double, importance_score, confidence) score from {REC}")
def p4score(spark, d):
    hint = lambda k: F.get_json_object("recall_hint", f"$.{k}").cast("double")
    return records(spark, d).select("storage_key", F.coalesce(hint("score"), hint("boost"), "importance_score", "confidence").alias("score"))


@query("u6_distinct_entities", "select distinct lower(entity_text) entity, entity_type from memory_entities")
def u6(spark, d):
    return table(spark, d, "memory_entities").select(F.lower("entity_text").alias("entity"), "entity_type").distinct()


@query("w11_preload", f"select namespace, storage_key from (select *, row_number() over (partition by namespace order by importance_score desc, storage_key) rn from {REC} where not paused and not superseded) where rn <= 10")
def w11(spark, d):
    from memlake.operators.recall import limit_per

    return limit_per(records(spark, d).where(~F.col("paused") & ~F.col("superseded")), 10, ["namespace"], F.desc("importance_score"), F.asc("storage_key")).select("namespace", "storage_key")

