"""Queries over memory records: scores, filters, recall, aggregation, hygiene, rules, classification."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.functions import scoring as S
from memlake.functions.fixed_values import SECRETS
from memlake.functions.text import BLANK
from memlake.operators import analytics as A
from memlake.operators import ranks
from memlake.operators import recall as R
from memlake.operators.classify import summary_counts
from memlake.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW_PY = datetime(2026, 1, 15, tzinfo=timezone.utc)
SQL_NOW = "timestamptz '2026-01-15 00:00:00+00'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f

    return add


def records(spark: SparkSession, d: str) -> DataFrame:
    """One row per storage_key, with ``superseded`` derived for these tables."""
    m = table(spark, d, "memories").dropDuplicates(["storage_key"])
    return m.withColumn("superseded", F.col("access_count") % 10 == 9)


REC = "(select distinct on (storage_key) *, access_count % 10 = 9 as superseded from memories)"
AGE = f"greatest(0.0, (epoch_us({SQL_NOW}) - epoch_us(created_at)) / 1e6 / 86400.0)"


def _case(col: str, t: dict, default) -> str:
    return f"(case {col} " + " ".join(f"when '{k}' then {v}::double" for k, v in t.items()) + f" else {default}::double end)"


TW = _case("type", S.TYPE_WEIGHT, 1.0)
REL = _case("source_layer", S.SOURCE_RELIABILITY, 0.5)
IMP = f"round(confidence * {TW} * (0.3 + 0.7 * pow(0.5, {AGE} / 30.0)) * (1 + ln(1.0 + access_count) * 0.1), 6)"
QUAL = f"round(0.4*confidence + 0.3*least(access_count/10.0, 1.0) + 0.2*greatest(0.0, 1 - {AGE}/365.0) + 0.1*{REL}, 6)"
TIER = "(case when {0} >= 0.8 then 'excellent' when {0} >= 0.6 then 'good' when {0} >= 0.4 then 'fair' else 'poor' end)"
DEC0 = f"least(1.0, pow(0.5, {AGE} / (90.0 * {_case('type', S.HALF_LIFE_FACTOR, 1.0)})) + least(0.2, 0.02*access_count))"
DECAY = f"round(case when confidence < 0.3 then {DEC0} * 0.7 else {DEC0} end, 4)"


def now():
    return F.lit(NOW_PY)


def age():
    return S.age_days("created_at", now())


LIVE = "type <> 'session_summary' and not superseded and not paused"


@query("m4_importance", f"select storage_key, {IMP} importance from {REC}")
def m4(spark, d):
    return records(spark, d).select("storage_key", S.importance("confidence", "type", age(), "access_count").alias("importance"))


@query("m1_m3_factors", f"select storage_key, {TW} type_weight, round(0.3 + 0.7 * pow(0.5, {AGE}/30.0), 9) recency, round(1 + ln(1.0+access_count)*0.1, 9) access from {REC}")
def m1(spark, d):
    return records(spark, d).select("storage_key", S.type_weight("type").alias("type_weight"), F.round(S.recency_factor(age()), 9).alias("recency"), F.round(S.access_factor("access_count"), 9).alias("access"))


@query("m5_recalculated", f"select storage_key, round(least(1.0, greatest(0.0, 0.5*confidence + 0.3*least(1.0, version/10.0) + 0.1*least(1.0, 0.2*ln(1.0+access_count)) + 0.1*greatest(0.0, 1-{AGE}/365.0))), 6) recalculated from {REC}")
def m5(spark, d):
    return records(spark, d).select("storage_key", S.recalculated_confidence("confidence", F.col("version").cast("double"), "access_count", age()).alias("recalculated"))


@query("m6_decay", f"select storage_key, {DECAY} decay from {REC}")
def m6(spark, d):
    return records(spark, d).select("storage_key", S.decay_factor(age(), "type", "access_count", "confidence").alias("decay"))


@query("m7_quality", f"select storage_key, {QUAL} quality, {TIER.format(QUAL)} quality_tier from {REC}")
def m7(spark, d):
    q = S.quality_score("confidence", "access_count", age(), "source_layer")
    return records(spark, d).select("storage_key", q.alias("quality"), S.quality_tier(q).alias("quality_tier"))


@query("m8_m13_m14_misc", f"""select storage_key, round(confidence * pow(2.0, -0.1*{AGE}) * (1 + 0.5*sqrt(access_count)), 9) legacy,
  case when confidence > 0.5 then 'store' when confidence > 0.3 then 'defer' else 'ignore' end action, case when type in ('session_summary','task_pattern') then 'event' else 'state' end nature,
  least(importance_score + 0.05, 1.0) promoted from {REC}""")
def m8(spark, d):
    return records(spark, d).select("storage_key", F.round(S.legacy_weight("confidence", age(), "access_count"), 9).alias("legacy"), S.suggested_action("confidence").alias("action"), S.memory_nature("type").alias("nature"), S.promoted_importance("importance_score").alias("promoted"))


CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"
CJKH = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def _n(col: str, rx: str) -> str:
    return f"len(regexp_extract_all({col}, '{rx}'))"


@query("m11_m12_tokens", f"""select storage_key, greatest(1, {_n('content', CJK)} + floor((length(content) - {_n('content', CJK)})/4))::int tokens_a,
  greatest(1, floor({_n('content', CJKH)}/2.0 + (length(content) - {_n('content', CJKH)})/4.0))::int tokens_b from {REC}""")
def m11(spark, d):
    return records(spark, d).select("storage_key", L.token_estimate("content").alias("tokens_a"), L.token_estimate_rules("content").alias("tokens_b"))


_ND = r"len(regexp_extract_all(content, '\d{4}-\d{2}-\d{2}'))"
TEMP = f"(case when {_ND} > 0 then 0.4 + (case when {_ND} >= 2 then 0.15 else 0.0 end) + (case when type in ('fact_declaration','decision') then 0.1 else 0.0 end) else 0.0 end)::double"


@query("m9_m10_selection", f"""select storage_key, round({TEMP}, 6) bonus, round(0.7*importance_score + {_case('type', S.SELECTION_BOOST, 0.0)} + least(0.01*access_count, 0.1)
  * coalesce(pow(2.0, -0.1*greatest(0.0, (epoch_us({SQL_NOW}) - epoch_us(last_accessed_at))/1e6/86400.0)), 1.0) + {TEMP}, 6) score from {REC}""")
def m9(spark, d):
    b = L.temporal_bonus("content", "type")
    s = S.selection_score(F.col("importance_score"), F.lit(0.0), "type", "access_count", S.age_days("last_accessed_at", now()), b)
    return records(spark, d).select("storage_key", F.round(b, 6).alias("bonus"), F.round(s, 6).alias("score"))


@query("m17_expiry", f"select storage_key, epoch_us(created_at) + (case tier when 1 then 1 when 2 then 90 when 3 then 365 end) * 86400000000 expires_us from {REC}")
def m17(spark, d):
    return records(spark, d).select("storage_key", F.unix_micros(S.expiry("created_at", "tier")).alias("expires_us"))


@query("m18_throttle", f"select storage_key, last_accessed_at is null or epoch_us({SQL_NOW}) - epoch_us(last_accessed_at) >= 60000000 may_count from {REC}")
def m18(spark, d):
    return records(spark, d).select("storage_key", S.may_count_access("last_accessed_at", now()).alias("may_count"))


@query("m19_m20_hashes", f"select storage_key, substr(sha256(type || ':' || content), 1, 16) h1, substr(sha256(trim(regexp_replace(lower(content), '{BLANK}+', ' ', 'g'))), 1, 16) h2 from {REC}")
def m19(spark, d):
    return records(spark, d).select("storage_key", L.content_hash("type", "content").alias("h1"), L.normal_hash("content").alias("h2"))


# filters and scans
@query("s1_f1_recall_filter", f"select storage_key, namespace, type from {REC} where namespace in ('default', 'lab_regihe') and {LIVE} and tier = 3 and confidence >= 0.5 and created_at >= timestamptz '2024-06-01 00:00:00+00' and created_at < timestamptz '2025-12-01 00:00:00+00'")
def s1(spark, d):
    f = R.RecallFilter(namespaces=("default", "lab_regihe"), tier=3, confidence_min=0.5, created_after=datetime(2024, 6, 1, tzinfo=timezone.utc), created_before=datetime(2025, 12, 1, tzinfo=timezone.utc))
    return f.apply(records(spark, d)).select("storage_key", "namespace", "type")


@query("s2_key_lookup", f"select storage_key, namespace, type, version from {REC} where storage_key = (select max(storage_key) from memories where namespace = 'default')")
def s2(spark, d):
    m = records(spark, d)
    top = m.where("namespace = 'default'").agg(F.max("storage_key").alias("storage_key"))
    return m.join(F.broadcast(top), "storage_key", "left_semi").select("storage_key", "namespace", "type", "version")  # one row


@query("f1_session", f"select storage_key, metadata ->> '$.session_id' as session from {REC} where metadata ->> '$.channel' = 'cli'")
def f1(spark, d):
    m = records(spark, d).where(F.get_json_object("metadata", "$.channel") == "cli")
    return m.select("storage_key", F.get_json_object("metadata", "$.session_id").alias("session"))


TEXT3 = "lower(concat_ws(chr(0), content, raw_text, original_message))"


@query("s3_t2_full_text", f"select storage_key from {REC} where (contains(lower(content),'timeout') or contains(lower(coalesce(raw_text,'')),'timeout') or contains(lower(coalesce(original_message,'')),'timeout')) and (contains(lower(content),'export') or contains(lower(coalesce(raw_text,'')),'export') or contains(lower(coalesce(original_message,'')),'export'))")
def s3(spark, d):
    return R.full_text(records(spark, d), 'timeout "export" of').select("storage_key")


@query("f4_f5_like", f"select storage_key from {REC} where contains(lower(content),'100%') or contains(lower(content),'max_hops') or contains(lower(content), 'budget')")
def f5(spark, d):
    return R.contains_any(records(spark, d), ["100%", "max_hops", "Budget"], ("content",)).select("storage_key")


_QUOTED = [(k, p.replace("'", "''")) for k, p in SECRETS]


@query("f7_x8_secrets", "select storage_key, list_filter([" + ", ".join(f"case when regexp_matches(content, '{p}') then '{k}' end" for k, p in _QUOTED) + f"], lambda x: x is not null) kinds from {REC} where " + " or ".join(f"regexp_matches(content, '{p}')" for _, p in _QUOTED))
def f7(spark, d):
    return records(spark, d).where(L.has_secret("content")).select("storage_key", L.secret_kinds("content").alias("kinds"))


@query("f8_quality_filter", f"select storage_key, {QUAL} quality from {REC} where {QUAL} >= 0.6")
def f8(spark, d):
    return m7(spark, d).where("quality >= 0.6").select("storage_key", "quality")


@query("f9_floor", f"select storage_key, type from {REC} where confidence >= case type when 'user_preference' then 0.4 when 'sentiment_marker' then 0.5 else 0.6 end")
def f9(spark, d):
    return R.confidence_floor(records(spark, d), 0.6).select("storage_key", "type")


@query("f11_expired", f"select storage_key from {REC} where expires_at is not null and expires_at < {SQL_NOW}")
def f11(spark, d):
    return records(spark, d).where(F.col("expires_at") < now()).select("storage_key")


@query("f12_g14_decay_gate", f"select storage_key, importance_score * 0.5 as importance from {REC} where not superseded and importance_score < 0.6 and access_count = 0 and updated_at < timestamptz '2025-06-01 00:00:00+00'")
def f12(spark, d):
    m = records(spark, d).where(~F.col("superseded") & (F.col("importance_score") < 0.6) & (F.col("access_count") == 0) & (F.col("updated_at") < F.lit(datetime(2025, 6, 1, tzinfo=timezone.utc))))
    return m.select("storage_key", (F.col("importance_score") * 0.5).alias("importance"))


@query("proj2_cut", f"select storage_key, substr(content, 1, 100) preview, length(content) > 100 truncated from {REC}")
def p2cut(spark, d):
    return records(spark, d).select("storage_key", F.substring("content", 1, 100).alias("preview"), (F.length("content") > 100).alias("truncated"))


@query("proj3_subjects", f"select coalesce(metadata ->> '$.subject', version_chain_id, storage_key) subject, count(distinct storage_key) n from {REC} group by 1 having count(distinct storage_key) > 1")
def p3s(spark, d):
    return A.conflict_subject_counts(records(spark, d))


# recall
@query("t3_phases", f"""select storage_key, case when contains(t,'rollout') and contains(t,'ledger') then 1 else 2 end phase from (select storage_key, {TEXT3} t from {REC}) where contains(t,'rollout') or contains(t,'ledger')""")
def t3(spark, d):
    return R.phased_recall(records(spark, d), "the rollout of ledger", frozenset({"the", "of"})).select("storage_key", "phase")


@query("t5_t6_expansion", f"select storage_key from {REC} where contains(lower(content),'snapshot') or contains(lower(content),'archive')")
def t5(spark, d):
    m = records(spark, d)
    return R.contains_any(m, R.expand(m, "backups", {"backup": ["snapshot", "archive"], "port": ["socket"]}), ("content",)).select("storage_key")


_LT = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


@query("t11_t13_jaccard", f"""with x as (select storage_key, namespace, type, content, lag(content) over (partition by namespace, type order by created_at, storage_key) prev from {REC})
 select storage_key, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double, 9) sim from (select storage_key, {_LT.format('content')} a, {_LT.format('prev')} b from x where prev is not null)""")
def t11(spark, d):
    w = Window.partitionBy("namespace", "type").orderBy("created_at", "storage_key")
    m = records(spark, d).withColumn("prev", F.lag("content").over(w)).where("prev is not null")
    return m.select("storage_key", F.round(L.jaccard(L.word_tokens("content"), L.word_tokens("prev")), 9).alias("sim"))


@query("k1_top_importance", f"select storage_key, importance_score from {REC} where {LIVE} order by importance_score desc, confidence desc, storage_key limit 50")
def k1(spark, d):
    m = R.RecallFilter().apply(records(spark, d))
    return R.top_k(m, 50, F.desc("importance_score"), F.desc("confidence"), F.asc("storage_key")).select("storage_key", "importance_score")


@query("k2_time_range", f"select storage_key, epoch_us(created_at) created_us from {REC} where created_at >= timestamptz '2025-03-01 00:00:00+00' and created_at < timestamptz '2025-04-01 00:00:00+00' order by created_at desc, storage_key limit 100")
def k2(spark, d):
    m = records(spark, d).where((F.col("created_at") >= F.lit(datetime(2025, 3, 1, tzinfo=timezone.utc))) & (F.col("created_at") < F.lit(datetime(2025, 4, 1, tzinfo=timezone.utc))))
    return R.top_k(m, 100, F.desc("created_at"), F.asc("storage_key")).select("storage_key", F.unix_micros("created_at").alias("created_us"))


@query("k3_k4_timeline", f"select storage_key from (select * from {REC} where contains(lower(content),'migration') order by importance_score desc, storage_key limit 40) order by created_at, storage_key")
def k3(spark, d):
    m = R.top_k(R.contains_any(records(spark, d), ["migration"], ("content",)), 40, F.desc("importance_score"), F.asc("storage_key"))
    return m.orderBy("created_at", "storage_key").select("storage_key")


@query("k5_diversity", f"select storage_key, type from (select *, row_number() over (partition by namespace, type order by importance_score desc, storage_key) rn from {REC}) where type <> 'sentiment_marker' or rn <= 3")
def k5(spark, d):
    w = Window.partitionBy("namespace", "type").orderBy(F.desc("importance_score"), "storage_key")
    return records(spark, d).withColumn("rn", F.row_number().over(w)).where("type <> 'sentiment_marker' or rn <= 3").select("storage_key", "type")


@query("a3_w1_per_type", f"select namespace, type, storage_key, rn from (select *, (row_number() over (partition by namespace, type order by importance_score desc, created_at desc, storage_key))::int rn from {REC}) where rn <= 3")
def a3(spark, d):
    m = R.limit_per(records(spark, d), 3, ["namespace", "type"], F.desc("importance_score"), F.desc("created_at"), F.asc("storage_key"))
    return m.select("namespace", "type", "storage_key", "rn")


@query("k10_w5_budget", f"""select storage_key, tokens, used from (select storage_key, namespace, tokens, sum(tokens) over (partition by namespace order by importance_score desc, storage_key rows unbounded preceding)::bigint used
 from (select *, greatest(1, {_n('content', CJK)} + floor((length(content) - {_n('content', CJK)})/4))::int tokens from {REC})) where used <= 2000""")
def k10(spark, d):
    m = records(spark, d).withColumn("tokens", L.token_estimate("content"))
    return R.within_budget(m, 2000, "tokens", F.col("importance_score"), "storage_key").select("storage_key", "tokens", "used")


@query("w7_session_first", f"""with x as (select *, coalesce(metadata ->> '$.session_id', storage_key) sess from {REC}), y as (select *, row_number() over (partition by namespace, sess order by importance_score desc, storage_key) nth from x)
 select storage_key, (row_number() over (partition by namespace order by nth > 1, importance_score desc, storage_key))::int "position" from y""")
def w7(spark, d):
    m = records(spark, d).select("storage_key", "namespace", "importance_score", F.coalesce(F.get_json_object("metadata", "$.session_id"), "storage_key").alias("session"))
    return R.session_first(m, F.desc("importance_score"), F.asc("storage_key")).select("storage_key", "position")


@query("k9_type_priority", f"select storage_key, row_number() over (partition by namespace order by case when type in ('correction','decision') then 0 when type = 'user_preference' then 1 else 2 end, importance_score desc, storage_key)::int pos from {REC}")
def k9(spark, d):
    p = F.when(F.col("type").isin("correction", "decision"), 0).when(F.col("type") == "user_preference", 1).otherwise(2)
    m = records(spark, d).select("storage_key", "namespace", p.alias("p"), "importance_score")
    return ranks.ranked(m, ["namespace"], [F.asc("p"), F.desc("importance_score"), F.asc("storage_key")], "pos").select("storage_key", "pos")


@query("t18_rrf", f"""with a as (select storage_key, row_number() over (order by importance_score desc, storage_key) r from {REC} where {LIVE} order by importance_score desc, storage_key limit 200),
 b as (select storage_key, row_number() over (order by created_at desc, storage_key) r from {REC} where {LIVE} order by created_at desc, storage_key limit 200)
 select u.storage_key, round(sum(s) * {_case('any_value(m.type)', S.RRF_BOOST, 1.0)}, 9) rrf from (select storage_key, 0.6/(60+r) s from a union all select storage_key, 0.4/(60+r) from b) u join {REC} m on m.storage_key = u.storage_key group by 1""")
def t18(spark, d):
    m = R.RecallFilter().apply(records(spark, d)).select("storage_key", "type", "importance_score", "created_at")
    a = R.ranked(m, F.desc("importance_score"), F.asc("storage_key"), k=200)
    b = R.ranked(m, F.desc("created_at"), F.asc("storage_key"), k=200)
    fused = R.reciprocal_rank_fusion([(a, 0.6), (b, 0.4)], "storage_key")
    out = fused.join(m.select("storage_key", "type"), "storage_key")
    return out.select("storage_key", F.round(F.col("rrf") * S.by_value("type", S.RRF_BOOST, 1.0), 9).alias("rrf"))


@query("t21_modes", f"""with a as (select storage_key, row_number() over (order by importance_score desc, storage_key) r from {REC} where {LIVE} order by importance_score desc, storage_key limit 60),
 b as (select storage_key, row_number() over (order by created_at desc, storage_key) r from {REC} where {LIVE} order by created_at desc, storage_key limit 60), u as (select *, 0 n, 'importance' m from a union all select *, 1, 'time' from b)
 select storage_key, arg_min(m, n) as mode, arg_min(r, n)::int as rank, list_sort(list_distinct(list(m))) modes from u group by 1""")
def t21(spark, d):
    m = R.RecallFilter().apply(records(spark, d)).select("storage_key", "importance_score", "created_at")
    a = R.ranked(m, F.desc("importance_score"), F.asc("storage_key"), k=60)
    b = R.ranked(m, F.desc("created_at"), F.asc("storage_key"), k=60)
    return R.first_seen([("importance", a), ("time", b)], "storage_key")


@query("k11_mmr")
def k11(spark, d):
    m = R.RecallFilter().apply(records(spark, d)).withColumn("tok", L.mixed_tokens("content"))
    return R.mmr(m, 10, "namespace", "importance_score", "tok", "storage_key")


# aggregation
@query("a1_a4_counts", f"select type, count(*) n, count(*) filter (where namespace = 'default') n_default from {REC} group by type")
def a1(spark, d):
    return records(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("namespace") == "default").alias("n_default"))


@query("a2_profile", f"select type, tier, grouping(type, tier)::bigint set_no, count(*) n, round(avg(confidence), 4) avg_confidence, max(updated_at) last_update from {REC} group by grouping sets ((type), (tier), ())")
def a2(spark, d):
    return A.profile(records(spark, d))


@query("a2_rollup_extension", f"select namespace, type, count(*) n from {REC} group by rollup (namespace, type)")
def a2r(spark, d):
    return records(spark, d).rollup("namespace", "type").agg(F.count("*").alias("n"))


@query("a11_quality", f"select type, round(avg(q),6) mean, round(median(q),6) median, min(q) low, max(q) high, " + ", ".join(f"count(*) filter (where {TIER.format('q')} = '{t}') {t}" for t in ("excellent", "good", "fair", "poor")) + f" from (select type, {QUAL} q from {REC}) group by type")
def a11(spark, d):
    q = S.quality_score("confidence", "access_count", age(), "source_layer")
    return A.quality_analysis(records(spark, d).withColumn("quality", q))


@query("a10_tags", f"select tag, count(*) n from (select metadata ->> '$.channel' tag from {REC}) where tag is not null group by tag order by n desc, tag limit 10")
def a10(spark, d):
    return A.json_tags(records(spark, d), "metadata", "$.channel", 10)


@query("a17_summary", f"select type, tier, count(*) n, round(avg(confidence),6) avg_confidence from {REC} group by type, tier")
def a17(spark, d):
    return summary_counts(records(spark, d))


@query("a19_dominant_type", f"select namespace, arg_min(type, (-n, type)) dominant from (select namespace, type, count(*) n from {REC} group by 1, 2) group by namespace")
def a19(spark, d):
    c = records(spark, d).groupBy("namespace", "type").agg(F.count("*").alias("n"))
    return c.groupBy("namespace").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("dominant"))


@query("k15_low_quality", f"""select storage_key, q quality, list_sort(list_filter([case when confidence < 0.5 then 'low confidence' end, case when access_count = 0 then 'never used' end, case when {AGE} > 365 then 'old' end], lambda x: x is not null)) reasons
 from (select *, {QUAL} q from {REC}) where q < 0.5""")
def k15(spark, d):
    m = records(spark, d).withColumn("quality", S.quality_score("confidence", "access_count", age(), "source_layer")).where("quality < 0.5")
    why = F.array_sort(F.array_compact(F.array(F.when(F.col("confidence") < 0.5, F.lit("low confidence")), F.when(F.col("access_count") == 0, F.lit("never used")), F.when(age() > 365, F.lit("old")))))
    return m.select("storage_key", "quality", why.alias("reasons"))


# hygiene
@query("d1_dedup_hash", f"""with x as (select *, substr(sha256(type || ':' || content), 1, 16) h from {REC})
 select namespace, arg_min(storage_key, (created_at, storage_key)) storage_key, count(*) n,
 case when trim(coalesce(arg_min(coalesce(raw_text,''), (created_at, storage_key)),'')) <> '' then arg_min(coalesce(raw_text,''), (created_at, storage_key)) else arg_min(raw_text, (created_at, storage_key)) filter (where trim(coalesce(raw_text,'')) <> '') end raw_text from x group by namespace, h""")
def d1(spark, d):
    return A.dedup_by_hash(records(spark, d))


@query("j12_q3_jaccard_pairs", f"""with x as (select storage_key, namespace, type, {_LT.format('content')} t from {REC})
 select a.storage_key key_a, b.storage_key key_b, round(len(list_intersect(a.t,b.t)) / (len(a.t)+len(b.t)-len(list_intersect(a.t,b.t)))::double, 9) similarity from x a join x b on a.namespace = b.namespace and a.type = b.type and a.storage_key < b.storage_key
 where least(len(a.t), len(b.t)) >= 0.8*greatest(len(a.t), len(b.t)) and len(list_intersect(a.t,b.t)) / (len(a.t)+len(b.t)-len(list_intersect(a.t,b.t)))::double >= 0.8 - 1e-9""")
def j12(spark, d):
    m = records(spark, d).withColumn("tok", L.word_tokens("content"))
    return A.jaccard_pairs(m, "storage_key", "tok", ["namespace", "type"], 0.8).withColumn("similarity", F.round("similarity", 9))


@query("j13_w3_adjacent", f"""select older_key, newer_key from (select lag(storage_key) over (partition by namespace, type, h order by created_at, storage_key) older_key, storage_key newer_key from
 (select *, substr(sha256(substr(trim(regexp_replace(lower(content), '{BLANK}+', ' ', 'g')), 1, 100)), 1, 16) h from {REC})) where older_key is not null""")
def j13(spark, d):
    return A.adjacent_updates(records(spark, d))


@query("d17_consolidate", f"""select storage_key, dc decay, round(confidence*dc, 6) new_confidence, case when type = 'user_preference' then 'keep' when dc < 0.1 then 'forget' when dc < 0.5 then 'decay' else 'keep' end as action from (select *, {DECAY} dc from {REC})""")
def d17(spark, d):
    return A.consolidation(records(spark, d), now())


@query("d5_d11_flags", f"select storage_key, paused or superseded hidden, case when superseded then version_chain_id end supersedes from {REC}")
def d5(spark, d):
    return records(spark, d).select("storage_key", (F.col("paused") | F.col("superseded")).alias("hidden"), F.when(F.col("superseded"), F.col("version_chain_id")).alias("supersedes"))


@query("d10_forget_expired", f"select storage_key from {REC} where expires_at is null or expires_at >= {SQL_NOW}")
def d10(spark, d):
    return records(spark, d).where(F.col("expires_at").isNull() | (F.col("expires_at") >= now())).select("storage_key")


@query("d14_merge", f"select h, arg_max(storage_key, (created_at, storage_key)) kept, count(distinct namespace) n_namespaces from (select *, substr(sha256(type || ':' || content), 1, 16) h from {REC}) group by h")
def d14(spark, d):
    return A.merge_sources(records(spark, d), "latest_wins")


@query("d16_repeat_upgrade", f"select namespace, h, count(*) n, case when count(*) >= 3 then 'hard' when count(*) >= 2 then 'soft' else 'none' end as level from (select namespace, substr(sha256(trim(regexp_replace(lower(content), '{BLANK}+', ' ', 'g'))), 1, 16) h from {REC} where type = 'correction') group by 1, 2")
def d16(spark, d):
    g = records(spark, d).where("type = 'correction'").groupBy("namespace", L.normal_hash("content").alias("h")).agg(F.count("*").alias("n"))
    return g.withColumn("level", F.when(F.col("n") >= 3, "hard").when(F.col("n") >= 2, "soft").otherwise("none"))


@query("u2_union_tagged", f"select 'memory' as source, storage_key id, namespace from {REC} union all select 'message', id, null from (select distinct id from en) union all select 'document', doc_id::varchar, namespace from documents")
def u2(spark, d):
    a = records(spark, d).select(F.lit("memory").alias("source"), F.col("storage_key").alias("id"), "namespace")
    b = table(spark, d, "en").select("id").distinct().withColumn("source", F.lit("message"))
    c = table(spark, d, "documents").select(F.lit("document").alias("source"), F.col("doc_id").cast("string").alias("id"), "namespace")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c)


@query("u7_prefix_dedup", f"select namespace, min(storage_key) kept, count(*) n from {REC} group by namespace, lower(substr(content, 1, 100))")
def u7(spark, d):
    return records(spark, d).groupBy("namespace", F.lower(F.substring("content", 1, 100)).alias("p")).agg(F.min("storage_key").alias("kept"), F.count("*").alias("n")).drop("p")


@query("u3_except", f"select storage_key from {REC} where storage_key not in (select storage_key from memory_snapshots)")
def u3(spark, d):
    return records(spark, d).join(table(spark, d, "memory_snapshots"), "storage_key", "left_anti").select("storage_key")


# text functions
@query("x1_x2_language", f"select storage_key, regexp_matches(content, '{CJK}') cjk, case when regexp_matches(content, '[\\x{{3040}}-\\x{{30ff}}]') then 'ja' when regexp_matches(content, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]') then 'zh' else 'en' end lang from {REC}")
def x1(spark, d):
    return records(spark, d).select("storage_key", L.has_cjk("content").alias("cjk"), L.script_language("content").alias("lang"))


@query("x7_dates", f"select storage_key, list_sort(list_distinct(regexp_extract_all(content, '\\d{{4}}-\\d{{2}}-\\d{{2}}'))) dates from {REC}")
def x7(spark, d):
    return records(spark, d).select("storage_key", F.array_sort(L.event_dates("content")).alias("dates"))


@query("x9_summary", f"select storage_key, substr(regexp_extract(content, '^([^.!?\\n]*[.!?]?)', 1), 1, 120) brief from {REC}")
def x9(spark, d):
    return records(spark, d).select("storage_key", L.summary("content", 2).alias("brief"))


@query("x12_x22_unsafe", f"select storage_key, regexp_matches(content, '(\\.\\./)') traversal, length(content) > 400 as long_text from {REC}")
def x12(spark, d):
    u = L.unsafe_categories("content", 400)
    return records(spark, d).select("storage_key", F.array_contains(u, "traversal").alias("traversal"), F.array_contains(u, "length").alias("long_text"))


@query("x15_json", f"select storage_key, metadata ->> '$.channel' channel from {REC} where metadata is not null")
def x15(spark, d):
    m = records(spark, d).where("metadata is not null")
    return m.select("storage_key", F.get_json_object(L.json_set("metadata", "decayed", F.lit("true")), "$.channel").alias("channel"))


@query("x17_keywords", f"select storage_key, list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z]{{3,}}'))) words from {REC} where not regexp_matches(content, '{CJK}')")
def x17(spark, d):
    m = records(spark, d).where(~L.has_cjk("content"))
    return m.select("storage_key", F.array_sort(L.keywords("content", 2**31 - 1)).alias("words"))


@query("x17_all_keywords")
def x17_all(spark, d):
    """As x17_keywords, with the records that hold CJK characters."""
    return records(spark, d).select("storage_key", F.array_sort(L.keywords("content", 2**31 - 1)).alias("words"))


@query("x18_negation", f"select storage_key from {REC} where regexp_matches(lower(content), '(^|[^a-z])(not|never|don''t|no longer|avoid|stop)($|[^a-z])')")
def x18(spark, d):
    return records(spark, d).where(L.negated("content")).select("storage_key")


@query("x19_encrypt", f"select storage_key, content from {REC}")
def x19(spark, d):
    key = F.lit("0123456789abcdef")
    m = records(spark, d).withColumn("sealed", F.aes_encrypt("content", key))
    return m.select("storage_key", F.aes_decrypt("sealed", key).cast("string").alias("content"))


@query("x21_confirmation", "select id, regexp_matches(lower(trim(message)), '^(yes|yeah|yep|ok|okay|sure|agreed|confirmed|sounds good|do it|好的|对|はい|네)\\b?[ .!。]*$') confirm from (select distinct on (id) * from en) where message is not null")
def x21(spark, d):
    e = table(spark, d, "en").dropDuplicates(["id"]).where("message is not null")
    return e.select("id", L.confirmation("message").alias("confirm"))
