"""Queries that combine retrieval modes, and those of the write path, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.functions import scoring as S
from memlake.functions.fixed_values import SECRETS
from memlake.operators import analytics as A
from memlake.operators import graph as G
from memlake.operators import prompt as P
from memlake.operators import recall as R
from memlake.operators import search as X
from memlake.operators import vectors as V
from memlake.operators import writing as W
from memlake.plans.records import AGE, CJK, DECAY, IMP, LIVE, REC, SQL_NOW, _case, _n, age, now, records
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


# documents as records; their vectors have the same numbers
WORDS = ("rollout", "timeout")
K = 100
_DOCS = "(select distinct on (doc_id) doc_id, text, title, namespace, doc_kind, created_at, ['correction','decision','user_preference','fact_declaration','relationship','task_pattern','sentiment_marker','session_summary'][1 + doc_id % 8] as type from documents)"
_D = "sqrt(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))"


def documents(spark: SparkSession, d: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in ("correction", "decision", "user_preference", "fact_declaration", "relationship", "task_pattern", "sentiment_marker", "session_summary")])
    t = table(spark, d, "documents").select("doc_id", "text", "title", "namespace", "doc_kind", "created_at").dropDuplicates(["doc_id"])
    return t.withColumn("type", F.element_at(types, (1 + F.col("doc_id") % 8).cast("int")))


def joined(spark: SparkSession, d: str) -> DataFrame:
    return V.with_vectors(documents(spark, d), table(spark, d, "embeddings"), "doc_id")


@query("j2_records_with_vectors", f"select type, count(*) n, round(avg(len(embedding)), 3) dims from {_DOCS} join embeddings on vec_id = doc_id group by 1")
def j2(spark, d):
    return joined(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.size("embedding")), 3).alias("dims"))


_TEXT = f"(select doc_id, row_number() over (order by created_at desc, doc_id) r from {_DOCS} where " + " and ".join(f"contains(lower(text), '{w}')" for w in WORDS) + f" order by created_at desc, doc_id limit {K})"
_VEC = f"(select doc_id, row_number() over (order by dist, doc_id) r from (select v.vec_id doc_id, round({_D}, 9) dist from embeddings q, embeddings v join {_DOCS} on doc_id = v.vec_id where q.vec_id = 0) order by dist, doc_id limit {K})"


def text_ranked(spark, d) -> DataFrame:
    hit = R.full_text(documents(spark, d).select("doc_id", "text", "created_at"), " ".join(WORDS), ("text",))
    return R.ranked(hit, F.desc("created_at"), F.asc("doc_id"), k=K).select("doc_id", "rank")


def vector_ranked(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    mine = joined(spark, d).select("doc_id", "embedding")
    near = V.nearest_all(mine, e.where("vec_id = 0").select(F.col("vec_id").alias("doc_id"), "embedding"), K, key="doc_id")
    return R.ranked(near.select("doc_id", F.round("dist", 9).alias("dist")), F.asc("dist"), F.asc("doc_id"), k=K).select("doc_id", "rank")


_HYBRID = f"""(select doc_id, sum(s) s from (select doc_id, 0.6/(60+r) s from {_TEXT} union all select doc_id, 0.4/(60+r) from {_VEC}) group by 1)"""
_HYBRID_RANKED = f"""(with u as (select doc_id, min(r) r from (select doc_id, r from {_TEXT} union all select doc_id, r from {_VEC}) group by 1), b as (select (select count(*) from {_TEXT}) > 0 and (select count(*) from {_VEC}) > 0 as two)
 select doc_id, score, (row_number() over (order by score desc, doc_id))::int "position" from (select doc_id, round(case when two then s else -r::double end, 9) score from {_HYBRID} join u using (doc_id), b))"""


@query("t19_hybrid", f"select * from {_HYBRID_RANKED}")
def t19(spark, d):
    return V.hybrid(text_ranked(spark, d), vector_ranked(spark, d), "doc_id")


_TIME = f"(select doc_id, row_number() over (order by created_at desc, doc_id) r from {_DOCS} order by created_at desc, doc_id limit {K})"
_SAME = f"(select doc_id, row_number() over (order by created_at desc, doc_id) r from {_DOCS} where lower(title) = (select min(lower(title)) from documents where trim(title) <> '') order by created_at desc, doc_id limit {K})"
_LINKED = f"""(select doc_id, row_number() over (order by created_at desc, doc_id) r from {_DOCS} where namespace in (select namespace from {_DOCS} where lower(title) = (select min(lower(title)) from documents where trim(title) <> '')) order by created_at desc, doc_id limit {K})"""


@query("e4_multi_mode", f"""with u as (select *, 0 n, 'fts' m from {_TEXT} union all select *, 1, 'vector' from {_VEC} union all select doc_id, "position", 2, 'hybrid' from {_HYBRID_RANKED} where "position" <= {K} union all select *, 3, 'graph' from {_LINKED} union all select *, 4, 'time' from {_TIME} union all select *, 5, 'entity' from {_SAME})
 select doc_id, arg_min(m, n) as mode, arg_min(r, n)::int as rank, list_sort(list_distinct(list(m))) modes from u group by 1""")
def e4(spark, d):
    """All six modes: text, vectors, both fused, records linked through the entity's namespaces, newest, records of the entity."""
    docs = documents(spark, d).select("doc_id", "title", "namespace", "created_at")
    newest = lambda rows: R.ranked(rows, F.desc("created_at"), F.asc("doc_id"), k=K)
    one = docs.where(F.trim("title") != "").agg(F.min(F.lower("title")).alias("e"))  # one row
    same = docs.join(F.broadcast(one), F.lower("title") == F.col("e"), "left_semi")
    both = V.hybrid(text_ranked(spark, d), vector_ranked(spark, d), "doc_id").where(F.col("position") <= K).select("doc_id", F.col("position").alias("rank"))
    linked = docs.join(same.select("namespace").distinct(), "namespace", "left_semi")
    return R.first_seen([("fts", text_ranked(spark, d)), ("vector", vector_ranked(spark, d)), ("hybrid", both), ("graph", newest(linked)), ("time", newest(docs)), ("entity", newest(same))], "doc_id")


# semantic recall: expansions are a table (here of a few rows)
_EXPANSIONS = (("deploy", "rollout"), ("deploy", "release"), ("deploy", "pipeline"), ("data", "schema"), ("data", "migration"), ("data", "index"), ("storage", "backup"), ("storage", "snapshot"))
_SYN = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in _EXPANSIONS) + ") e(k, v)"


@query("t5_t9_semantic", rf"""select v as term, count(*) n from (select distinct v from {_SYN} where k in ('deploy', 'data')) t join (select storage_key, unnest(list_distinct(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'))) w from {REC}) r on r.w = t.v group by 1""")
def t9(spark, d):
    """Records that hold any expansion of the words asked for, by an equi join on words."""
    a = spark.createDataFrame(_EXPANSIONS, "k string, v string")
    terms = X.expansions(a, spark.createDataFrame([("deploy",), ("data",)], "k string"))
    return X.by_terms(records(spark, d), "storage_key", "content", terms).groupBy("term").agg(F.countDistinct("storage_key").alias("n"))


_WORD = "unnest(list_distinct(regexp_extract_all(lower({0}), '[a-z]{{4,12}}')))"


@query("t7_spelling", f"""with v as (select w from (select storage_key, {_WORD.format('content')} w from {REC}) group by w having count(*) >= 20), q as (select distinct w from (select {_WORD.format('message')} w from en)),
 u as (select w from q where w not in (select w from v)) select u.w word, arg_min(v.w, (levenshtein(u.w, v.w), v.w)) fixed from u, v where abs(length(u.w) - length(v.w)) <= 2 and levenshtein(u.w, v.w) <= 2 group by u.w""")
def t7(spark, d):
    """Words of the messages that are no words of the records, with the nearest word of these within two edits."""
    words = lambda c: F.explode(F.array_distinct(L.matches(F.lower(c), "[a-z]{4,12}")))
    v = records(spark, d).select("storage_key", words("content").alias("v")).groupBy("v").agg(F.count("*").alias("n")).where("n >= 20").select("v")
    return X.spelling(table(spark, d, "en").select(words("message").alias("word")), v)


@query("t4_context", f"""with p as (select namespace, storage_key, list_distinct(regexp_extract_all(lower(content), '\\S+')) w, row_number() over (partition by namespace order by importance_score desc, storage_key) r from {REC} where type in ('user_preference','decision','fact_declaration') and not superseded),
 e as (select distinct namespace, x from (select namespace, unnest(w) x from p where r <= 5 and list_has_any(w, ['the', 'budget'])) where x not in ('the', 'budget') and length(x) > 2)
 select namespace, 'the budget ' || string_agg(x, ' ' order by x) query from (select *, row_number() over (partition by namespace order by x) n from e) where n <= 5 group by 1""")
def t4(spark, d):
    return X.rebuilt_queries(records(spark, d), "the budget")


_SIGNALS = {
    "temporal": r"\b(first|last|before|after|earlier|later|previous|next)\b|\bhow many days\b|\bhow (long|much time)\b|\bwhen\b|\b(days?|weeks?|months?|years?) (ago|before|after|between|passed)\b",
    "aggregation": r"\bhow many\b|\bhow much\b|\btotal\b|\ball\b|\bevery\b|\bcount\b|\blist\b",
}


@query("x6_query_signals", "select id, " + ", ".join(f"regexp_matches(regexp_replace(lower(message), '[^\\x00-\\x7f\\P{{L}}]', 'q', 'g'), '{p}') {k}" for k, p in _SIGNALS.items()).replace("{{", "{").replace("}}", "}") + " from (select distinct on (id) * from en) where message is not null")
def x6(spark, d):
    m = table(spark, d, "en").dropDuplicates(["id"]).where("message is not null")
    return m.select("id", *[F.lower("message").rlike(p).alias(k) for k, p in _SIGNALS.items()])


def _mixed(c: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all(lower({c}), '[a-z]{{2,}}'), regexp_extract_all({c}, '{CJK}')))"


_TOKENS = f"greatest(1, {_n('cut', CJK)} + floor((length(cut) - {_n('cut', CJK)})/4))::int"


@query("k16_knowledge", f"""with k as (select doc_id, namespace, substr(coalesce(text, ''), 1, 300) cut, {_mixed("(coalesce(title, '') || ' ' || coalesce(text, ''))")} t from {_DOCS}), q as (select ['rollout', 'backup', 'migration', 'budget'] q),
 s as (select doc_id, namespace, {_TOKENS} tokens, round(len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q)))::double, 9) rel from k, q),
 r as (select *, (row_number() over w)::int "position", (sum(tokens) over (partition by namespace order by rel desc, doc_id rows unbounded preceding))::bigint used from s window w as (partition by namespace order by rel desc, doc_id))
 select namespace, doc_id, rel, "position", used from r where "position" <= 5 and used <= 300""")
def k16(spark, d):
    return P.knowledge(documents(spark, d), "rollout backup migration budget", 5, 300)


@query("t14_similar_corrections")
def t14(spark, d):
    """Corrections of a namespace that say the same again: neighbours in time that are similar."""
    m = records(spark, d).where("type = 'correction'")
    w = Window.partitionBy("namespace").orderBy("created_at", "storage_key")
    m = m.withColumn("before", F.lag("content").over(w)).withColumn("before_key", F.lag("storage_key").over(w)).where("before is not null")
    return m.select("before_key", "storage_key", W.similar_corrections(F.col("content"), F.col("before")).alias("similar"))


_ENTS = "(select distinct on (id) * from memory_entities)"


@query("j6_shared_sources", f"""with m as (select distinct namespace ns, memory_key k, lower(entity_text) e from {_ENTS} where trim(memory_key) <> ''), p as (select x.ns, x.e a, y.e b, x.k from m x join m y on x.ns = y.ns and x.k = y.k and x.e < y.e),
 s as (select p.*, m.content_hash h, row_number() over (partition by p.ns, a, b order by p.k) r from p join {REC} m on m.storage_key = p.k) select ns namespace, a, b, k source_key, h source_hash from s where r <= 20""")
def j6(spark, d):
    return G.shared_sources(table(spark, d, "memory_entities").dropDuplicates(["id"]), records(spark, d))


@query("a23_evidence_totals", f"select namespace, type, count(*) filter (where confidence >= 0.5) support, count(*) filter (where confidence < 0.5) contradiction, count(*) filter (where confidence >= 0.5) - count(*) filter (where confidence < 0.5) balance from {REC} group by 1, 2")
def a23(spark, d):
    g = records(spark, d).groupBy("namespace", "type").agg(F.count_if(F.col("confidence") >= 0.5).alias("support"), F.count_if(F.col("confidence") < 0.5).alias("contradiction"))
    return g.withColumn("balance", F.col("support") - F.col("contradiction"))


@query("s9_note_listing", "select doc_id, title from (select distinct on (doc_id) * from documents) where doc_kind = 'note' and (contains(lower(coalesce(title, '')), 'be') or contains(lower(coalesce(text, '')), 'rollout')) order by created_at desc, doc_id limit 50")
def s9(spark, d):
    t = table(spark, d, "documents").dropDuplicates(["doc_id"]).where("doc_kind = 'note'")
    hit = F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("be")) | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("rollout"))
    return t.where(hit).orderBy(F.desc("created_at"), "doc_id").limit(50).select("doc_id", "title")


# write path: records of tier 3 and more arrive at a store that holds the others
_HASH = "substr(sha256(content || ':' || type), 1, 16)"
_NEW = f"""(select * from (select *, {_HASH} h, row_number() over (partition by namespace, {_HASH} order by created_at, coalesce(raw_text, ''), confidence) rn from {REC} where tier >= 3) where rn = 1 and (namespace, h) not in (select (namespace, {_HASH}) from {REC} where tier < 3))"""
_KEY = "'cm_' || substr(sha256(namespace), 1, 6) || '_' || strftime(created_at at time zone 'UTC', '%Y%m%d%H%M%S') || '_' || substr(h, 1, 8)"


def arriving(spark, d):
    m = records(spark, d)
    return m.where("tier >= 3").select("namespace", "type", "content", "raw_text", "confidence", "tier", "created_at"), m.where("tier < 3")


@query("s13_s15_remember", f"""select {_KEY} storage_key, namespace, type, content, confidence, tier, epoch_us(created_at) + case tier when 3 then 365 * 86400000000 end expires_us, round(confidence * {_case('type', S.TYPE_WEIGHT, 1.0)}, 6) importance_score,
 case when confidence > 0.5 then 'store' when confidence > 0.3 then 'defer' else 'ignore' end suggested_action from {_NEW}""")
def s13(spark, d):
    r = W.new_records(*arriving(spark, d))
    return r.select("storage_key", "namespace", "type", "content", "confidence", "tier", F.unix_micros("expires_at").alias("expires_us"), "importance_score", "suggested_action")


_FIRST_RAW = f"(select namespace, h, arg_min(raw_text, (created_at, raw_text)) raw_text from (select *, {_HASH} h from {REC} where tier >= 3 and trim(coalesce(raw_text, '')) <> '') group by 1, 2)"


@query("s13_filled", f"select m.storage_key, f.raw_text from (select *, {_HASH} h from {REC} where tier < 3 and trim(coalesce(raw_text, '')) = '') m join {_FIRST_RAW} f on f.namespace = m.namespace and f.h = m.h")
def s13f(spark, d):
    return W.filled(*arriving(spark, d))


def _marks(c: str) -> str:
    rx = lambda w: f"regexp_matches({c}, '(^|[^a-z0-9_]){w}($|[^a-z0-9_])')"
    return "list_filter([" + ", ".join(f"case when {rx(w)} then '{s}{i}' end" for i, pair in enumerate(A.CONTRADICTIONS) for s, w in zip("+-", pair)) + "], lambda x: x is not null)"


_OLDER = f"""(select *, list({{'k': storage_key, 'm': m, 't': t}}) over (partition by namespace, type order by created_at, storage_key rows between 20 preceding and 1 preceding) older from
 (select storage_key, namespace, type, created_at, {_marks('lower(content)')} m, list_distinct(regexp_extract_all(lower(content), '\\S+')) t, regexp_matches(lower(content), '(^|[^a-z0-9_])({"|".join(A.UPDATE_MARKERS)})($|[^a-z0-9_])') u from {{rec}}))"""
_HIT = "list_filter(older, lambda o: list_has_any(list_transform(m, lambda x: case when x[1] = '+' then '-' else '+' end || substr(x, 2)), o.m) or (u and len(list_intersect(t, o.t)) / (len(t) + len(o.t) - len(list_intersect(t, o.t)))::double >= 0.4))"
SUPERSEDE_SQL = f"select storage_key new_key, {_HIT}[-1].k old_key from {_OLDER.replace('{rec}', REC)} where type <> 'correction' and len({_HIT}) > 0"


@query("d2_d3_d4_supersede", SUPERSEDE_SQL)
def d2(spark, d):
    return A.supersede_candidates(records(spark, d))


@query("d7_update", f"select storage_key, version + (access_count > 5)::int as version, case when access_count > 5 then substr(sha256(content || ' (revised)' || ':' || type), 1, 16) else content_hash end content_hash, case when access_count > 5 then version end replaced from {REC}")
def d7(spark, d):
    m = records(spark, d)
    after, before = W.update(m, m.where("access_count > 5").select("storage_key", F.concat("content", F.lit(" (revised)")).alias("content")), now())
    return after.select("storage_key", "version", "content_hash").join(before.select("storage_key", F.col("version").alias("replaced")), "storage_key", "left")


@query("d15_corrections", f"""with x as (select storage_key, namespace, type, created_at, list_filter(list_distinct(regexp_extract_all(lower(content), '\\S+')), lambda x: length(x) > 1) w from {REC}),
 y as (select *, list({{'k': storage_key, 'y': type, 'w': w}}) over (partition by namespace order by created_at, storage_key rows between 10 preceding and 1 preceding) b from x),
 z as (select *, list_filter(b, lambda o: o.y in ('user_preference','decision','fact_declaration') and len(list_intersect(w, o.w)) >= 2) hit from y where type = 'correction')
 select storage_key correction, hit[-1].k target from z where len(hit) > 0""")
def d15(spark, d):
    return W.correction_targets(records(spark, d))


@query("d18_consolidated", f"""with o as (select lag(storage_key) over (partition by namespace, type, h order by created_at, storage_key) k from (select *, substr(sha256(substr(trim(regexp_replace(lower(content), '[\\s\\v\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200b}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g')), 1, 100)), 1, 16) h from {REC})),
 p as (select storage_key, round(confidence*dc, 6) c, case when storage_key in (select k from o where k is not null) then 'supersede' when type = 'user_preference' then 'keep' when dc < 0.1 then 'forget' when dc < 0.5 then 'decay' else 'keep' end as action from (select *, {DECAY} dc from {REC}))
 select storage_key, case when action = 'decay' then c end new_confidence, action from p""")
def d18(spark, d):
    m = records(spark, d)
    return W.consolidated(m, A.adjacent_updates(m), now())


_SESS = "coalesce(metadata ->> '$.session_id', storage_key)"


@query("d20_e13_sessions", f"with t as (select namespace, {_SESS} session, type, count(*) n, min(confidence) c, min(tier) tier from {REC} group by all) select namespace, session, sum(n)::bigint n, arg_min(type, (-n, type)) as type, round(0.95 * min(c), 6) confidence, min(tier)::int tier from t group by all")
def d20(spark, d):
    m = records(spark, d).withColumn("session", F.coalesce(F.get_json_object("metadata", "$.session_id"), "storage_key"))
    return W.session_summaries(m, "session")


@query("d20_lines", f"select namespace, session, storage_key, (row_number() over (partition by namespace, session order by created_at, storage_key))::int line_no, '- ' || substr(regexp_extract(content, '^([^.!?\\n]*[.!?]?)', 1), 1, 120) line from (select *, {_SESS} session from {REC}) where type in ('correction','decision','user_preference','fact_declaration')")
def d20l(spark, d):
    m = records(spark, d).withColumn("session", F.coalesce(F.get_json_object("metadata", "$.session_id"), "storage_key"))
    return W.session_lines(m, "session")


@query("s14_batch_delete", f"select storage_key from {REC} where storage_key not in (select memory_key from memory_entities where memory_key is not null)")
def s14(spark, d):
    gone = table(spark, d, "memory_entities").select(F.col("memory_key").alias("storage_key"))
    return records(spark, d).join(gone, "storage_key", "left_anti").select("storage_key")


@query("st4_expired_state", f"select storage_key, tier from {REC} where epoch_us(created_at) + case tier when 1 then 1 when 2 then 90 when 3 then 365 end * 86400000000 < epoch_us({SQL_NOW})")
def st4(spark, d):
    return records(spark, d).where(S.expiry("created_at", "tier") < now()).select("storage_key", "tier")


@query("q6_combined", f"select 'memory' as source, storage_key a, {_HIT}[-1].k b from {_OLDER.replace('{rec}', REC)} where type <> 'correction' and len({_HIT}) > 0 union all select 'ledger', subject::varchar, predicate from (select user_id subject, event_type predicate, count(distinct props) n from events group by 1, 2) where n > 1")
def q6(spark, d):
    a = A.supersede_candidates(records(spark, d)).select(F.lit("memory").alias("source"), F.col("new_key").alias("a"), F.col("old_key").alias("b"))
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.countDistinct("props").alias("n")).where("n > 1")
    return a.unionByName(e.select(F.lit("ledger").alias("source"), F.col("user_id").cast("string").alias("a"), F.col("event_type").alias("b")))


@query("x11_extractions", f"select storage_key, regexp_replace(trim(substr(content, strpos(content, ':') + 1)), '[.!?]+$', '') following, regexp_replace(trim(substr(content, 1, strpos(content, ':') - 1)), '[.!?]+$', '') preceding from {REC} where contains(content, ':')")
def x11(spark, d):
    m = records(spark, d).where(F.contains("content", F.lit(":")))
    return m.select("storage_key", L.extracted("content", ":", "following").alias("following"), L.extracted("content", ":", "preceding").alias("preceding"))


@query("x16_times", "select id, try_cast(regexp_extract(message, '\\d{4}-\\d{2}-\\d{2}') as timestamp) at time zone 'UTC' \"at\" from (select distinct on (id) * from en) where regexp_matches(message, '\\d{4}-\\d{2}-\\d{2}')")
def x16(spark, d):
    m = table(spark, d, "en").dropDuplicates(["id"]).where(F.col("message").rlike(r"\d{4}-\d{2}-\d{2}"))
    return m.select("id", L.parse_time(F.regexp_extract("message", r"\d{4}-\d{2}-\d{2}", 0)).alias("at"))


def _plan_sql(base: str, key: str, modes: list[tuple[str, str]], limit: int, budget: int, policy: str) -> str:
    """Modes are (name, from and order clauses over ``b``)."""
    u = " union all ".join(f"select *, {i} n, '{m}' m from (select {key}, row_number() over (order by {o}) r from {f} order by {o} limit {limit})" for i, (m, f, o) in enumerate((m, *fo.split(" ORDER ")) for m, fo in modes))
    keep = {"hide": "where n = 1", "show_top": "where nth = 1", "always": ""}[policy]
    return f"""with b as ({base}), u as ({u}), g as (select {key}, arg_min(m, n) as mode, list_sort(list_distinct(list(m))) modes from u group by 1),
 j as (select *, count(*) over (partition by coalesce(version_chain_id, {key}::varchar)) n, row_number() over (partition by coalesce(version_chain_id, {key}::varchar) order by importance_score desc, {key}) nth from g join b using ({key})),
 t as (select *, greatest(1, {_n('content', CJK)} + floor((length(content) - {_n('content', CJK)})/4))::int tokens from j {keep}),
 o as (select *, (row_number() over w)::int "position", (sum(tokens) over w)::bigint used from t window w as (order by type in ('correction','decision') desc, importance_score desc, {key}))
 select {key}, mode, modes, importance_score score, tokens, used, "position" from o where "position" <= {limit} and used <= {budget}"""


_SAFE = "not (" + " or ".join("regexp_matches(content, '" + p.replace("'", "''") + "')" for _, p in SECRETS) + ")"
_FTS = "(select * from b where " + " and ".join(f"(contains(lower(content), '{w}') or contains(lower(coalesce(raw_text, '')), '{w}') or contains(lower(coalesce(original_message, '')), '{w}'))" for w in ("rollout", "budget")) + ") ORDER importance_score desc, storage_key"
_ENTITY = "(select * from b where storage_key in (select memory_key from memory_entities where lower(entity_text) in ('rollout', 'budget'))) ORDER importance_score desc, storage_key"
_PLAN = [("full_text", _FTS), ("entity", _ENTITY), ("time", "b ORDER created_at desc, storage_key"), ("importance", "b ORDER importance_score desc, storage_key")]


def _recalled(spark, d, policy):
    plan = R.RecallPlan("rollout budget", modes=("full_text", "entity", "time", "importance"), limit=30, token_budget=1500, conflict_policy=policy)
    m = table(spark, d, "memory_entities").select(F.col("memory_key").alias("storage_key"), "entity_text")
    return R.recall_with_plan(records(spark, d), plan, mentions=m)


@query("e1_e2_recall_plan", _plan_sql(f"select * from {REC} where {LIVE} and {_SAFE}", "storage_key", _PLAN, 30, 1500, "hide"))
def e2(spark, d):
    return _recalled(spark, d, "hide")


@query("q7_show_top", _plan_sql(f"select * from {REC} where {LIVE} and {_SAFE}", "storage_key", _PLAN, 30, 1500, "show_top"))
def q7(spark, d):
    return _recalled(spark, d, "show_top")


_DOC_BASE = f"select doc_id, text as content, ((doc_id * 37) % 81 + 20) / 100.0::double importance_score, created_at, type, null::varchar version_chain_id, embedding from {_DOCS} join embeddings on vec_id = doc_id where type <> 'session_summary' and text is not null and {_SAFE.replace('content', 'text')}"
_TO_FIRST = "round(sqrt(list_sum(list_transform(list_zip(embedding, (select embedding from embeddings where vec_id = 0)), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))), 9)"


@query("e2_vector_plan", _plan_sql(_DOC_BASE, "doc_id", [("vector", f"b ORDER {_TO_FIRST}, doc_id"), ("importance", "b ORDER importance_score desc, doc_id")], 20, 20000, "always"))
def e2v(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    docs = documents(spark, d).where("text is not null").select(
        "doc_id", F.col("text").alias("content"), (((F.col("doc_id") * 37) % 81 + 20) / F.lit(100.0)).alias("importance_score"), "created_at", "type", F.lit(None).cast("string").alias("version_chain_id"), F.lit(False).alias("paused")
    )
    v = e.select(F.col("vec_id").alias("doc_id"), "embedding")
    plan = R.RecallPlan("-", modes=("vector", "importance"), limit=20, token_budget=20000, conflict_policy="always", vector=[float(x) for x in q])
    return R.recall_with_plan(docs.join(v.select("doc_id"), "doc_id", "left_semi"), plan, key="doc_id", vectors=v)
