"""Queries over messages: noise, detectors, classification, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import fixed_values as V
from memlake.functions import language as L
from memlake.operators import classify as C
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


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One row per id, with the number of the message among equal ones in order of id."""
    e = table(spark, d, "en").dropDuplicates(["id"]).select("id", "message")
    nth = F.row_number().over(Window.partitionBy(F.sha2("message", 256)).orderBy("id"))
    # much to compute for few bytes: as many parts as there are cores, whatever the size
    return e.withColumn("nth", nth).repartition(spark.sparkContext.defaultParallelism, "id")


def _rx(c: str, ps) -> str:
    # borders of words are those of all letters, which this engine knows of ASCII letters only
    if c in ("low", "tl"):
        c = f"regexp_replace({c}, '[^\\x00-\\x7f\\P{{L}}]', 'q', 'g')"
    return f"coalesce(regexp_matches({c}, '" + "|".join(f"(?:{p})" for p in ps).replace("'", "''") + "'), false)"


def _has(c: str, ws) -> str:
    return "(" + " or ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in ws) + ")"


_MSG = f"""(select id, message m, trim(message, ' ') t, lower(message) low, lower(trim(message, ' ')) tl, length(trim(message, ' ')) n, len(regexp_split_to_array(trim(message, ' '), '\\s+')) w,
 case when regexp_matches(message, '[\\x{{3040}}-\\x{{30ff}}]') then 'ja' when regexp_matches(message, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]') then 'zh' else 'en' end la,
 row_number() over (partition by sha256(message) order by id) nth from (select distinct on (id) id, message from en))"""
_STATED = "(w >= 3 and (" + _rx("t", (r"\b[A-Z][a-z]+[A-Z]\w*\b", r"\b[A-Z]{2,}\b", r"\b\w+_\w+\b")) + " or " + _has("tl", V.SUBSTANCE) + " or (w >= 4 and " + _has("tl", (" for ", " with ", " using ")) + ")))"
_EACH = lambda g: "(" + " or ".join((_rx("tl", g["en"]), _rx("t", g["zh"]), _rx("t", g["ja"]))) + ")"
_NOISE = f"""(case when t is null or t = '' then 'short' when {_EACH(V.ACKNOWLEDGMENT)} then 'acknowledgment' when {_EACH(V.CHITCHAT)} then 'chitchat'
 when {_rx("t", V.LOG_LINE)} or (regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}\\s+\\d{{2}}:\\d{{2}}') and w <= 4) or ({_rx("tl", V.COMMAND)} and not {_rx("tl", V.FACT_INDICATOR)} and not {_STATED}) then 'technical'
 when {_EACH(V.QUESTION)} and n < 60 then 'question' when {_rx("tl", V.INSTRUCTION)} and n < 60 and not {_rx("tl", V.WORKFLOW_WORD)} and not {_STATED} then 'instruction'
 when {_rx("tl", V.ADVERSARIAL)} then 'adversarial' when n < 5 and not regexp_matches(tl, '[a-z]{{3,}}') then 'short' end)"""


def _lang(g, english: str = "") -> str:
    parts = [f"({english}{_rx('low', g['en'])})"] if "en" in g else []
    return "(" + " or ".join(parts + [f"(la = '{la}' and {_rx('m', g[la])})" for la in ("zh", "ja")]) + ")"


def _l(kind: str, conf: float, tier: int, known: bool = False) -> str:
    c = f"case when nth >= 2 then 0.8 else {conf} end" if known else str(conf)
    return f"{{'type': '{kind}', 'confidence': ({c})::double, 'tier': {tier}}}"


_DETECT = {
    "correction": f"case when {_lang(V.CORRECTION_EXPLICIT)} then {_l('correction', 0.85, 3)} when {_lang(V.CORRECTION_STRUCTURAL)} then {_l('correction', 0.75, 3)} when {_has('low', V.CORRECTION_WORDS)} then {_l('correction', 0.65, 3)} end",
    "fact_declaration": f"""case when n < 10 or {_has('low', V.FACT_NOISE)} then null when la <> 'en' then case when (la = 'zh' and {_rx('m', V.FACT_STATEMENT['zh'])}) or (la = 'ja' and {_rx('m', V.FACT_STATEMENT['ja'])}) then {_l('fact_declaration', 0.7, 4, True)} end
 when {_rx('low', V.FACT_TERM)} and {_rx('low', V.FACT_TERM_STRUCTURE)} then {_l('fact_declaration', 0.8, 4, True)} when {_rx('low', V.FACT_TERM)} then {_l('fact_declaration', 0.75, 4, True)}
 when {_rx('low', V.FACT_QUANTITY)} and {_rx('low', V.FACT_QUANTITY_STRUCTURE)} then {_l('fact_declaration', 0.7, 4, True)} when n > 25 and {_rx('low', V.FACT_GENERAL)} then {_l('fact_declaration', 0.6, 4, True)} end""",
    "decision": f"case when {_lang(V.DECISION_STRONG)} then {_l('decision', 0.75, 2)} when n > 15 and {_has('low', V.DECISION_WEAK)} then {_l('decision', 0.65, 3)} when la = 'en' and {_has('low', V.DECISION_WORDS)} then {_l('decision', 0.6, 3)} end",
    "task_pattern": f"""case when {_rx('low', (V.DECISION_GUARD,))} then null when {_rx('low', V.TASK_STRUCTURED)} then {_l('task_pattern', 0.75, 3)} when {_rx('low', V.TASK_WORKFLOW)} then {_l('task_pattern', 0.72, 3)}
 when {_rx('low', V.TASK_HABIT)} then {_l('task_pattern', 0.7, 3)} when la = 'en' and {_has('low', V.TASK_WORDS)} then {_l('task_pattern', 0.6, 3, True)} end""",
    "user_preference": f"case when {_lang(V.PREFERENCE_STRONG)} then {_l('user_preference', 0.75, 2)} when la = 'en' and {_has('low', V.PREFERENCE_WORDS)} then {_l('user_preference', 0.6, 2, True)} end",
    "relationship": f"""case when n >= case when la = 'en' then 12 else 6 end and {_lang(V.RELATIONSHIP, "la = 'en' and ")} then {_l('relationship', 0.75, 4, True)} end""",
    "location": f"""case when not {_rx('low', V.LOCATION_EXCLUSION)} and ((la <> 'zh' and {_has('low', V.LOCATION_WORDS['en'])} and {_has('low', V.PLACE_WORDS['en'])}) or (la = 'zh' and {_has('low', V.LOCATION_WORDS['zh'])} and {_has('low', V.PLACE_WORDS['zh'])})) then {_l('location', 0.7, 3)} end""",
    "sentiment_marker": f"""case when n < case when la = 'en' then 10 else 5 end then null when {_lang(V.SENTIMENT, "la = 'en' and ")} then {_l('sentiment_marker', 0.8, 3)} when la = 'en' and {_has('low', V.INTENSIFIER)} and {_rx('low', V.SENTIMENT_ADJECTIVE)} then {_l('sentiment_marker', 0.75, 3)}
 when la = 'en' and {_has('low', V.SENTIMENT_WORDS)} and not {_rx('low', V.SENTIMENT_EXCLUSION)} then {_l('sentiment_marker', 0.65, 3)} end""",
}
_DEFAULT = f"""case when n < 8 or {_has('tl', V.CHITCHAT_WORDS)} or (w <= 2 and n < 20) or la <> 'en' then null when {_has('tl', V.PREFERENCE_WORDS)} then {_l('user_preference', 0.9, 2)} when {_has('tl', V.CORRECTION_WORDS)} then {_l('correction', 0.8, 3)}
 when {_has('tl', V.DECISION_WORDS)} then {_l('decision', 0.8, 2)} when {_has('tl', V.TASK_WORDS)} then {_l('task_pattern', 0.8, 2)} when {_has('tl', V.SENTIMENT_WORDS)} then {_l('sentiment_marker', 0.7, 3)} end"""
_DETECTED = "(select *, " + ", ".join(f"({q}) d_{k}" for k, q in _DETECT.items()) + f", ({_DEFAULT}) d_default, {_NOISE} noise from {_MSG})"
_FIRST = "coalesce(" + ", ".join(f"d_{k}" for k in V.TYPE_ORDER) + ")"
_LABELED = f"(select *, case when noise is null then coalesce({_FIRST}, d_default) end l, case when noise is null then case when {_FIRST} is not null then 'pattern' when d_default is not null then 'default' end end layer from {_DETECTED})"


@query("f16_noise", f"select id, {_NOISE} noise from {_MSG}")
def f16(spark, d):
    return messages(spark, d).select("id", C.noise_kind("message").alias("noise"))


@query("c4_c8_labels", f"select id, list_transform(list_filter([" + ", ".join(f"d_{k}" for k in C.DETECTORS) + f"], lambda x: x is not null), lambda x: x.type || ' ' || x.confidence) labels from {_DETECTED}")
def c4(spark, d):
    m = messages(spark, d)
    return m.select("id", F.transform(C.labels("message", nth=F.col("nth")), lambda x: F.concat_ws(" ", x["type"], x["confidence"].cast("string"))).alias("labels"))


@query("c1_c10_classify", f"""select id, noise, l.type as type, l.confidence confidence, l.tier tier, case when l.type in ('session_summary','task_pattern') then 'event' when l is not null then 'state' end nature,
 case when l.confidence > 0.5 then 'store' when l.confidence > 0.3 then 'defer' when l is not null then 'ignore' end as action, layer from {_LABELED}""")
def c1(spark, d):
    return C.classify(messages(spark, d), "message", nth="nth").drop("message", "nth")


@query("c11_soft", f"select type, count(*) n from (select case when noise is null then coalesce(l.type, 'fact_declaration') end as type from {_LABELED}) group by type")
def c11(spark, d):
    return C.classify(messages(spark, d), "message", soft=True, nth="nth").groupBy("type").agg(F.count("*").alias("n"))


@query("c15_envelope", f"""select 'mem_' || substr(sha256(id || ':' || m), 1, 12) id, id as source, l.type as type, m as content, round(l.confidence, 2) confidence, l.tier tier, case when l.confidence > 0.5 then 'store' when l.confidence > 0.3 then 'defer' else 'ignore' end suggested_action,
 layer source_layer, l.type || ': ' || substr(regexp_extract(m, '^([^.!?\\n]*[.!?]?)', 1), 1, 120) summary from {_LABELED} where l is not null""")
def c15(spark, d):
    return C.envelope(C.classify(messages(spark, d), "message", nth="nth"), "message", "id")


_RULES = [("urls", r"https?://", "fact_declaration", 1), ("todo", r"(?i)\btodo\b", "task_pattern", 5), ("deadline", r"(?i)\b(deadline|due)\b", "decision", 5), ("numbers", r"\d{4,}", "fact_declaration", 3)]


@query("c3_custom_rules", "select id, case when regexp_matches(message, '(?i)\\b(deadline|due)\\b') then 'deadline' when regexp_matches(message, '(?i)\\btodo\\b') then 'todo' when regexp_matches(message, '\\d{4,}') then 'numbers' when regexp_matches(message, 'https?://') then 'urls' end rule from (select distinct on (id) id, message from en)")
def c3(spark, d):
    m = messages(spark, d)
    return m.select("id", C.custom_rules(m, "message", _RULES)["rule"].alias("rule"))


_GROUP = {"number": r"\d+", "path": r"[a-z]+/[a-z]+", "quoted": r"[\"'][^\"']+[\"']", "code": r"`[^`]+`"}
_GROUP_SQL = "[" + ", ".join(f"case when regexp_matches(m, '{p.replace(chr(39), chr(39) * 2)}') then '{k}' end" for k, p in _GROUP.items()) + "]"


@query("c16_pattern_group", f"select id, list_filter({_GROUP_SQL}, lambda x: x is not null)[1] as first_hit, list_filter({_GROUP_SQL}, lambda x: x is not null) all_hits, len(list_filter({_GROUP_SQL}, lambda x: x is not null)) > 0 any_hit from {_MSG} where m is not null")
def c16(spark, d):
    m = messages(spark, d).where("message is not null")
    c = F.col("message")
    return m.select("id", C.first_match(c, _GROUP).alias("first_hit"), C.all_matches(c, _GROUP).alias("all_hits"), C.any_of(c, _GROUP.values()).alias("any_hit"))


_COUNT = "(" + " + ".join(f"contains(low, '{w}')::int" for w in V.TASK_WORDS) + ")"


@query("x3_keyword_type", f"select id, {_COUNT} n_words, round(least(0.5 + 0.1 * {_COUNT}, 0.9), 6)::double confidence from {_MSG} where m is not null and {_COUNT} > 0")
def x3(spark, d):
    n = sum((F.contains(F.lower("message"), F.lit(w)).cast("int") for w in V.TASK_WORDS), F.lit(0))
    m = messages(spark, d).where("message is not null").select("id", n.alias("n_words"))
    return m.where("n_words > 0").withColumn("confidence", F.round(F.least(0.5 + 0.1 * F.col("n_words"), F.lit(0.9)), 6))


_SAID = "regexp_replace(t, '(?i)^\\[(?:assistant|ai|bot) said\\]', '')"


@query("f17_low_information")
def f17(spark, d):
    """Every message as if an assistant had said it."""
    m = messages(spark, d).where("message is not null")
    return m.where(C.low_information(F.concat(F.lit("[assistant said] "), "message"))).select("id")


@query("c12_q26_repeats", f"select id, nth::int nth from {_MSG} where m is not null")
def c12(spark, d):
    return messages(spark, d).where("message is not null").select("id", "nth")


@query("c12_confirmations", r"""with x as (select id, message, lag(message) over (partition by category order by id) before from (select distinct on (id) * from en) where message is not null)
 select id, before from x where before is not null and regexp_matches(lower(trim(message)), '^(yes|yeah|yep|ok|okay|sure|agreed|confirmed|sounds good|do it|好的|对|はい|네)\b?[ .!。]*$')""")
def c12c(spark, d):
    e = table(spark, d, "en").dropDuplicates(["id"]).where("message is not null")
    return C.confirmations(e, "category", "id", "message").select("id", "before")


@query("c13_feedback", "select event_id, case when event_type = 'error' then 'tool_error' when event_type = 'view' and value > 200 then 'performance' when event_type = 'purchase' then 'positive_feedback' when event_type = 'signup' then 'follow_up' end kind from events")
def c13(spark, d):
    return table(spark, d, "events").select("event_id", C.feedback(F.col("event_type"), F.col("value")).alias("kind"))
