"""Queries over notes, exports and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import notes as N
from memlake.plans import messages, retrieval
from memlake.plans.records import REC, SQL_NOW, now, records
from memlake.sources import stores
from memlake.sources.tables import Scratch, table
from memlake.streaming import jobs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql.strip()
        return f

    return add


def notes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'note' and text is not null")
    return N.index(docs.select(F.concat(F.lit("n"), "doc_id", F.lit(".md")).alias("path"), "text"))


_NOTES = "(select 'n' || doc_id || '.md' path, text content, regexp_extract(text, '^---\\n([\\s\\S]*?)\\n---', 1) fm from documents where doc_kind = 'note' and text is not null)"


@query("s6_s7_notes", f"""select path, coalesce(nullif(trim(regexp_extract(fm, '(?m)^title:[ ]*(.*)$', 1)), ''), regexp_replace(path, '\\.md$', '')) title, substr(sha256(content), 1, 16) hash from {_NOTES}""")
def s6(spark, d):
    return notes(spark, d).select("path", "title", "hash")


_TAGS = f"""(select path, unnest(list_distinct(list_filter(list_concat(list_transform(string_split(regexp_extract(fm, '(?m)^tags:[ ]*\\[([^\\]]*)\\]', 1), ','), lambda x: lower(trim(x))),
 list_transform(regexp_extract_all(content, '(?:^|\\s)#([\\p{{L}}\\p{{N}}_/-]+)', 1), lambda x: lower(x))), lambda x: x <> ''))) tag from {_NOTES})"""


@query("a10_s9_note_tags", f"select tag, count(*) n from {_TAGS} group by 1")
def a10n(spark, d):
    return notes(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("s10_back_links", f"select lower(trim(l)) title, count(distinct path) n from (select path, unnest(regexp_extract_all(content, '\\[\\[([^\\]|#]+)', 1)) l from {_NOTES}) group by 1")
def s10(spark, d):
    return N.back_links(notes(spark, d))


_HITS = lambda c: " + ".join(f"contains(lower({c}), '{w}')::int" for w in ("shell", "backup", "migration"))


@query("s8_note_search", f"""with t as (select path, content, list_filter(list_concat(list_transform(string_split(regexp_extract(fm, '(?m)^tags:[ ]*\\[([^\\]]*)\\]', 1), ','), lambda x: lower(trim(x))), list_transform(regexp_extract_all(content, '(?:^|\\s)#([\\p{{L}}\\p{{N}}_/-]+)', 1), lambda x: lower(x))), lambda x: x <> '') tags,
 array_to_string(regexp_extract_all(content, '\\[\\[([^\\]|#]+)', 1), chr(0)) links from {_NOTES}) select * from (select path, round(0.6 * ({_HITS('content')}) / 3.0 + 0.25 * (list_contains(tags, 'shell')::int + list_contains(tags, 'backup')::int + list_contains(tags, 'migration')::int) / 3.0 + 0.15 * ({_HITS('links')}) / 3.0, 6)::double score from t) where score > 0 order by score desc, path limit 30""")
def s8(spark, d):
    return N.search(notes(spark, d), ["shell", "backup", "migration"], 30).select("path", "score")


@query("s16_s17_import", f"select storage_key from {REC} where (namespace, substr(sha256(type || ':' || content), 1, 16)) not in (select (namespace, substr(sha256(type || ':' || content), 1, 16)) from memories where tier <= 2)")
def s16(spark, d):
    m = records(spark, d)
    return stores.import_new(m.where("tier <= 2"), m).select("storage_key")


@query("s16_markdown_export", f"select type, storage_key, '- ' || regexp_replace(content, '[\\s\\v]+', ' ', 'g') line from {REC}")
def s16m(spark, d):
    return stores.export_markdown(records(spark, d))


@query("s21_prometheus", "select 'events_total{event_type=\"' || event_type || '\"} ' || count(*) line from events group by event_type")
def s21(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return stores.prometheus_lines(c, "events_total", "event_type", "n")


def _run(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """The result of a stream that takes all there is and ends, kept as a table in the shared folder."""
    base = Scratch(spark, "stream").base
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    s = spark.readStream.schema(schema).parquet(path) if _is_dir(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("st9_tumbling", "select time_bucket(interval 1 hour, ts) since, event_type, count(*) n, round(avg(value), 6) mean, max(value) most from events group by 1, 2")
def st9(spark, d):
    return _run(jobs.tumbling_metrics(_events(spark, d), "ts", "event_type", "value"), "complete", spark).withColumn("mean", F.round("mean", 6))


@query("st6_sliding", "select since, user_id, count(*) n, count(*) > 20 as blocked from (select time_bucket(interval 15 minute, ts) - unnest([0, 15, 30, 45]) * interval 1 minute since, user_id from events) group by 1, 2")
def st6(spark, d):
    return _run(jobs.sliding_rates(_events(spark, d), "ts", "user_id"), "complete", spark)


@query("st5_sessions", """with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 60 second then 0 else 1 end nw from events), y as (select *, sum(nw) over (partition by user_id order by ts, nw desc rows unbounded preceding) s from x)
 select min(ts) since, max(ts) + interval 60 second "until", user_id, count(*) n from y group by user_id, s""")
def st5(spark, d):
    return _run(jobs.sessions(_events(spark, d), "ts", "user_id"), "complete", spark)


@query("st2_dedup", "select count(distinct event_type || ':' || props) n from events")
def st2(spark, d):
    return _run(jobs.dedup(_events(spark, d), "ts", "3650 days", ("event_type", "props")).select("event_id"), "append", spark).agg(F.count("*").alias("n"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    schema, path = table(spark, d, name).schema, f"{d}/{name}.parquet"
    return spark.readStream.schema(schema).parquet(path) if _is_dir(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("st1_ingest", f"select id, message, noise, l.type as type, l.confidence confidence, l.tier tier, case when l.type in ('session_summary','task_pattern') then 'event' else 'state' end nature, case when l.confidence > 0.5 then 'store' when l.confidence > 0.3 then 'defer' else 'ignore' end as action, layer from {messages._LABELED.replace(' nth from ', ' nth0, 1 nth from ')} where m is not null and noise is null and l is not null".replace("select id, message,", "select id, m message,"))
def st1(spark, d):
    return _run(jobs.ingest(_stream(spark, d, "en").select("id", "message")), "append", spark).distinct()


@query("st3_supersede", f"select namespace || '/' || type as grp, new_key, old_key from ({retrieval.SUPERSEDE_SQL.replace('select storage_key new_key', 'select namespace, type, storage_key new_key').replace(chr(32) + 'type <> ' + chr(39) + 'correction' + chr(39) + ' and', '')})")
def st3(spark, d):
    m = _stream(spark, d, "memories").dropDuplicates(["storage_key"]).withColumn("grp", F.concat_ws("/", "namespace", "type"))
    return _run(jobs.last_n(m, "created_at", "grp", "storage_key", "content"), "append", spark)


@query("st8_history", "select user_id::varchar user_id, event_id::varchar event_id, list(event_id::varchar) over (partition by user_id order by ts, event_id::varchar rows between 10 preceding and 1 preceding) before from events")
def st8(spark, d):
    out = _run(jobs.history(_events(spark, d), "ts", "user_id", "event_id"), "append", spark)
    return out.withColumn("before", F.when(F.size("before") > 0, F.col("before")))


@query("st10_s22_audit", "select event_id, event_type, user_id, strftime(ts, '%Y-%m-%d') as day from events")
def st10(spark, d):
    """Audit rows appended by a job as they come, in folders by day, and read back."""
    base = f"{Scratch(spark, 'audit').base}"
    jobs.append_audit(_events(spark, d), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("s5_s18_json_store", f"select storage_key, namespace, type, content, tier from {REC} where type = 'correction' and confidence >= 0.5 and (expires_at is null or expires_at >= {SQL_NOW})")
def s5(spark, d):
    """Records written as JSON documents, one namespace a file, read back and filtered by type and confidence."""
    base = Scratch(spark, "json_store").base
    stores.write_json_store(records(spark, d), base)
    back = stores.read_json_store(spark, base)
    return stores.search_json_store(back, "", now(), None, type="correction", confidence_min=0.5).select("storage_key", "namespace", "type", "content", "tier")
