"""Readers and writers of other stores: JSON documents, Markdown folders, exports, metrics text; and a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import language as L

MEMORY = "id string, type string, content string, original_message string, confidence double, tier int, importance_score double, created_at timestamp, expires_at timestamp"


def _lines(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lines")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """namespace, storage_key and record columns of documents {namespace: {"memories": {key: record}}}, one document a file."""
    if _lines(spark, path):
        return spark.read.schema(f"namespace string, storage_key string, {MEMORY}").json(f"{path}/lines")
    docs = spark.read.text(path, wholetext=True)
    spaces = docs.select(F.explode(F.from_json("value", f"map<string,struct<memories:map<string,struct<{MEMORY.replace(' ', ':').replace(',:', ',')}>>>>")).alias("namespace", "space"))
    return spaces.select("namespace", F.explode("space.memories").alias("storage_key", "r")).select("namespace", "storage_key", "r.*")


def write_json_store(df: DataFrame, path: str) -> None:
    """The records as lines {"namespace": ..., "storage_key": ..., record}, in folders by namespace; ``read_json_store`` reads them, too. Text is all that is not spread over lines."""
    fields = [c.split(" ")[0] for c in MEMORY.split(", ")]
    df.select("namespace", "storage_key", *fields).write.mode("overwrite").json(f"{path}/lines")


def search_json_store(df: DataFrame, words: str, at, k: int | None, **only) -> DataFrame:
    """Records whose content or message holds the words (case aside), unexpired at ``at``, of given type, tier or least confidence, the most important first; all of them without ``k``."""
    w = F.lit(words.lower())
    hit = F.contains(F.lower("content"), w) | F.coalesce(F.contains(F.lower("original_message"), w), F.lit(False))
    df = df.where(hit & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(at))))
    for c in ("type", "tier"):
        if c in only:
            df = df.where(F.col(c) == only[c])
    if "confidence_min" in only:
        df = df.where(F.col("confidence") >= only["confidence_min"])
    return df if k is None else df.orderBy(F.desc("importance_score"), "storage_key").limit(k)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every Markdown file below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("namespace").parquet(path)


def export_markdown(df: DataFrame) -> DataFrame:
    """One line per record with its place (type, position): sort by both to print; nothing is collected into one row."""
    line = F.concat(F.lit("- "), F.regexp_replace("content", r"\s+", " "))
    return df.select("type", "storage_key", line.alias("line"))


def import_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records whose namespace and content hash are not there yet."""
    h = L.content_hash("type", "content")
    return incoming.withColumn("h", h).join(existing.select("namespace", h.alias("h")).distinct(), ["namespace", "h"], "left_anti").drop("h")


def prometheus_lines(df: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """One text line per row in exposition format."""
    return df.select(F.format_string(f'{metric}{{{label}="%s"}} %s', F.col(label), F.col(value).cast("string")).alias("line"))


def audit_csv(df: DataFrame, path: str) -> None:
    df.orderBy("ts", "event_id").write.mode("overwrite").option("header", True).csv(path)


_REGISTRY: dict[str, Callable[..., DataFrame]] = {"json_store": read_json_store, "markdown": read_markdown, "parquet": lambda spark, path: spark.read.parquet(path)}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    _REGISTRY[name] = reader


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in _REGISTRY:
        raise ValueError(f"unknown store {name}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](spark, path)
