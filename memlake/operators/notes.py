"""Markdown notes: front matter, tags, links, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import language as L


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def front_matter(c: Column | str) -> Column:
    """The block between leading '---' lines, '' without one."""
    return F.regexp_extract(_c(c), r"^---\n([\s\S]*?)\n---", 1)


def front_title(c: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(front_matter(c), r"(?m)^title:[ ]*(.*)$", 1)), F.lit(""))


def tags(c: Column | str) -> Column:
    """Sorted distinct tags of the front matter's list and of '#tag' marks in the body."""
    listed = F.transform(F.split(F.regexp_extract(front_matter(c), r"(?m)^tags:[ ]*\[([^\]]*)\]", 1), ","), lambda x: F.lower(F.trim(x)))
    marked = F.transform(L.matches(_c(c), r"(?:^|\s)#([\p{L}\p{N}_/-]+)", 1), lambda x: F.lower(x))
    return F.array_sort(F.array_distinct(F.filter(F.concat(listed, marked), lambda x: x != "")))


def wiki_links(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(L.matches(_c(c), r"\[\[([^\]|#]+)", 1), lambda x: F.trim(x))))


def index(files: DataFrame, known: DataFrame | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """path, title, tags, links, hash of notes that are new or changed since ``known`` (path, hash)."""
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("content"))
    rows = rows.withColumns({"title": F.coalesce(front_title("content"), F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)), "tags": tags("content"), "links": wiki_links("content"), "hash": L.content_hash("content")})
    return rows if known is None else rows.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def search(notes: DataFrame, words: list[str], k: int) -> DataFrame:
    """The k best by 0.6 share of words in the text, 0.25 in tags, 0.15 in links; ties by path."""
    n = float(max(1, len(words)))
    text = sum((F.contains(F.lower("content"), F.lit(w)).cast("int") for w in words), F.lit(0)) / n
    tag = sum((F.array_contains("tags", w).cast("int") for w in words), F.lit(0)) / n
    link = sum((F.contains(F.lower(F.array_join("links", "\x00")), F.lit(w)).cast("int") for w in words), F.lit(0)) / n
    score = F.round(0.6 * text + 0.25 * tag + 0.15 * link, 6)
    return notes.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "path").limit(k)


def back_links(notes: DataFrame) -> DataFrame:
    """(title, n): how many notes link to each title, case aside."""
    return notes.select("path", F.explode("links").alias("title")).groupBy(F.lower("title").alias("title")).agg(F.countDistinct("path").alias("n"))
