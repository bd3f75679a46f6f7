"""Weighted text search: BM25, synonyms, spelling, merging of result lists, entity extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.operators import analytics as A
from memlake.sources.tables import Scratch


def bm25(docs: DataFrame, key: str, tokens: Column, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, bm25) of documents with any query token. Corpus figures are three aggregates; only query tokens are exploded."""
    q = F.array(*[F.lit(t) for t in sorted(set(query))])
    rows = docs.select(key, tokens.alias("t")).withColumn("n", F.size("t"))
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    hits = rows.select(key, "n", F.explode(F.filter("t", lambda x: F.array_contains(q, x))).alias("w")).groupBy(key, "n", "w").agg(F.count("*").alias("tf"))
    df = hits.groupBy("w").agg(F.count("*").alias("df"))  # at most one row per query token
    x = hits.join(F.broadcast(df), "w").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return x.groupBy(key).agg(F.round(F.sum(s), 6).alias("bm25"))


def all_word_tokens(c: Column | str) -> Column:
    """Lower-case word tokens with repeats."""
    return L.matches(F.lower(F.col(c) if isinstance(c, str) else c), r"[\p{L}\p{N}_]+")


def _shortened(c: Column, most: int) -> Column:
    """The word and all words left by deleting up to ``most`` of its characters."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
    out = F.array(c)
    step = out
    for _ in range(most):
        step = F.flatten(F.transform(step, less))
        out = F.concat(out, step)
    return F.array_distinct(out)


def spelling(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, fixed): for words that are not in the vocabulary the nearest entry within ``most`` edits, ties by the entry.

    Two words within d edits have a word in common among those that d deletions leave of
    them, so candidates come from an equi join; their distance is computed once.
    """
    unknown = words.select("word").where("word is not null").distinct().join(vocabulary.select(F.col("v").alias("word")).hint("merge"), "word", "left_anti")
    a = unknown.select("word", F.explode(_shortened(F.col("word"), most)).alias("k"))
    b = vocabulary.select("v").where("v is not null").distinct().select("v", F.explode(_shortened(F.col("v"), most)).alias("k"))
    # merge: the planner takes either side for as small as the words it comes from, but it has some 80 rows a word, too many to send through the driver
    near = a.hint("merge").join(b.hint("merge"), "k").select("word", "v").distinct().withColumn("d", F.levenshtein("word", "v", most)).where("d >= 0")
    return near.groupBy("word").agg(F.min_by("v", F.struct("d", "v")).alias("fixed"))


def expansions(table: DataFrame, words: DataFrame) -> DataFrame:
    """(term): what the expansion table (k, v) gives for some word (k)."""
    return table.join(words, "k", "left_semi").select(F.col("v").alias("term")).distinct()


def by_terms(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term): records that hold a term as a word; an equi join, so the list of terms may be long."""
    words = df.select(key, F.explode(L.word_tokens(text)).alias("term"))
    return words.join(terms, "term").select(key, "term")


def rebuilt_queries(df: DataFrame, query: str, profile: int = 5, extra: int = 5) -> DataFrame:
    """(namespace, query): the query with up to ``extra`` further words, in their order, of those of the namespace's ``profile`` most important preferences, decisions and facts that share a word with it."""
    words = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    told = df.where(F.col("type").isin("user_preference", "decision", "fact_declaration") & ~F.col("superseded"))
    w = Window.partitionBy("namespace").orderBy(F.desc("importance_score"), "storage_key")
    top = told.select("namespace", "content", F.row_number().over(w).alias("r")).where(F.col("r") <= profile).withColumn("t", L.space_tokens("content"))
    more = top.where(F.arrays_overlap("t", words)).select("namespace", F.explode(F.array_except("t", words)).alias("x")).where(F.length("x") > 2)
    by = more.groupBy("namespace").agg(F.slice(F.array_sort(F.collect_set("x")), 1, extra).alias("x"))  # words of at most ``profile`` records
    return by.where(F.size("x") > 0).select("namespace", F.concat_ws(" ", F.lit(query), F.array_join("x", " ")).alias("query"))


def merge_results(original: DataFrame, expanded: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """Originals weigh 1; expanded ones weight x overlap x (0.5 + 0.5 confidence) if that reaches ``least``; the better of both stays."""
    a = original.select(key, F.lit(1.0).alias("score"), F.lit("original").alias("source"))
    s = F.col("weight") * F.col("overlap") * (0.5 + 0.5 * F.col("confidence"))
    b = expanded.select(key, F.round(s, 6).alias("score"), F.lit("expanded").alias("source")).where(F.col("score") >= least)
    return a.unionByName(b).groupBy(key).agg(F.max(F.struct("score", "source")).alias("x")).select(key, "x.score", "x.source")


_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # word borders that also hold beside scripts without blanks
ENTITY_PATTERNS = tuple((k, _B + p + _E) for k, p in (("acronym", r"[A-Z]{2,6}"), ("tool", r"[a-z]+-(?:hub|cli|lint|sync|forge)"), ("path", r"[a-z]+(?:/[a-z0-9_]+)+\.[a-z]{2,4}"), ("name", r"[A-Z][a-z]+(?: [A-Z][a-z]+)+")))


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, entity): distinct matches of each pattern."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(L.matches(text, p)).alias("found")) for k, p in ENTITY_PATTERNS])
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(each).alias("x"))
    return rows.select(key, "x.kind", F.explode("x.found").alias("entity"))


def domain_histogram(df: DataFrame, text: str, vocabulary: dict[str, tuple[str, ...]], least: int = 2) -> DataFrame:
    """(domain, hits): records that hold a word of the domain's vocabulary, summed over words, from ``least`` hits on; one pass."""
    t = F.lower(text)
    n = [sum((F.contains(t, F.lit(w)).cast("long") for w in ws), F.lit(0).cast("long")).alias(d) for d, ws in vocabulary.items()]
    total = df.select(*n).agg(*[F.sum(d).alias(d) for d in vocabulary])
    return total.select(F.explode(F.map_from_arrays(F.array(*[F.lit(d) for d in vocabulary]), F.array(*vocabulary))).alias("domain", "hits")).where(F.col("hits") >= least)


def scopes(c: Column, table: dict[str, str]) -> Column:
    """Sorted names of the scopes whose pattern matches."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), F.lit(k)) for k, p in table.items()])))


def scope_filter(df: DataFrame, text: str, table: dict[str, str], asked: list[str]) -> DataFrame:
    """Preferences stay if confident (0.9), unscoped, or of an asked scope; other types always."""
    s = scopes(F.col(text), table)
    return df.where((F.col("type") != "user_preference") | (F.col("confidence") >= 0.9) | (F.size(s) == 0) | F.arrays_overlap(s, F.array(*[F.lit(a) for a in asked])))


def near_groups(df: DataFrame, by: list[str], key: str, tokens: str, least: float) -> DataFrame:
    """(by, key, leader): greedy leader groups in order of key, which is unique: a row joins the first leader that it resembles, else it leads.

    Equal token sets share their leader, so only the first of each is compared. Of the links
    among these, rows that no undecided row precedes lead, and what they are linked to
    follows; the rounds end when no link is left undecided.
    """
    scratch = Scratch(df.sparkSession, "near_groups")
    rows = scratch.write(df.select(*by, key, F.array_sort(F.coalesce(tokens, F.array().cast("array<string>"))).alias("tok")))
    # empty sets resemble nothing, not even each other
    own = F.when(F.size("tok") == 0, F.col(key))
    first = rows.groupBy(*by, "tok", own.alias("own")).agg(F.min(key).alias(key))
    links = scratch.write(A.jaccard_pairs(first, key, "tok", by, least).select("key_a", "key_b"))
    gone = lambda df, out, c: df.join(out.select(F.col("v").alias(c)), c, "left_anti")
    follow, left = None, links
    while not left.isEmpty():
        heads = left.select("key_a").distinct().join(left.select(F.col("key_b").alias("key_a")).distinct(), "key_a", "left_anti")
        found = scratch.write(left.join(heads, "key_a", "left_semi").select(F.col("key_b").alias("v")).distinct())
        follow = found if follow is None else follow.unionByName(found)
        last, left = left, scratch.write(gone(gone(left, found, "key_a"), found, "key_b"))
        if last is not links:
            scratch.drop(last)
    led = links if follow is None else gone(links, follow, "key_a")
    led = led.groupBy(F.col("key_b").alias("first")).agg(F.min("key_a").alias("led"))
    w = Window.partitionBy(*by, "tok", own)
    out = rows.withColumn("first", F.min(key).over(w)).join(led, "first", "left")
    return out.select(*by, key, F.coalesce("led", "first").alias("leader"))


def last_words(df: DataFrame, by: str, order: str, n: int = 10) -> DataFrame:
    """Each message with the ``n`` before it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("history", F.collect_list("text").over(w))
