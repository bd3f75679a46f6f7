"""Aggregations, quality and hygiene over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.functions import scoring as S
from memlake.operators import ranks, skew


def profile(df: DataFrame) -> DataFrame:
    """namespace, n, avg_confidence, last_update, by type and tier at once (grouping sets): one row per set."""
    return df.groupingSets([[F.col("type")], [F.col("tier")], []], F.col("type"), F.col("tier")).agg(
        F.grouping_id().alias("set_no"), F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.max("updated_at").alias("last_update")
    )


def quality_analysis(df: DataFrame, score: str = "quality") -> DataFrame:
    """Per type mean, median (the mean of the two middle scores), range and tiers; the median comes from counts of equal scores."""
    by = df.groupBy("type").agg(
        F.round(F.avg(score), 6).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"), F.count(score).alias("n"),
        *[F.count_if(S.quality_tier(F.col(score)) == t).alias(t) for t in ("excellent", "good", "fair", "poor")],
    )
    counts = df.where(F.col(score).isNotNull()).groupBy("type", score).agg(F.count("*").alias("c"))
    upto = ranks.running_sum(counts, ["type"], [F.col(score).asc()], F.col("c"), "upto").join(by.select("type", "n"), "type")
    middle = lambda at: F.min(F.when(F.col("upto") > at, F.col(score)))
    mid = upto.groupBy("type").agg(F.round((middle(F.floor((F.col("n") - 1) / 2)) + middle(F.floor(F.col("n") / 2))) / 2, 6).alias("median"))
    return by.join(mid, "type").select("type", "mean", "median", "low", "high", "excellent", "good", "fair", "poor")


def latency_percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank p50, p95 (of more than 20 values), p99 per group."""
    out = ranks.nearest_ranks(df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.withColumn("p95", F.when(F.col("n") > 20, F.col("p95")))


def json_tags(df: DataFrame, column: str, path: str, k: int) -> DataFrame:
    """The k most frequent values of a JSON field, ties by value."""
    return df.select(F.get_json_object(column, path).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def jaccard_pairs(df: DataFrame, key: str, tokens: str, by: list[str], threshold: float, least_hot: int = skew.LEAST) -> DataFrame:
    """Pairs (key_a < key_b) within ``by`` whose token sets reach the threshold: prefix join on the rarest tokens, then verification.

    Tokens are ordered by their count over all rows; two sets at the threshold share one of
    the first n - ceil(t n) + 1, and what follows their first shared token must be long
    enough for the rest (position). Tokens of many rows are salted. Sets are fetched for
    pairs that passed. Nulls and empty sets have no partners.
    """
    rows = df.where(F.size(tokens) > 0).select(key, *by, F.col(tokens).alias("tok"), F.size(tokens).alias("n"))
    each = rows.select(key, *by, "n", F.explode("tok").alias("t"))
    df_of = each.groupBy("t").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("df", "t"))
    prefix = each.join(df_of, "t").withColumn("p", order).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    hot = skew.hot_keys(each, "t", least_hot)
    a, b = skew.salt(prefix, "t", F.col(key), hot).alias("a"), skew.replicate(prefix, "t", hot).alias("b")
    cond = (F.col("a.t") == F.col("b.t")) & (F.col("a.salt") == F.col("b.salt")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9)
    rest = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) + 1
    cond = cond & (rest >= (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9)
    for c in by:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    pairs = a.join(b, cond).select(F.col(f"a.{key}").alias("key_a"), F.col(f"b.{key}").alias("key_b")).distinct()
    left = rows.select(F.col(key).alias("key_a"), F.col("tok").alias("x"))
    right = rows.select(F.col(key).alias("key_b"), F.col("tok").alias("y"))
    sim = L.jaccard(F.col("x"), F.col("y"))
    return pairs.join(left, "key_a").join(right, "key_b").select("key_a", "key_b", sim.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


# Words that oppose each other, and words that announce an update.
CONTRADICTIONS = (
    ("like", "dislike"), ("prefer", "avoid"), ("love", "hate"), ("use", "stop using"), ("switched", "no longer"), ("moved", "left"), ("changed", "previous"), ("updated", "old"), ("now", "previously"),
    ("currently", "formerly"), ("new", "old"), ("current", "previous"), ("dark", "light"), ("yes", "no"), ("true", "false"), ("enabled", "disabled"), ("always", "never"),
)
UPDATE_MARKERS = ("now", "currently", "switched", "changed", "moved", "updated", "no longer", "instead", "replaced", "new")


def marks(c: Column | str) -> Column:
    """Names ('+i' or '-i') of the sides of ``CONTRADICTIONS`` that a text holds as words."""
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    word = lambda w: t.rlike(rf"(^|[^a-z0-9_]){w}($|[^a-z0-9_])")
    return F.array_compact(F.array(*[F.when(word(w), F.lit(f"{s}{i}")) for i, pair in enumerate(CONTRADICTIONS) for s, w in zip("+-", pair)]))


def is_update(c: Column | str) -> Column:
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    return t.rlike(r"(^|[^a-z0-9_])(" + "|".join(UPDATE_MARKERS) + r")($|[^a-z0-9_])")


def opposed(a: Column, b: Column) -> Column:
    other = F.transform(a, lambda m: F.concat(F.when(m.startswith("+"), "-").otherwise("+"), F.substring(m, 2, 9)))
    return F.arrays_overlap(other, b)


def supersede_candidates(df: DataFrame, key: str = "storage_key", last: int = 20, overlap: float = 0.4) -> DataFrame:
    """(new_key, old_key): of the last ``last`` older rows of namespace and type the newest that the row replaces.

    A row replaces another if their words oppose, or if it announces an update and their
    space tokens overlap enough; corrections replace nothing. The older rows ride along in
    a window of bounded length, so there is no self join.
    """
    w = Window.partitionBy("namespace", "type").orderBy("created_at", key).rowsBetween(-last, -1)
    item = F.struct(F.col(key).alias("k"), marks("content").alias("m"), L.space_tokens("content").alias("t"))
    rows = df.select(key, "namespace", "type", "created_at", item.alias("me"), is_update("content").alias("upd"))
    rows = rows.withColumn("older", F.collect_list("me").over(w))
    hit = F.filter("older", lambda o: opposed(F.col("me.m"), o["m"]) | (F.col("upd") & (L.jaccard(F.col("me.t"), o["t"]) >= overlap)))
    rows = rows.withColumn("hit", hit).where((F.size("hit") > 0) & (F.col("type") != "correction"))
    return rows.select(F.col(key).alias("new_key"), F.element_at("hit", -1)["k"].alias("old_key"))


def adjacent_updates(df: DataFrame, key: str = "storage_key") -> DataFrame:
    """(older_key, newer_key) of neighbours in time with one type and the same normalised first 100 characters."""
    w = Window.partitionBy("namespace", "type", "h").orderBy("created_at", key)
    rows = df.withColumn("h", L.normal_hash("content", 100))
    return rows.select(F.lag(key).over(w).alias("older_key"), F.col(key).alias("newer_key")).where("older_key is not null")


def consolidation(df: DataFrame, now: Column) -> DataFrame:
    """key, decay, new_confidence and action ('forget' below 0.1, 'decay' below 0.5, 'keep'); preferences are kept."""
    d = S.decay_factor(S.age_days("created_at", now), "type", "access_count", "confidence")
    act = F.when(F.col("type") == "user_preference", "keep").when(F.col("decay") < 0.1, "forget").when(F.col("decay") < 0.5, "decay").otherwise("keep")
    return df.withColumn("decay", d).select("storage_key", "decay", F.round(F.col("confidence") * F.col("decay"), 6).alias("new_confidence"), act.alias("action"))


def dedup_by_hash(df: DataFrame, key: str = "storage_key") -> DataFrame:
    """The first row of each namespace and content hash, with its raw text filled from later ones where empty."""
    first = F.min_by(F.struct(key, "raw_text", "created_at"), F.struct("created_at", key))
    fill = F.min_by("raw_text", F.when(F.coalesce(F.trim("raw_text"), F.lit("")) != "", F.struct("created_at", key)))
    out = df.groupBy("namespace", L.content_hash("type", "content").alias("h")).agg(first.alias("f"), fill.alias("fill"), F.count("*").alias("n"))
    raw = F.when(F.coalesce(F.trim("f.raw_text"), F.lit("")) != "", F.col("f.raw_text")).otherwise(F.col("fill"))
    return out.select("namespace", F.col(f"f.{key}").alias(key), raw.alias("raw_text"), "n")


def version_chain(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Versions numbered from 1 along a chain with the period each was valid."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("version_no", F.row_number().over(w)).withColumn("valid_to", F.lead(order[0]).over(w))


def merge_sources(df: DataFrame, strategy: str, key: str = "storage_key") -> DataFrame:
    """One row per content hash over all namespaces: latest_wins, highest_confidence or merge_all (sorted list of keys)."""
    rows = df.withColumn("h", L.content_hash("type", "content"))
    if strategy == "merge_all":
        return rows.groupBy("h").agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("kept"), F.countDistinct("namespace").alias("n_namespaces"))
    order = {"latest_wins": F.struct("created_at", key), "highest_confidence": F.struct("confidence", "created_at", key)}[strategy]
    return rows.groupBy("h").agg(F.max_by(key, order).alias("kept"), F.countDistinct("namespace").alias("n_namespaces"))


def rate_limits(df: DataFrame, ts: str, by: list[str], per_hour: int = 20, per_day: int = 50) -> DataFrame:
    """Rows with their trailing counts and whether a limit is broken."""
    from memlake.operators.recall import trailing_counts

    rows = trailing_counts(df, ts, by, {"n_hour": 3600, "n_day": 86_400})
    return rows.withColumn("blocked", (F.col("n_hour") > per_hour) | (F.col("n_day") > per_day))


def conflict_subject_counts(df: DataFrame, key: str = "storage_key") -> DataFrame:
    subject = F.coalesce(F.get_json_object("metadata", "$.subject"), F.col("version_chain_id"), F.col(key))
    return df.groupBy(subject.alias("subject")).agg(F.countDistinct(key).alias("n")).where("n > 1")
