"""Rules: matching, conflicts, merging, limits, injection, mining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import language as L
from memlake.functions import scoring as S
from memlake.operators import skew
from memlake.sources.tables import Scratch

# Which scope wins in a merge, and which rule types oppose each other.
SCOPE_PRIORITY = {"company": 3, "negotiated": 2, "personal": 1}
OPPOSED_TYPES = (("always", "avoid"), ("always", "forbid"), ("prefer", "avoid"), ("prefer", "forbid"))


def rule_tokens(c: Column | str) -> Column:
    """Distinct Latin words and numbers in lower case, and every one to three neighbouring CJK characters."""
    c = F.col(c) if isinstance(c, str) else c
    runs = L.matches(c, L.CJK + "+")
    at = lambda r, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(r) - i + 1)), lambda n: F.substr(r, i, n))
    grams = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: at(r, i)))))
    return F.array_distinct(F.concat(L.matches(F.lower(c), r"[a-z0-9_]+"), grams))


def active(rules: DataFrame, at: Column | None = None, scopes: tuple[str, ...] = (), conditions: tuple[str, ...] = ()) -> DataFrame:
    """Rules in force: active, not expired, of an asked scope, and without a condition or with one that shares a word with ``conditions`` where any are given."""
    if "status" in rules.columns:
        rules = rules.where("status = 'active'")
    if at is not None and "expires_at" in rules.columns:
        rules = rules.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))
    if scopes:
        rules = rules.where(F.col("scope").isin(*scopes))
    if conditions and "condition" in rules.columns:
        given = sorted({w for c in conditions for w in c.lower().split()})
        shared = F.arrays_overlap(rule_tokens("condition"), F.array(*[F.lit(w) for w in given]))
        rules = rules.where((F.coalesce("condition", F.lit("")) == "") | shared)
    return rules


def _text_classes(asked: DataFrame, texts: DataFrame, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Rules as (doc, class), and (query_id, class, bm25), of rules (doc, texts) and the words asked for (query_id, w).

    Equal texts are looked at once. A class holds the texts that have equal lengths and equal
    counts of the words that any query asks for, which is all that the weight depends on.
    """
    docs = texts.groupBy("doc").agg(F.count("*").alias("n"), F.first("texts").alias("texts"))
    t = docs.select("doc", "n", F.explode("texts").alias("text")).select("doc", "n", L.matches("text", r"[\p{L}\p{N}_]+").alias("t")).withColumn("len", F.size("t"))
    stats = t.agg(F.sum("n").alias("docs"), (F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("mean"))
    tf = t.select("doc", "n", "len", F.explode("t").alias("w")).groupBy("doc", "n", "len", "w").agg(F.count("*").alias("tf"))
    weight = tf.groupBy("w").agg(F.sum("n").alias("df")).join(asked.select("w").distinct(), "w", "left_semi").crossJoin(F.broadcast(stats))  # stats: one row
    kept = tf.drop("n").hint("merge").join(weight, "w")
    form = kept.groupBy("doc").agg(F.to_json(F.sort_array(F.collect_list(F.struct("len", "w", "tf")))).alias("form"))
    shown = form.groupBy("form").agg(F.min("doc").alias("class"))
    s = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    posting = kept.join(shown.select(F.col("class").alias("doc")), "doc", "left_semi").select("w", F.col("doc").alias("class"), s.alias("s"))
    found = asked.join(posting, "w").groupBy("query_id", "class").agg(F.round(F.sum("s"), 9).alias("bm25"))
    return form.hint("merge").join(shown, "form").select("doc", "class"), found


def _texts(rules: DataFrame) -> DataFrame:
    """(rule_id, doc, texts): one row per rule."""
    text = F.lower(F.concat_ws(" ", "trigger", "action"))
    each = rules.groupBy("rule_id").agg(F.sort_array(F.collect_list(text)).alias("texts"))
    return each.select("rule_id", F.to_json("texts").alias("doc"), "texts")


def _given(rules: DataFrame, found: DataFrame, least: int = 10_000) -> DataFrame:
    """Each rule of (rule_id, class) with all rows found for its class; classes of more than ``least`` rules in shares. Merged, as the rules' small file must not make them a broadcast."""
    rows = Scratch(rules.sparkSession, "rules").write(rules.select("rule_id", "class"))
    hot = skew.hot_keys(rows, "class", least)
    return skew.salt(rows, "class", F.col("rule_id"), hot).hint("merge").join(skew.replicate(found, "class", hot), ["class", "salt"]).drop("class", "salt")


def search(queries: DataFrame, rules: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rule_id, bm25): rules whose trigger or action shares a token with the query (query_id, query), weighted by BM25 over all rules."""
    asked = queries.select("query_id", F.explode(L.word_tokens("query")).alias("w"))
    texts = _texts(rules)
    classes, found = _text_classes(asked, texts.select("doc", "texts"), k1, b)
    return _given(texts.select("rule_id", "doc").hint("merge").join(classes, "doc"), found).select("query_id", "rule_id", "bm25")


def _trigger_classes(lows: DataFrame, scenes: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triggers as (low, like), and (like, t): ``like`` is a trigger that equals the same scene, if any, and shares the same tokens with scenes."""
    tokens = lows.select("low", F.explode(rule_tokens("low")).alias("t")).where(F.length("t") >= 2).join(words.select("t").distinct(), "t", "left_semi")
    held = tokens.groupBy("low").agg(F.to_json(F.sort_array(F.collect_set("t"))).alias("held"))
    equal = scenes.select(F.col("scene").alias("low"), F.lit(True).alias("equal")).distinct()
    form = lows.join(held, "low", "left").join(equal, "low", "left").withColumn("own", F.when(F.col("equal"), F.col("low")))
    shown = form.groupBy("held", "own").agg(F.min("low").alias("like"))
    same = form["held"].eqNullSafe(shown["held"]) & form["own"].eqNullSafe(shown["own"])
    return form.join(shown, same).select("low", "like"), tokens.join(shown.select(F.col("like").alias("low")), "low", "left_semi").select(F.col("low").alias("like"), "t")


def _shapes(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(text, shape, len, held): ``shape`` is a text of equal length and with equal counts of the words that are asked for (w)."""
    t = texts.select("text", L.matches("text", r"[\p{L}\p{N}_]+").alias("t"))
    tf = t.select("text", F.explode("t").alias("w")).groupBy("text", "w").agg(F.count("*").alias("tf")).join(asked.select("w").distinct(), "w", "left_semi")
    held = tf.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("w", "tf"))).alias("held"))
    form = t.select("text", F.size("t").alias("len")).join(held, "text", "left").withColumn("form", F.to_json(F.struct("len", "held")))
    shown = form.groupBy("form").agg(F.min("text").alias("shape"))
    return form.join(shown, "form").select("text", "shape", "len", F.coalesce("held", F.array().cast("array<struct<w:string,tf:bigint>>")).alias("held"))


def _class_weights(asked: DataFrame, classes: DataFrame, shapes: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, class, bm25) of the words asked for (query_id, w) and classes (class, n, texts) of n rules, each text the shapes of a trigger and an action."""
    of = lambda side: shapes.select(F.col("shape").alias(side), F.col("len").alias(f"{side}_len"), F.col("held").alias(f"{side}_held"))
    t = classes.select("class", "n", F.explode("texts").alias("x")).select("class", "n", "x.trigger", "x.action").join(of("trigger"), "trigger").join(of("action"), "action")
    t = t.select("class", "n", (F.col("trigger_len") + F.col("action_len")).alias("len"), F.concat("trigger_held", "action_held").alias("held"))
    stats = t.agg(F.sum("n").alias("docs"), (F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("mean"))
    tf = t.select("class", "n", "len", F.explode("held").alias("x")).groupBy("class", "n", "len", F.col("x.w").alias("w")).agg(F.sum("x.tf").alias("tf"))
    weight = tf.groupBy("w").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(stats))  # stats: one row
    s = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    posting = tf.join(weight, "w").select("w", "class", s.alias("s"))
    return asked.join(posting, "w").groupBy("query_id", "class").agg(F.round(F.sum("s"), 9).alias("bm25"))


#: So many distinct texts at most are sent to all tasks, after they have been counted.
SENT_TEXTS = 10_000


def match(scenes: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """(scene_id, rule_id, match_type, score, rank): best k rules per scene, of each rule its best match.

    Global rules (trigger '*') .6 for every scene, an equal trigger 1.0, text search a tenth
    of the BM25 weight between .3 and .95, a trigger within the scene or sharing a token .5;
    plus bonuses, at most 1. Candidates come from equi joins on tokens; global rules are a few
    by ``limits`` and only the k best of them can count for any scene.

    Words are looked for in distinct triggers and actions only. Rules that no scene tells
    apart and that have one bonus are a unit. They have one score with any scene, so only the
    k first ids of a unit can count, and of the units in order of score and first id only the
    k first (k times as many rows as a rule has at most).
    """
    scratch = Scratch(rules.sparkSession, "match")
    bonus = S.rule_bonus(F.col("override"), F.col("trigger_count").cast("double"), F.col("confidence"))
    ru = rules.select("rule_id", "trigger", F.lower("trigger").alias("low"), F.coalesce(F.lower("action"), F.lit("")).alias("does"), bonus.alias("bonus"))
    sc = scratch.write(scenes.select("scene_id", F.lower(F.trim("scene")).alias("scene")))
    every = ru.where("trigger = '*'").orderBy(F.desc("bonus"), "rule_id").limit(k)  # at most k rows
    whole = sc.crossJoin(F.broadcast(every.select("rule_id", "bonus"))).select("scene_id", "rule_id", F.lit("global").alias("match_type"), F.lit(0.6).alias("base"), "bonus")
    local = ru.where("trigger <> '*'")
    most = local.groupBy("rule_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 1  # of one rule: 1 where ids are unique
    asked = sc.select(F.col("scene_id").alias("query_id"), F.explode(L.word_tokens("scene")).alias("w"))
    st = sc.select("scene_id", F.explode(rule_tokens("scene")).alias("t")).where(F.length("t") >= 2)
    said = scratch.write(local.select(F.explode(F.array(F.struct(F.col("low").alias("text"), F.lit(True).alias("trigger")), F.struct(F.col("does").alias("text"), F.lit(False).alias("trigger")))).alias("x")).select("x.*").distinct())
    shapes = scratch.write(_shapes(said.select("text").distinct(), asked))
    of = lambda text, shape: shapes.select(F.col("text").alias(text), F.col("shape").alias(shape))
    likes, tokens = _trigger_classes(said.where("trigger").select(F.col("text").alias("low")), sc, st)
    triggers = scratch.write(likes.join(of("low", "trigger"), "low"))
    few = said.count() <= SENT_TEXTS
    sent = lambda df: F.broadcast(df) if few else df.hint("merge")
    shaped = local.drop("trigger").join(sent(triggers), "low").join(sent(of("does", "action")), "does")
    texts = F.struct("trigger", "action")
    texts = F.array(texts) if most == 1 else F.sort_array(F.collect_list(texts).over(Window.partitionBy("rule_id")))
    rows = scratch.write(shaped.withColumn("texts", texts).select("rule_id", "like", "bonus", "texts", F.to_json("texts").alias("class")))
    classes = rows.groupBy("class", "texts").agg(F.count("*").alias("n")).withColumn("n", (F.col("n") / F.size("texts")).cast("long"))
    found = _class_weights(asked, classes, shapes.where("text = shape"))
    w = Window.partitionBy("class", "like", "bonus").orderBy("rule_id")
    units = rows if most == 1 else rows.select("rule_id", "class", "like", "bonus").distinct()
    first = scratch.write(units.select("class", "like", "bonus", "rule_id", F.row_number().over(w).alias("at")).where(F.col("at") <= k))
    pairs = first.where("at = 1").groupBy("class", "like").agg(F.max(F.coalesce("bonus", F.lit(1.0))).alias("top"))  # no bonus gives the score 1
    text = found.withColumnRenamed("query_id", "scene_id").join(pairs, "class").select("scene_id", "class", "like", F.lit("fts").alias("match_type"), F.least(F.greatest(F.col("bm25") / 10, F.lit(0.3)), F.lit(0.95)).alias("base"), "top")
    exact = sc.withColumnRenamed("scene", "like").join(pairs, "like").select("scene_id", "class", "like", F.lit("exact").alias("match_type"), F.lit(1.0).alias("base"), "top")
    near = st.join(tokens, "t").select("scene_id", "like").distinct().join(pairs, "like").select("scene_id", "class", "like", F.lit("partial").alias("match_type"), F.lit(0.5).alias("base"), "top")
    base = exact.unionByName(text).unionByName(near).groupBy("scene_id", "class", "like").agg(F.max(F.struct("base", "match_type")).alias("m"), F.max("top").alias("top"))
    score = F.round(F.least(F.lit(1.0), F.col("base") + F.col("bonus")), 6)
    base = scratch.write(base.withColumn("most", F.round(F.least(F.lit(1.0), F.col("m.base") + F.col("top")), 6)).drop("top"))
    # one unit at least of each class and like has the score "most", so units below the last of the first so many of these are not needed
    w = Window.partitionBy("scene_id").orderBy(F.desc("most"))
    least = base.select("scene_id", "most", F.row_number().over(w).alias("at")).where(F.col("at") <= k * most)
    least = least.groupBy("scene_id").agg(F.when(F.count("*") == k * most, F.min("most")).alias("least"))
    base = base.join(least, "scene_id").where(F.col("least").isNull() | (F.col("most") >= F.col("least")))
    heads = base.join(first.where("at = 1"), ["class", "like"]).select("scene_id", "class", "like", "bonus", "rule_id", "m.base", "m.match_type", "least").withColumn("score", score)
    heads = heads.where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")
    w = Window.partitionBy("scene_id").orderBy(F.desc("score"), "rule_id")
    heads = heads.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k * most).drop("at", "rule_id")
    ids = first.select(F.col("class").alias("c"), F.col("like").alias("l"), F.col("bonus").alias("b"), "rule_id")
    given = heads.join(ids, (F.col("class") == F.col("c")) & (F.col("like") == F.col("l")) & F.col("bonus").eqNullSafe(F.col("b")))
    rows = given.select("scene_id", "rule_id", "match_type", "base", "score").unionByName(whole.withColumn("score", score).drop("bonus"))
    best = rows.groupBy("scene_id", "rule_id").agg(F.max(F.struct("score", "base", "match_type")).alias("b"))
    w = Window.partitionBy("scene_id").orderBy(F.desc("b.score"), "rule_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("scene_id", "rule_id", "b.match_type", "b.score", "rank")


# How grave a conflict is.
SEVERITY = {"redundancy": "low", "contradiction": "critical", "overlap": "medium", "global": "critical"}


def _near_triggers(triggers: DataFrame) -> DataFrame:
    """(x < y) of distinct triggers that overlap: either '*' or empty, one within the other, or half of the fewer words shared.

    A trigger within another is found by its rarest piece of three characters. Of two word
    sets that share half of the fewer, the rarest words of the smaller one, all but half,
    hold a shared one.
    """
    words = F.array_distinct(F.filter(F.split("trigger", r"\s+"), lambda x: x != ""))
    all_ = triggers.where(F.col("trigger").isNotNull()).select("trigger", words.alias("words"), F.size(words).alias("m"))
    t = all_.where(~F.col("trigger").isin("*", ""))
    piece = F.transform(F.sequence(F.lit(1), F.greatest(F.length("trigger") - F.col("len") + 1, F.lit(1))), lambda i: F.substr("trigger", i, F.col("len")))
    lengths = t.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("trigger")))))
    pieces = lengths.select("trigger", F.explode(F.array_distinct(piece)).alias("k"))  # those shorter than three are for triggers that are so themselves
    own = pieces.where(F.length("k") == F.least(F.lit(3), F.length("trigger"))).join(pieces.groupBy("k").agg(F.count("*").alias("n")), "k")
    rarest = own.groupBy(F.col("trigger").alias("inner")).agg(F.min_by("k", F.struct("n", "k")).alias("k"))
    within = pieces.join(rarest, "k").where((F.col("trigger") != F.col("inner")) & F.contains("trigger", F.col("inner"))).select("trigger", "inner")
    each = t.select("trigger", "m", F.explode("words").alias("k"))
    freq = each.groupBy("k").agg(F.count("*").alias("n"))
    w = Window.partitionBy("trigger").orderBy("n", "k")
    least = F.greatest(F.ceil(F.col("m") / 2), F.lit(1))
    prefix = each.join(freq, "k").withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("m") - least + 1).select(F.col("trigger").alias("inner"), F.col("m").alias("mi"), "k")
    both = each.join(prefix, "k").where((F.col("mi") <= F.col("m")) & (F.col("trigger") != F.col("inner"))).select("trigger", "inner").distinct()
    of = t.select("trigger", "words")
    both = both.join(of, "trigger").join(of.select(F.col("trigger").alias("inner"), F.col("words").alias("q")), "inner")
    shared = F.size(F.array_intersect("words", "q"))
    close = both.where((shared >= 1) & (shared / F.size("q") >= 0.5)).select("trigger", "inner")
    near = within.unionByName(close).select(F.least("trigger", "inner").alias("x"), F.greatest("trigger", "inner").alias("y")).distinct()
    special = all_.where(F.col("trigger").isin("*", "")).select(F.col("trigger").alias("inner"))  # two rows at most
    star = all_.select("trigger").crossJoin(F.broadcast(special)).where(~F.col("trigger").isin("*", "") | (F.col("trigger") > F.col("inner")))
    return near.unionByName(star.select(F.least("trigger", "inner").alias("x"), F.greatest("trigger", "inner").alias("y")))


def _ruled(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", F.lower(F.trim("trigger")).alias("trigger"), "action", "rule_type").where("rule_id is not null and trigger is not null")


def _opposed(a: str, b: str) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "/").isin(*["/".join(sorted(p)) for p in OPPOSED_TYPES])


def _kind() -> Column:
    """Of the rules x, action_a, rule_type_a and y, action_b, rule_type_b, whose triggers overlap."""
    same = (F.col("x") == F.col("y")) & (F.col("action_a") == F.col("action_b")) & (F.col("rule_type_a") == F.col("rule_type_b"))
    over = (F.col("rule_type_a") == F.col("rule_type_b")) & (F.col("action_a") != F.col("action_b"))
    return F.when(same, "redundancy").when(_opposed("rule_type_a", "rule_type_b"), "contradiction").when(over, "overlap")


#: Rules of one list of a trigger and type, about; a list is a value, which a task holds whole.
LISTED = 4_000


def conflicts(rules: DataFrame) -> DataFrame:
    """(kind, severity, rule_a < rule_b) of rules whose triggers overlap: equal, either '*', one within the other, or half of the fewer words shared.

    Redundant rules have one trigger, action and type; opposed types contradict; equal types with
    another action overlap. Rules are first taken together in lists by trigger and type, so pairs
    are looked at between distinct triggers, types are compared once per two lists, and only
    lists are shuffled and joined: their pairs are written out as they are formed.
    """
    scratch = Scratch(rules.sparkSession, "conflicts")
    r = scratch.write(_ruled(rules).where("rule_type is not null"))  # no kind without a type
    triggers = scratch.write(r.select("trigger").distinct())
    pairs = _near_triggers(triggers).unionByName(triggers.select(F.col("trigger").alias("x"), F.col("trigger").alias("y")))
    hot = skew.hot_keys(r, "trigger", LISTED)
    lists = scratch.write(skew.salt(r, "trigger", F.col("rule_id"), hot).groupBy("trigger", "salt", "rule_type").agg(F.collect_list(F.struct("rule_id", "action")).alias("list")))
    side = lambda t, s: lists.select(F.col("trigger").alias(t), "salt", F.col("rule_type").alias(f"rule_type_{s}"), F.col("list").alias(f"list_{s}")).hint("merge")
    left = skew.replicate(pairs.join(side("x", "a").drop("salt"), "x"), "y", hot)
    both = left.join(side("y", "b"), ["y", "salt"]).withColumn("opposed", _opposed("rule_type_a", "rule_type_b")).where(F.col("opposed") | (F.col("rule_type_a") == F.col("rule_type_b")))
    each = both.select((F.col("x") == F.col("y")).alias("own"), "opposed", F.explode("list_a").alias("a"), "list_b").select("own", "opposed", "a", F.explode("list_b").alias("b"))
    differs, same = F.col("a.action") != F.col("b.action"), F.col("own") & (F.col("a.action") == F.col("b.action"))
    one = F.when(F.col("own"), F.col("a.rule_id") < F.col("b.rule_id")).otherwise(F.col("a.rule_id") != F.col("b.rule_id"))
    kind = lambda of: F.when(F.col("opposed"), of("contradiction")).when(differs, of("overlap")).otherwise(of("redundancy"))
    out = each.where(one & (F.col("opposed") | differs | same))
    return out.select(kind(F.lit).alias("kind"), F.least("a.rule_id", "b.rule_id").alias("rule_a"), F.greatest("a.rule_id", "b.rule_id").alias("rule_b"), kind(lambda k: F.lit(SEVERITY[k])).alias("severity"))


def _severity() -> Column:
    out = F.lit(None).cast("string")
    for k, v in SEVERITY.items():
        out = F.when(F.col("kind") == k, v).otherwise(out)
    return out


def health(rules: DataFrame) -> DataFrame:
    """(severity, n): conflicts by severity, counted without listing them.

    Rules of one trigger, type and action are one row with their number; products of these
    numbers count the pairs of rules. Pairs of rows of one rule_id are no conflict and are
    taken off again.
    """
    r = _ruled(rules)
    g = r.groupBy("trigger", "rule_type", "action").agg(F.count("*").alias("n"))
    near = _near_triggers(r.select("trigger").distinct())
    by = g.groupBy("trigger", "rule_type").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("action").isNotNull(), F.col("n"))), F.lit(0)).alias("told"), F.sum(F.when(F.col("action").isNotNull(), F.col("n") * F.col("n"))).alias("squares"), F.sum(F.when(F.col("action").isNotNull(), F.col("n") * (F.col("n") - 1))).alias("twins")).where("rule_type is not null")
    side = lambda df, t, s: df.select(*[F.col(c).alias(t if c == "trigger" else f"{c}_{s}") for c in df.columns])
    counts = lambda df, kind, n: df.select(F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    # two triggers: opposed types, and equal types without the pairs of equal actions
    types = near.join(side(by, "x", "a"), "x").join(side(by, "y", "b"), "y")
    n_two = F.when(_opposed("rule_type_a", "rule_type_b"), F.col("n_a") * F.col("n_b")).otherwise(F.lit(0))
    told = F.when(F.col("rule_type_a") == F.col("rule_type_b"), F.col("told_a") * F.col("told_b")).otherwise(F.lit(0))
    acts = g.where("rule_type is not null and action is not null")
    alike = near.join(acts.withColumnRenamed("trigger", "x"), "x").join(acts.select(F.col("trigger").alias("y"), "rule_type", "action", F.col("n").alias("n_b")), ["y", "rule_type", "action"])
    parts = [counts(types, "contradiction", n_two), counts(types, "overlap", told), counts(alike, "overlap", -F.col("n") * F.col("n_b"))]
    # one trigger
    own = side(by, "x", "a").join(side(by, "x", "b"), "x").where("rule_type_a < rule_type_b")
    parts += [counts(own, "contradiction", n_two), counts(by, "overlap", (F.col("told") * F.col("told") - F.coalesce("squares", F.lit(0))) / 2), counts(by, "redundancy", F.coalesce("twins", F.lit(0)) / 2)]
    # rows of one rule_id
    again = r.groupBy("rule_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("rule_id")
    twice = r.join(again, "rule_id", "left_semi").groupBy("rule_id", "trigger", "rule_type", "action").agg(F.count("*").alias("n")).withColumn("key", F.struct("trigger", "rule_type", "action"))
    a, b = (twice.select("rule_id", *[F.col(c).alias(f"{c}_{s}") for c in ("trigger", "rule_type", "action", "n", "key")]) for s in "ab")
    same = a.join(b, "rule_id").where("key_a <= key_b").withColumn("x", F.least("trigger_a", "trigger_b")).withColumn("y", F.greatest("trigger_a", "trigger_b"))
    same = same.join(near.withColumn("near", F.lit(True)), ["x", "y"], "left").where("near or x = y")
    pairs = F.when(F.col("key_a") == F.col("key_b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    parts.append(same.select(_kind().alias("kind"), (-pairs).cast("long").alias("n")))
    rows = reduce(DataFrame.unionByName, parts).where("kind is not null").withColumn("severity", _severity())
    return rows.groupBy("severity").agg(F.sum("n").alias("n")).where("n > 0")


def implicit_preferences(df: DataFrame, text: str, domains: dict[str, tuple[str, ...]], least: int = 3, share: float = 0.5) -> DataFrame:
    """(namespace, domain, choice, n, ratio, confidence): the word of a domain that a namespace mentions most, at least ``least`` times and in ``share`` of all mentions."""
    names = [F.struct(F.lit(d).alias("domain"), F.lit(w).alias("choice"), F.regexp_count(F.lower(text), F.lit(rf"\b{w}\b")).alias("n")) for d, ws in domains.items() for w in ws]
    each = df.select("namespace", F.explode(F.filter(F.array(*names), lambda x: x["n"] > 0)).alias("x")).groupBy("namespace", "x.domain", "x.choice").agg(F.sum("x.n").alias("n"))
    by = each.groupBy("namespace", "domain").agg(F.sum("n").alias("total"), F.min_by("choice", F.struct(-F.col("n"), "choice")).alias("choice"), F.max("n").alias("n"))
    by = by.withColumn("ratio", F.col("n") / F.col("total")).where((F.col("total") >= least) & (F.col("n") >= least) & (F.col("ratio") >= share))
    return by.select("namespace", "domain", "choice", "n", F.round("ratio", 6).alias("ratio"), F.round(F.least(0.5 + 0.3 * F.col("ratio"), F.lit(0.9)), 6).alias("confidence"))


def _asked_classes(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(text, like, words): ``like`` is a text that shares the same words with queries (query, qw) and contains the same queries."""
    words = texts.select("text", F.explode(L.space_tokens("text")).alias("w")).join(queries.select(F.explode("qw").alias("w")).distinct(), "w", "left_semi")
    held = words.groupBy("text").agg(F.sort_array(F.collect_set("w")).alias("words"))
    piece = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - F.col("len") + 1, F.lit(1))), lambda i: F.substr("text", i, F.col("len")))
    lengths = texts.where(F.length("text") > 0).withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("text")))))
    begun = queries.select("query", F.substring("query", 1, 3).alias("k")).distinct()
    within = lengths.select("text", F.explode(F.array_distinct(piece)).alias("k")).join(begun, "k").where(F.contains("text", F.col("query")))
    within = within.groupBy("text").agg(F.sort_array(F.collect_set("query")).alias("within"))
    form = texts.join(held, "text", "left").join(within, "text", "left").withColumn("form", F.to_json(F.struct("words", "within")))
    shown = form.groupBy("form").agg(F.min("text").alias("like"))
    return form.join(shown, "form").select("text", "like", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def rank_estimate(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, rule_id, score) of rules that share a word with a query: .5, .3 more if the trigger holds the query, .1 if the action does, .2 times the share of its words in the trigger; at most 1.

    Scores are computed per query and class of rules, whose triggers and actions no query
    tells apart, and then given to the rules of the class.
    """
    scratch = Scratch(rules.sparkSession, "estimate")
    q = queries.select("query_id", F.lower("query").alias("query"), L.space_tokens("query").alias("qw")).distinct()
    r = rules.select("rule_id", F.lower("trigger").alias("trigger"), F.lower("action").alias("action")).where("trigger is not null and action is not null")
    texts = r.select(F.explode(F.array("trigger", "action")).alias("text")).distinct()
    likes = scratch.write(_asked_classes(texts, q))
    of = lambda c: likes.select(F.col("text").alias(c), F.col("like").alias(f"{c}_like"))
    both = r.join(of("trigger"), "trigger").join(of("action"), "action").select("rule_id", "trigger_like", "action_like", F.to_json(F.struct("trigger_like", "action_like")).alias("class"))
    both = scratch.write(both)
    words = lambda c, n: likes.select(F.col("text").alias(c), F.col("words").alias(n))
    classes = both.groupBy("class", "trigger_like", "action_like").agg(F.lit(1).alias("_")).join(words("trigger_like", "tw"), "trigger_like").join(words("action_like", "aw"), "action_like")
    each = classes.select("class", F.col("trigger_like").alias("trigger"), F.col("action_like").alias("action"), "tw", F.explode(F.array_distinct(F.concat("tw", "aw"))).alias("w"))
    hit = q.select("query_id", "query", "qw", F.explode("qw").alias("w")).join(each, "w").drop("w").distinct()
    shared = F.size(F.array_intersect("qw", "tw")) / F.greatest(F.size("qw"), F.lit(1))
    s = 0.5 + F.when(F.contains("trigger", F.col("query")), 0.3).otherwise(0.0) + F.when(F.contains("action", F.col("query")), 0.1).otherwise(0.0) + 0.2 * shared
    found = hit.select("query_id", "class", F.round(F.least(s, F.lit(1.0)), 6).alias("score"))
    return _given(both, found).select("query_id", "rule_id", "score")


def counted(rules: DataFrame, log: DataFrame) -> DataFrame:
    """Rules with ``trigger_count`` raised by an event log (rule_id), any number of events at once."""
    n = log.groupBy("rule_id").agg(F.count("*").alias("new"))
    return rules.join(n, "rule_id", "left").withColumn("trigger_count", F.col("trigger_count") + F.coalesce("new", F.lit(0))).drop("new")


def listed(rules: DataFrame, k: int, skip: int = 0, **only) -> DataFrame:
    """A page of rules: equal to ``only``, the newest id first."""
    for c, v in only.items():
        rules = rules.where(F.col(c) == v)
    return rules.orderBy(F.desc("rule_id")).offset(skip).limit(k)


def merge(existing: DataFrame, incoming: DataFrame, strategy: str = "scope") -> DataFrame:
    """One rule per trigger of both sets: 'keep' (existing wins), 'replace' (incoming wins) or 'scope' (higher scope, then higher confidence, then existing)."""
    rows = existing.withColumn("side", F.lit(1)).unionByName(incoming.withColumn("side", F.lit(2)))
    order: list[Column] = {
        "keep": [F.asc("side")],
        "replace": [F.desc("side")],
        "scope": [F.desc(S.by_value("scope", {k: float(v) for k, v in SCOPE_PRIORITY.items()}, 0.0)), F.desc("confidence"), F.asc("side")],
    }[strategy]
    w = Window.partitionBy(F.lower(F.trim("trigger"))).orderBy(*order, "rule_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("rule_id", F.lower(F.trim("trigger")).alias("trigger"), "action", "scope", "side")


def limits(rules: DataFrame, per_type: int = 50, total: int = 200, most_global: int = 3) -> DataFrame:
    """Counts per type with what is left of each limit: of the type, of all rules, of global rules."""
    by = rules.groupBy("rule_type").agg(F.count("*").alias("n"), F.count_if("override").alias("n_override"))
    every = rules.agg(F.count("*").alias("n_all"), F.count_if(F.col("trigger") == "*").alias("n_global"))  # one row
    left = lambda most, c: F.greatest(F.lit(most) - F.col(c), F.lit(0))
    return by.crossJoin(F.broadcast(every)).select("rule_type", "n", "n_override", left(per_type, "n").alias("left_of_type"), left(total, "n_all").alias("left_of_all"), left(most_global, "n_global").alias("left_of_global"))


def accepted(rules: DataFrame, per_type: int = 50, total: int = 200, most_global: int = 3) -> DataFrame:
    """The rules that the limits let in, in order of rule_id: at most so many of all, of each type and global ones; each limit is applied to what the one before let in."""
    w = Window.partitionBy("rule_type").orderBy("rule_id")
    rows = rules.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_type)  # cut to per_type before anything is put into one task
    star = F.when(F.col("trigger") == "*", 1).otherwise(0)
    every = Window.orderBy("rule_id")
    rows = rows.withColumn("_g", F.sum(star).over(every)).where((F.col("trigger") != "*") | (F.col("_g") <= most_global))
    return rows.withColumn("_n", F.row_number().over(every)).where(F.col("_n") <= total).drop("_n", "_g")


def inject(matched: DataFrame, budget: int) -> DataFrame:
    """Rules per scene that fit: overriding ones always, others in order of score until the first that does not fit."""
    t = L.token_estimate_rules(F.when(F.col("override"), F.concat_ws(" ", "trigger", "action")).otherwise(F.col("action")))
    rows = matched.withColumn("tokens", t)
    w = Window.partitionBy("scene_id").orderBy(F.desc("override"), F.desc("score"), "rule_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.sum("tokens").over(w))
    return rows.where(F.col("override") | (F.col("used") <= budget)).select("scene_id", "rule_id", "tokens", "used")


def mine_keywords(df: DataFrame, key: str = "storage_key", least: int = 3) -> DataFrame:
    """(namespace, keyword, n): keywords found in at least ``least`` distinct records of a namespace."""
    each = df.select(key, "namespace", F.explode(L.keywords("content", most=2**31 - 1)).alias("keyword"))
    return each.groupBy("namespace", "keyword").agg(F.countDistinct(key).alias("n")).where(F.col("n") >= least)


def source_states(rules: DataFrame, records: DataFrame, sources: str = "sources") -> DataFrame:
    """(rule_id, n_active, n_superseded, n_deleted, confidence): each source's state and the confidence after penalties (.1 per deleted, .05 per superseded)."""
    each = rules.select("rule_id", "confidence", F.explode(sources).alias("storage_key"))
    state = records.select("storage_key", "superseded", F.lit(True).alias("there"))
    rows = each.join(state, "storage_key", "left")
    agg = rows.groupBy("rule_id", "confidence").agg(F.count_if(F.col("there") & ~F.col("superseded")).alias("n_active"), F.count_if(F.col("there") & F.col("superseded")).alias("n_superseded"), F.count_if(F.col("there").isNull()).alias("n_deleted"))
    c = F.greatest(F.lit(0.0), F.col("confidence") - 0.1 * F.col("n_deleted") - 0.05 * F.col("n_superseded"))
    return agg.withColumn("confidence", F.round(c, 6))


def effectiveness(rules: DataFrame) -> DataFrame:
    bucket = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return rules.groupBy("rule_type", "scope", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("trigger_count") > 0).alias("n_triggered"))


def extracted_rule(c: Column | str) -> Column:
    """struct(rule_type, action) of a text: avoid, prefer, always or none, with what follows the word."""
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    grab = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit(""))
    avoid, prefer, always = grab(r"\b(?:avoid|never|don't)\s+([^.,;\n]{3,80})"), grab(r"\b(?:prefer|rather have)\s+([^.,;\n]{3,80})"), grab(r"\balways\s+([^.,;\n]{3,80})")
    kind = F.when(avoid.isNotNull(), "avoid").when(prefer.isNotNull(), "prefer").when(always.isNotNull(), "always")
    return F.struct(kind.alias("rule_type"), F.coalesce(avoid, prefer, always).alias("action"))


def sanitised(trigger: Column, action: Column) -> Column:
    """True for rules within the limits and without blocked patterns."""
    bad = r"(?i)(<script|javascript:|\.\./|\bdrop\s+table\b|\bunion\s+select\b|\$\(|`)"
    ok = (F.length(trigger) <= 200) & (F.length(action) <= 500) & ~trigger.rlike(bad) & ~action.rlike(bad)
    return F.coalesce(ok & ~trigger.rlike(r"(;|--|/\*|\*/)"), F.lit(False))


def bundle(rules: DataFrame, name: str) -> DataFrame:
    """One row: the bundle's JSON lines in order of rule id, their number and a signature over all of them."""
    lines = rules.select("rule_id", F.to_json(F.struct("rule_id", "trigger", "action", "rule_type", "scope")).alias("line"))
    digest = lines.agg(F.sum(F.conv(F.substring(F.sha2("line", 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("d"), F.count("*").alias("n"))
    return digest.select(F.lit(name).alias("bundle"), "n", F.sha2(F.concat_ws(":", F.lit(name), "n", "d"), 256).alias("signature"))
