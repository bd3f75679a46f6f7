"""Consolidating pairwise links into groups by random contraction (problem 3).

Each round, every vertex hooks to the vertex of its closed neighbourhood that comes
first in a fresh hash order; edges are relabelled by that map and deduplicated, which
leaves about half of the vertices at most, whatever the shape (long chains, stars).
When no edge is left, the maps of all rounds are composed backwards, from the small
to the large, so the expansion costs no more than the contraction did.

Maps and edges of each round are written tables in the shared folder; nothing is
collected but row counts. Hot vertices (see ``skew``) are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import key_form
from memlake.operators import skew
from memlake.sources.tables import Scratch


def _order(v: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), v).alias("h"), v.alias("r"))


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    """(v, r, n): the first vertex in this round's hash order among v and its neighbours, and v's degree."""
    both = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("o")), F.struct(F.col("b").alias("v"), F.col("a").alias("o")))
    near = edges.select(F.explode(both).alias("x")).select("x.v", "x.o")
    best = near.groupBy("v").agg(F.min(_order(F.col("o"), seed)).alias("m"), F.count("*").alias("n"))
    return best.select("v", F.least("m", _order(F.col("v"), seed))["r"].alias("r"), "n")


def _relabel(edges: DataFrame, hooks: DataFrame, hot: skew.HotKeys | None) -> DataFrame:
    for c in ("a", "b"):
        to = hooks.select(F.col("v").alias(c), F.col("r").alias("to"))
        edges = skew.salted_join(edges, to, c, F.col("b" if c == "a" else "a"), hot).drop(c).withColumnRenamed("to", c)
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contract(spark, edges: DataFrame, scratch: Scratch, seed: int = 1, least_hot: int = skew.LEAST) -> DataFrame | None:
    """(v, root) of every vertex with at least one edge (a, b); None if there is no edge.

    ``edges`` holds distinct pairs a < b. The expected number of vertices falls by a
    constant factor a round, so the rounds end with certainty; there is no cap on them.
    """
    edges, maps = scratch.write(edges), []
    n = edges.count()
    while n:
        hooks = scratch.write(_hooks(edges, seed + len(maps)))
        # the degrees that hooking counted anyway tell the hot vertices of both columns
        hot = skew.from_counts(hooks, "v", 2 * n, least_hot)
        after = scratch.write(_relabel(edges, hooks, hot))
        scratch.drop(edges)
        maps.append((hooks, 2 * n))
        edges, n = after, after.count()
    scratch.drop(edges)
    if not maps:
        return None
    roots = maps[-1][0].select("v", F.col("r").alias("root"))
    for k in range(len(maps) - 2, -1, -1):
        # a vertex that vanished from the next graph is its own root
        hooks, most = maps[k]
        hot = skew.hot_keys(hooks, "r", least_hot, 0 if most < least_hot else None)
        on = roots.select(F.col("v").alias("r"), "root")
        step = skew.salted_join(hooks.select("v", "r"), on, "r", F.col("v"), hot, "left").select("v", F.coalesce("root", "r").alias("root"))
        roots = scratch.write(step) if k % 4 == 0 and k else step
    return roots


def group_forms(df: DataFrame, left: str = "canonical_form", right: str = "alias_form", within: str = "namespace", least_hot: int = skew.LEAST) -> DataFrame:
    """namespace, form, grp: one row per namespace and distinct form.

    A form is either column, stripped and in lower case; null and empty ones are no
    forms and link nothing (the other side still is one). ``grp`` is the smallest form
    by code points among those linked directly or through others. A null namespace is a
    namespace of its own. Repeated, reversed and self pairs change nothing; an empty
    table gives an empty result.
    """
    spark = df.sparkSession
    pairs = df.select(F.col(within).alias("namespace"), F.nullif(key_form(left), F.lit("")).alias("x"), F.nullif(key_form(right), F.lit("")).alias("y"))
    forms = pairs.select("namespace", F.explode(F.array("x", "y")).alias("form")).where(F.col("form").isNotNull()).distinct()
    vertex = lambda form: F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("n"), "namespace"), F.lit("-")), F.lit("\x00"), form)))
    edges = pairs.where(F.col("x") != F.col("y")).select(vertex(F.col("x")).alias("p"), vertex(F.col("y")).alias("q"))
    edges = edges.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    scratch = Scratch(spark, "components")
    roots = contract(spark, edges, scratch, least_hot=least_hot)
    named = forms.withColumn("v", vertex(F.col("form")))
    if roots is None:
        return forms.select("namespace", "form", F.col("form").alias("grp"))
    members = scratch.write(named.join(roots, "v", "left").select("namespace", "form", F.coalesce("root", "v").alias("root")))
    hot = skew.hot_keys(members, "root", least_hot)
    best = members.groupBy("root").agg(F.min("form").alias("grp"))
    return skew.salted_join(members, best, "root", F.col("form"), hot).select("namespace", "form", "grp")
