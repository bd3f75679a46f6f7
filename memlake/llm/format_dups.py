"""Duplicates hidden by formatting (problem 7).

Canonical keys with many rows are found exactly by partial counts; their rows are
salted into a two-level aggregation, whose result (at most ``skew.MAX_HOT`` groups) is
sent to all tasks. All other rows meet in one shuffle on the canonical key, where a window
gives each its group's smallest identifier and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import letters_digits
from memlake.operators import skew
from memlake.sources.tables import Scratch

_NAME = r"[\p{L}_][\p{L}\p{N}_.-]*"
#: What may stand between the fields of a list, most distinctive first, and what a value may not hold then.
_SEPARATORS = ((r"\n+", r"\n"), (r"\|", r"|\n"), (r";", r";\n"), (r",", r",\n"), (r"&", r"&\s"), (r"\s+", r"\s"))


def _field(no: str) -> str:
    return rf"\s*[-*+•]?\s*[\"']?{_NAME}[\"']?\s*(?:=>|->|[:=])\s*[^{no}]*"


def field_list(c: Column) -> Column:
    """Sorted distinct ``name=value`` pairs, each side in letters and digits, of a list of named fields; null for other texts.

    A list is a JSON object, or at least three fields (an identifier, then ``:``, ``=``,
    ``=>`` or ``->``, and a value) with one separator between all of them: line breaks,
    ``|``, ``;``, ``,``, ``&`` or white space. Bullets and quotes around names are ignored.
    """
    t = F.trim(F.regexp_replace(c, r"\r\n?", "\n"))
    json = F.when(t.startswith("{"), F.from_json(t, "map<string,string>"))
    pairs = F.transform(F.map_entries(json), lambda e: F.concat_ws("=", letters_digits(e["key"]), letters_digits(F.coalesce(e["value"], F.lit("null")))))
    found = F.when(json.isNotNull() & (F.size(json) > 0), pairs)
    for sep, no in _SEPARATORS:
        head = r"^\s*[-*+•]?\s*[\"']?(" + _NAME + r")[\"']?\s*(?:=>|->|[:=])([\s\S]*)$"
        parts = F.filter(F.split(t, sep), lambda x: F.length(F.trim(x)) > 0)
        pair = F.transform(parts, lambda x: F.concat_ws("=", letters_digits(F.regexp_extract(x, head, 1)), letters_digits(F.regexp_extract(x, head, 2))))
        found = F.coalesce(found, F.when(t.rlike(rf"^{_field(no)}(?:{sep}{_field(no)}){{2,}}(?:{sep}\s*)?$"), pair))
    return F.array_sort(F.array_distinct(found))


def canonical(c: Column) -> Column:
    """Key (256-bit hash) that texts equal but for white space, case, punctuation or field order share; null for null."""
    listed = F.when(c.rlike(r"^\s*(?:\{|[-*+•]?\s*[\"']?[\p{L}_][\p{L}\p{N}_.-]*[\"']?\s*(?:=>|->|[:=]))"), field_list(c))
    return F.when(c.isNotNull(), F.sha2(F.when(listed.isNotNull(), F.concat_ws("&", listed)).otherwise(F.concat(F.lit("."), letters_digits(c))), 256))


def format_copies(df: DataFrame, key: str = "storage_key", content: str = "content", within: tuple[str, ...] = ("namespace", "type"), least_hot: int = skew.LEAST) -> DataFrame:
    """mem_key, grp_key, n_copies: one row per record that has at least one copy.

    Records are copies if the ``within`` columns are equal (null equals null) and their
    contents share a canonical key. ``grp_key`` is the group's smallest ``key``,
    ``n_copies`` its number of distinct keys. Rows with a null key or content are no
    copies of anything; rows delivered twice count once; contents without any letter or
    digit are copies of each other. Other columns are ignored.
    """
    rows = df.select(F.col(key).cast("string").alias("mem_key"), canonical(F.col(content)).alias("canon"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(within)])
    rows = rows.where(F.col("mem_key").isNotNull() & F.col("canon").isNotNull())
    named = [x for i in range(len(within)) for x in (F.col(f"_{i}").isNull(), F.col(f"_{i}"))]
    rows = rows.select("mem_key", F.unhex(F.sha2(F.to_json(F.struct(*named, "canon")), 256)).alias("g"))
    # the canonical form is computed once; 32 bytes a record and its key are what all further steps read
    rows = Scratch(df.sparkSession, "format_dups").write(rows)
    hot = skew.hot_keys(rows, "g", least_hot)
    by = Window.partitionBy("g")
    marked = skew.mark(rows, "g", hot) if hot else rows
    cold = marked.where("salts is null") if hot else rows
    cold = cold.repartition("g").dropDuplicates(["g", "mem_key"])
    out = cold.select("mem_key", F.min("mem_key").over(by).alias("grp_key"), F.count("*").over(by).alias("n_copies")).where(F.col("n_copies") > 1)
    if hot:
        warm = marked.where("salts is not null").dropDuplicates(["g", "mem_key"])
        part = warm.groupBy("g", F.pmod(F.xxhash64("mem_key"), F.col("salts").cast("long")).alias("salt")).agg(F.min("mem_key").alias("grp_key"), F.count("*").alias("n"))
        whole = part.groupBy("g").agg(F.min("grp_key").alias("grp_key"), F.sum("n").alias("n_copies"))
        joined = warm.join(F.broadcast(whole), "g").where(F.col("n_copies") > 1)  # at most skew.MAX_HOT rows
        out = out.unionByName(joined.select("mem_key", "grp_key", "n_copies"))
    return out
