"""Token sets, token estimates, similarity and detectors over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.fixed_values import SECRETS as SECRET_FORMS
from memlake.functions.text import BLANK

CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"
CJK_HANGUL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group))


def space_tokens(c: Column | str) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(matches(F.lower(_c(c)), r"\S+"))


def word_tokens(c: Column | str, first: int | None = None) -> Column:
    """Distinct lower-case runs of letters, digits and underscores, of the first characters only where ``first`` is given."""
    t = F.lower(_c(c))
    return F.array_distinct(matches(F.substring(t, 1, first) if first else t, r"[\p{L}\p{N}_]+"))


def mixed_tokens(c: Column | str) -> Column:
    """Distinct Latin words of two letters and more, and single CJK characters."""
    return F.array_distinct(F.concat(matches(F.lower(_c(c)), r"[a-z]{2,}"), matches(c, CJK)))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|, 0 for two empty sets; null if either is null."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def has_cjk(c: Column | str) -> Column:
    return _c(c).rlike(CJK)


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(c), F.lit(pattern))


def token_estimate(c: Column | str) -> Column:
    """CJK characters plus a quarter of the others (whole), at least 1."""
    n = count_matches(c, CJK)
    return F.greatest(F.lit(1), (n + F.floor((F.length(_c(c)) - n) / 4)).cast("int"))


def token_estimate_rules(c: Column | str) -> Column:
    """Half of the CJK and Hangul characters plus a quarter of the others, rounded down, at least 1."""
    n = count_matches(c, CJK_HANGUL)
    return F.greatest(F.lit(1), F.floor(n / 2.0 + (F.length(_c(c)) - n) / 4.0).cast("int"))


def script_language(c: Column | str) -> Column:
    """ja for kana, zh for Han, else en."""
    return F.when(_c(c).rlike(r"[\x{3040}-\x{30ff}]"), "ja").when(_c(c).rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"), "zh").otherwise("en")


def event_dates(c: Column | str) -> Column:
    return F.array_distinct(matches(c, r"\d{4}-\d{2}-\d{2}"))


def temporal_bonus(c: Column | str, t: Column | str) -> Column:
    """0.4 for any date, 0.15 more for two, 0.1 more for facts and decisions with one."""
    n = count_matches(c, r"\d{4}-\d{2}-\d{2}")
    return F.when(n > 0, F.lit(0.4) + F.when(n >= 2, 0.15).otherwise(0.0) + F.when(_c(t).isin("fact_declaration", "decision"), 0.1).otherwise(0.0)).otherwise(0.0)


def negated(c: Column | str) -> Column:
    return F.lower(_c(c)).rlike(r"(^|[^a-z])(not|never|don't|no longer|avoid|stop)($|[^a-z])")


SECRETS = tuple(p for _, p in SECRET_FORMS)


def has_secret(c: Column | str) -> Column:
    out = F.lit(False)
    for p in SECRETS:
        out = out | _c(c).rlike(p)
    return out


def secret_kinds(c: Column | str) -> Column:
    """Names of the forms of credentials found, in their order."""
    return F.array_compact(F.array(*[F.when(_c(c).rlike(p), F.lit(k)) for k, p in SECRET_FORMS]))


def redact_secrets(c: Column | str) -> Column:
    """The text with [REDACTED] in place of each credential; places that forms share or overlap are replaced once, the longest first."""
    found = F.flatten(F.array(*[matches(c, p) for p in SECRETS]))
    longest = F.array_sort(F.array_distinct(found), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(longest, _c(c), lambda t, x: F.replace(t, x, F.lit("[REDACTED]")))


#: Categories of unwanted input and the patterns that show them.
UNSAFE = {
    "control": r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}\x{202a}-\x{202e}\x{2066}-\x{2069}]",
    "sql": r"(?i)(\bunion\s+select\b|\bdrop\s+table\b|\bor\s+1\s*=\s*1\b|;\s*--)",
    "script": r"(?i)(<script\b|javascript:|\bonerror\s*=)",
    "traversal": r"(\.\./|\.\.\\)",
    "command": r"(?i)([;&|]\s*(rm|curl|wget|bash)\b|\$\([^)]*\))",
    "injection": r"(?i)\b(ignore (all )?(previous|prior) instructions|system prompt)\b",
}


def unsafe_categories(c: Column | str, most: int = 10_000) -> Column:
    """Sorted names of the ``UNSAFE`` categories found, and 'length' beyond ``most`` characters."""
    found = [F.when(_c(c).rlike(p), F.lit(k)) for k, p in UNSAFE.items()] + [F.when(F.length(_c(c)) > most, F.lit("length"))]
    return F.array_sort(F.array_compact(F.array(*found)))


def summary(c: Column | str, level: int) -> Column:
    """1: up to eight distinct words of four letters and more; 2: the first sentence, at most 120 characters; 3: all."""
    if level == 1:
        return F.array_join(F.slice(F.array_distinct(matches(F.lower(_c(c)), r"[a-z]{4,}")), 1, 8), ", ")
    if level == 2:
        return F.substring(F.regexp_extract(_c(c), r"^([^.!?\n]*[.!?]?)", 1), 1, 120)
    return _c(c)


def keywords(c: Column | str, most: int = 50) -> Column:
    """English words of three letters and more, and every two to four neighbouring CJK characters; at most ``most``."""
    words = matches(F.lower(_c(c)), r"[a-z]{3,}")
    runs = matches(c, CJK + "{2,}")
    at = lambda r, i: F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length(r) - i + 1)), lambda n: F.substr(r, i, n))
    grams = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: at(r, i)))))
    return F.slice(F.array_distinct(F.concat(words, grams)), 1, most)


def confirmation(c: Column | str) -> Column:
    return F.lower(F.trim(_c(c))).rlike(r"^(yes|yeah|yep|ok|okay|sure|agreed|confirmed|sounds good|do it|好的|对|はい|네)\b?[ .!。]*$")


def content_hash(*parts: Column | str) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by ':'."""
    return F.substring(F.sha2(F.concat_ws(":", *[_c(p) for p in parts]), 256), 1, 16)


def normal_hash(c: Column | str, first: int | None = None) -> Column:
    t = F.trim(F.regexp_replace(F.lower(_c(c)), BLANK + "+", " "))
    return F.substring(F.sha2(F.substring(t, 1, first) if first else t, 256), 1, 16)


def json_set(doc: Column | str, key: str, value: Column) -> Column:
    """The JSON object with ``key`` set; null counts as an empty object."""
    m = F.from_json(F.coalesce(_c(doc), F.lit("{}")), "map<string,string>")
    rest = F.map_filter(m, lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def extracted(c: Column | str, mark: str, what: str) -> Column:
    """What follows or precedes the first ``mark``, or surrounds it (50 characters before, 100 after); null without one. Marks of a sentence's end are cut off what follows or precedes."""
    t = _c(c)
    at = F.instr(t, F.lit(mark))
    end = lambda x: F.regexp_replace(F.trim(x), r"[.!?]+$", "")
    out = {
        "following": end(F.substr(t, at + len(mark), F.length(t))),
        "preceding": end(F.substr(t, F.lit(1), at - 1)),
        "surrounding": F.trim(F.substr(t, F.greatest(at - 50, F.lit(1)), at - F.greatest(at - 50, F.lit(1)) + len(mark) + 100)),
    }[what]
    return F.when(at > 0, out)


def parse_time(c: Column | str) -> Column:
    return F.try_to_timestamp(_c(c))
