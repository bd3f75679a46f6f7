"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import bpe, chunking, components, format_dups, languages, near_dups, packing, pii
from memlake.sources.tables import table


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch with its confidence and place."""
    return languages.memory_languages(table(spark, d, "en"), table(spark, d, "memories")).drop("kept").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.language_cases(languages.memory_languages(table(spark, d, "en"), table(spark, d, "memories")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_forms(table(spark, d, "entity_aliases"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.near_dup_pairs(table(spark, d, "memories"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives with their similarity."""
    return near_dups.near_duplicates(table(spark, d, "memories"))[0].select("text_field", "rep_a", "rep_b", F.round("similarity", 9).alias("similarity"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class of equal texts, its group of linked classes and its number of links."""
    return near_dups.near_groups(table(spark, d, "memories"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(table(spark, d, "memories"), table(spark, d, "name_parts")).select("mem_key", "text_field", "kind", "pii").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "memories")
    return pii.redact(memories, pii.find_items(memories, table(spark, d, "name_parts")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dups.format_copies(table(spark, d, "memories"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), CAPACITY)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p9_packed(spark, d), CAPACITY)


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(table(spark, d, "documents"), LIMIT, OVERLAP)


#: Production parameters: tokens per container, tokens per piece, tokens that neighbours share.
CAPACITY, LIMIT, OVERLAP = 2048, 512, 64


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_labels, p3_found, p5_found, p5_classes, p5_groups, p6_found, p6_redacted, p7_found, p8_ids, p9_packed, p9_report, p10_pieces)}


P3_SQL = r"""
with recursive e as (
  select namespace n, nullif(regexp_replace(lower(canonical_form), '^\s+|\s+$', '', 'g'), '') x, nullif(regexp_replace(lower(alias_form), '^\s+|\s+$', '', 'g'), '') y from entity_aliases),
f as (select distinct n, x form from e where x is not null union select distinct n, y from e where y is not null),
s as (select n, x, y from e where x is not null and y is not null union select n, y, x from e where x is not null and y is not null),
r(n, form, seen) using key (n, form) as (
  select n, form, form from f
  union
  select s.n, s.y, min(r.seen) from r join s on s.n = r.n and s.x = r.form join recurring.r c on c.n = s.n and c.form = s.y where r.seen < c.seen group by s.n, s.y)
select n as namespace, form, seen grp from r
"""


_P5_TEXTS = r"""
m as (select distinct storage_key k, namespace ns, content, raw_text from memories where storage_key is not null),
t as (select k, ns, 'content' f, content x from m union all select k, ns, 'raw_text', raw_text from m),
n as (select k, ns, f, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) s from t where x is not null)"""
_P5_GRAMS = "replace(s, ' ', '') tight, list_distinct(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) g"
_P5_LINK = """a.f = b.f and a.ns is not distinct from b.ns and a.k < b.k and a.tight <> b.tight
 and least(len(a.g), len(b.g)) >= 0.7 * greatest(len(a.g), len(b.g))
where len(list_intersect(a.g, b.g)) >= 0.7 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))"""
P5_SQL = f"""
with {_P5_TEXTS}, g as (select k, ns, f, {_P5_GRAMS} from n where length(s) >= 4)
select a.f text_field, a.k key_a, b.k key_b from g a join g b on {_P5_LINK}
"""
#: Classes of equal texts, and the links between them.
_P5_CLASSES = f"""{_P5_TEXTS}, c as (select min(k) k, ns, f, s from n where s <> '' group by ns, f, s), g as (select k, ns, f, {_P5_GRAMS} from c where length(s) >= 4),
l as (select a.f f, a.k x, b.k y, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::double sim from g a join g b on {_P5_LINK})"""
P5_CLASSES_SQL = f"with {_P5_CLASSES} select f text_field, x rep_a, y rep_b, round(sim, 9) similarity from l"
P5_GROUPS_SQL = f"""
with recursive {_P5_CLASSES}, e as (select f, x, y from l union all select f, y, x from l),
r(f, k, seen) using key (f, k) as (
  select f, k, k from c
  union
  select e.f, e.y, min(r.seen) from r join e on e.f = r.f and e.x = r.k join recurring.r q on q.f = e.f and q.k = e.y where r.seen < q.seen group by e.f, e.y),
d as (select f, x k, count(*) n from e group by f, x)
select n.f text_field, n.k mem_key, c.k rep, r.seen grp, coalesce(d.n, 0)::bigint n_links
from n join c on c.f = n.f and c.ns is not distinct from n.ns and c.s = n.s join r on r.f = c.f and r.k = c.k left join d on d.f = c.f and d.k = c.k
"""


def _p7_sql() -> str:
    ld = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    name = r"[\p{L}_][\p{L}\p{N}_.-]*"
    op = "(?:=>|->|[:=])"
    head = rf"^\s*[-*+•]?\s*[\"'']?({name})[\"'']?\s*{op}([\s\S]*)$"
    cases = ""
    for sep, no in ((r"\n+", r"\n"), (r"\|", r"|\n"), (";", r";\n"), (",", r",\n"), ("&", r"&\s"), (r"\s+", r"\s")):
        field = rf"\s*[-*+•]?\s*[\"'']?{name}[\"'']?\s*{op}\s*[^{no}]*"
        pair = f"list_transform(list_filter(regexp_split_to_array(t, '{sep}'), lambda x: length(trim(x)) > 0), lambda x: {ld(f'regexp_extract(x, {chr(39)}{head}{chr(39)}, 1)')} || '=' || {ld(f'regexp_extract(x, {chr(39)}{head}{chr(39)}, 2)')})"
        cases += f" when regexp_matches(t, '^{field}(?:{sep}{field}){{2,}}(?:{sep}\\s*)?$') then {pair}"
    json = f"list_transform(json_keys(t), lambda q: {ld('q')} || '=' || {ld('coalesce(json_extract_string(t, ' + chr(39) + '$.' + chr(34) + chr(39) + ' || q || ' + chr(39) + chr(34) + chr(39) + '), ' + chr(39) + 'null' + chr(39) + ')')})"
    return f"""
with m as (select distinct storage_key k, namespace ns, type ty, content c, trim(replace(content, chr(13) || chr(10), chr(10))) t from memories where storage_key is not null and content is not null),
x as (select k, ns, ty, case when starts_with(t, '{{') and json_valid(t) then {json} {cases} end l, {ld('c')} s from m),
g as (select k, ns, ty, case when l is not null and len(l) > 0 then array_to_string(list_sort(list_distinct(l)), '&') else '.' || s end canon from x)
select k mem_key, grp_key, n_copies from (select k, min(k) over w grp_key, count(*) over w n_copies from g window w as (partition by ns, ty, canon)) where n_copies > 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p5_found": P5_SQL, "p5_classes": P5_CLASSES_SQL, "p5_groups": P5_GROUPS_SQL, "p7_found": _p7_sql()}
