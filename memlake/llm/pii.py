"""Personal information in free text by bootstrapped contextual extraction (problem 6).

1. Candidates: spans whose form could be an item (numbers, mail addresses, capitalised
   or known name parts, street and house number) come out of one pass over the whole
   texts, each with its lexical patterns: the words on its left and right, the mask of
   its letters and digits, its own parts, the word for its street, the end of its host.
2. Seeds: of the candidates of unmistakable form, and of names whose parts are all in
   ``name_parts``, one in ``SEEDS`` by a hash of the surface. All others have to be discovered.
3. The graph of patterns and instances is scored in Spark: a pattern is as good as the
   share of its instances that are believed, those that are not known counting in part;
   an instance is as good as its patterns together (noisy or); seeds stay certain. A few
   rounds let good patterns vouch for unseen identifiers, and those for further patterns.
4. Candidates above a threshold are items. Overlaps go to the better, then longer one.

For scripts without blanks the left and right contexts of known names are learned
first; they delimit names of which neither part is known.

Patterns and instances travel as 64-bit hashes. Instances are distinct (form, surface,
patterns) with their counts, so a text repeated a million times is one instance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators import skew
from memlake.sources.tables import Scratch

#: Kinds of items by the form of a candidate; only numbers may be of two.
KINDS = {"email": ("email",), "number": ("phone", "id_number"), "address": ("address",), "name": ("name",)}
ROUNDS = 4
BELIEVED = 0.5
#: One in so many candidates of unmistakable form is a seed.
SEEDS = 3
#: What an instance that is not known counts against its patterns; parts of names must be names nearly always.
UNKNOWN, UNKNOWN_PART = 0.2, 1.0

# Words for streets, and short forms that end in a dot.
STREET = (
    r"Street|St\.|Road|Rd\.|Lane|Ln\.|Avenue|Ave\.|Close|Terrace|Drive|Dr\.|Court|Row|Way|Boulevard|Blvd\.|Crescent"
    r"|[Rr]ue|[Aa]venue|[Ii]mpasse|[Cc]hemin|[Bb]oulevard|[Aa]llée|[Qq]uai|[Cc]alle|[Aa]venida|[Pp]aseo|[Cc]amino|[Rr]ua|[Tt]ravessa|[Aa]lameda|[Ll]argo"
)
# Forms of numbers that identify persons, and of telephone numbers.
ID_FORMS = (
    r"\d{3}[- ]\d{2}[- ]\d{4}",
    r"\d{17}[\dXx]",
    r"\d{6}-\d{7}",
    r"\d \d\d \d\d \d\d \d{3} \d{3} \d\d",
    r"\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4}",
    r"\d\d \d{3} \d{3} \d{3}",
    r"\d\d ?\d\d \d{6}",
    r"\d{3}\.\d{3}\.\d{3}-\d\d",
    r"[A-Z]\d{7}",
    r"[A-Z] \d{3} \d{4}",
)
PHONE_FORMS = (
    r"\+\d[\d ()./-]{7,}\d",
    r"00\d\d [\d ()./-]{7,}\d",
    r"\(\d{2,4}\)[ .-]{0,2}\d[\d .-]{5,}\d",
    r"(?:1[-. ])?[2-9]\d\d[-. ]\d{3}[-. ]\d{4}",
    r"0\d(?:[ .-]\d\d){4}",
    r"0\d{1,2}[)-]\d{3,4}-?\d{4}",
)

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s@\s|\s?[(\[]at[)\]]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9-]+)*(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z]{2,}(?![A-Za-z0-9@])", re.I)
_NUMBER = re.compile(r"(?<![A-Za-z0-9_.@/+-])(?:[A-Z]{1,2}[ -]?(?=\d))?\+?\(?\d(?:\d|[ ./()-]{1,3}(?=[\d(]))*\d(?:[Xx](?![A-Za-z]))?(?![A-Za-z_/@]|\.\d)")
_DATE = re.compile(r"(?<!\d)(?:19|20)\d\d[-/ .]\d\d?[-/ .]\d\d?(?!\d)")
_ID = re.compile("|".join(f"(?:{x})" for x in ID_FORMS))
_PHONE = re.compile("|".join(f"(?:{x})" for x in PHONE_FORMS))
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_CAP = rf"(?:(?:[dD]['’]|[Oo]['’])?[{_UP}][{_LOW}]+(?:['’-][{_UP}]?[{_LOW}]+)*|(?:[DO]['’])?[{_UP}]{{3,}}(?:['’-][{_UP}]{{2,}})*)"
_PAIR = re.compile(rf"(?<![\w'’.-])(?=((?:{_CAP}|[{_UP}]\.)(?: [{_UP}]\.)? {_CAP}(?![\w@])|{_CAP}, (?:{_CAP}(?![\w@])|[{_UP}]\.)))")
_LINK = r"(?:de la|de los|de las|del|de|des|du|da|das|do|dos|la|le|les|l['’]|d['’]|of|the)"
_NO = r"(?:n\.?[º°] ?|[Nn]o\. ?|Nr\. ?|№ ?|д\. ?)?"
_FIRST = re.compile(rf"(?<![\w.,:/-])\d{{1,4}}[A-Za-z]?(?: bis| ter)?,? (?:(?:St\.|{STREET}|{_LINK}|{_CAP}) ){{0,4}}(?:{STREET}|{_CAP}(?:['’]s)?(?: (?:{STREET}))?)(?!\w)")
_THEN = re.compile(rf"(?<![\w.-])(?:(?:ул|пер|пр|наб|пл|бул)\. ?|(?:{STREET}) )?(?:(?:{_CAP}|{_LINK}) ){{0,4}}?(?:{_CAP}|переулок|улица|проспект|шоссе|бульвар|площадь),? {_NO}\d{{1,4}}(?: ?[a-z](?!\w))?(?![\w:/]|[.,-]\d)")
#: What every match of ``_THEN`` ends with; cheap to look for first.
_THEN_END = re.compile(rf"(?:[{_UP}][\w'’-]*|переулок|улица|проспект|шоссе|бульвар|площадь),? {_NO}\d{{1,4}}(?: ?[a-z](?!\w))?(?![\w:/]|[.,-]\d)")
_STREETISH = re.compile(
    rf"\b(?:{STREET})(?!\w)|(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm)(?= \d)|\b(?:ул|пер|пр|наб|пл)\.|переул|улиц|проспект|шоссе|бульвар|площад"
)
_NOT_STREET = "了在到于从的和与是我们搬住今"
_HAN = "一-鿿㐀-䶿々ヶ"
_EAST = re.compile(
    rf"(?:(?![{_NOT_STREET}])[{_HAN}]){{2,5}}?(?:大道|路|街|巷|弄|胡同)\d{{1,4}}号?"
    rf"|[{_HAN}]{{2,6}}\d{{1,3}}(?:丁目\d{{1,3}}番(?:地)?(?:\d{{1,3}}号)?|-\d{{1,3}}-\d{{1,3}}|番地?\d{{0,3}}号?)"
    r"|(?<![가-힣])[가-힣]{1,8}(?:대로|로|길) ?\d{1,4}(?:-\d{1,3})?"
)
_EAST_STREET = re.compile("大道|胡同|路|街|巷|弄|丁目|番|号|대로|로|길")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_CJK_PART = rf"[{_HAN}가-힣ぁ-ヿ]"
_DIGIT = re.compile(r"\d")
_STARTS = re.compile(r"[.!?…。！？\n]\s*$")


def _left(t: str, at: int) -> str:
    """The two words before ``at`` (four characters where words are not set apart), lower case, digits masked; '^' where a sentence starts."""
    s = t[max(0, at - 30) : at]
    if not s or _STARTS.search(s):
        return "^"  # says nothing, see ``_WEIGHT``
    s = _DIGIT.sub("0", s.lower())
    tail = s.rstrip()
    if tail and _CJK.match(tail[-1]):
        return s[-5:].lstrip() if len(tail) == len(s) else tail[-4:] + " "
    words = s.split(" ")
    return " ".join(words[-3:]) if s.endswith(" ") else " ".join(words[-2:])


def _right(t: str, at: int) -> str:
    s = _DIGIT.sub("0", t[at : at + 30].lower())
    if not s.strip() or s[0] == "\n":
        return "$"
    head = s.lstrip()
    if _CJK.match(head[0]):
        return (" " if head is not s and len(head) < len(s) else "") + head[:3]
    if head[0] in ".!?;)":
        return "$"
    return " ".join(s.split(" ")[:3]) if s.startswith(" ") else " ".join(s.split(" ")[:2])


@lru_cache(4096)
def _between(le: str, ri: str) -> re.Pattern:
    return re.compile(re.escape(le) + rf"({_CJK_PART}{{1,5}}[ 　]?{_CJK_PART}{{1,4}}?)" + re.escape(ri))


class Finder:
    """Candidates of a text: (shape, start, end, kind if its form is unmistakable or '', patterns)."""

    def __init__(self, parts: list[tuple[str, str]], delimiters: list[tuple[str, str]] = ()):
        given = {p for p, k in parts if k == "given"}
        family = {p for p, k in parts if k == "family"}
        self.given, self.family = {p.lower() for p in given}, {p.lower() for p in family}
        east = lambda names: "|".join(sorted(map(re.escape, (p for p in names if _CJK.match(p))), key=lambda x: (-len(x), x)))
        g, f = east(given), east(family)
        self.east_seed = re.compile(f"(?:{f})[ 　]?(?:{g})") if g and f else None
        self.delimited = [(le, _between(le, ri)) for le, ri in delimiters]

    def _number(self, t: str):
        for m in _NUMBER.finditer(t):
            s, e = m.span()
            x = m.group()
            digits = sum(map(str.isdigit, x))
            if digits < 7 or digits > 20 or _DATE.search(x):
                continue
            seed = "phone" if _PHONE.fullmatch(x) else "id_number" if _ID.fullmatch(x) else ""
            yield "number", s, e, seed, ["L" + _left(t, s), "R" + _right(t, e), "S" + _DIGIT.sub("0", x)]

    def _names(self, t: str):
        for m in _PAIR.finditer(t):
            s = m.start(1)
            x = m.group(1)
            e = s + len(x)
            a, b = x.split(", ") if ", " in x else (x.split(" ")[0], x.split(" ")[-1])
            first, last = (b, a) if ", " in x else (a, b)
            if ", " in x and _left(t, s) == "^":
                continue  # a greeting or listing, not a name turned round
            known = (first.lower() in self.given or (len(first) == 2 and first[1] == ".")) and last.lower() in self.family
            yield "name", s, e, "name" if known else "", ["L" + _left(t, s), "R" + _right(t, e), "A" + first.lower() * (first[1:] != "."), "B" + last.lower()]

    def _east_names(self, t: str):
        if self.east_seed:
            for m in self.east_seed.finditer(t):
                s, e = m.span()
                yield "name", s, e, "name", ["L" + _left(t, s), "R" + _right(t, e), "A" + m.group()[0], "B" + m.group()[1:].strip()]
        for le, rx in self.delimited:
            if le in t:
                for m in rx.finditer(t):
                    s, e = m.span(1)
                    yield "name", s, e, "", ["L" + _left(t, s), "R" + _right(t, e), "A" + t[s], "B" + t[s + 1 : e].strip()]

    def _addresses(self, t: str):
        for rx in (_FIRST, _THEN) if _THEN_END.search(t) else (_FIRST,):
            for m in rx.finditer(t):
                x = m.group()
                street = _STREETISH.search(x)
                first = x.split(" ")[0]
                if rx is _THEN and not street and (first[0].islower() or " " in x.strip() and x.count(" ") > 2):
                    continue
                yield "address", m.start(), m.end(), "address" if street else "", ["L" + _left(t, m.start()), "R" + _right(t, m.end()), "T" + (street.group().lower() if street else "")]
        if _CJK.search(t):
            for m in _EAST.finditer(t):
                yield "address", m.start(), m.end(), "address", ["L" + _left(t, m.start()), "R" + _right(t, m.end()), "T" + (x.group() if (x := _EAST_STREET.search(m.group())) else "-")]

    def _mails(self, t: str):
        for m in _EMAIL.finditer(t):
            s, e = m.span()
            mask = _DIGITS.sub("0", _LETTERS.sub("a", m.group()))
            plain = "@" in m.group() and " " not in m.group()
            yield "email", s, e, "email" if plain else "", ["L" + _left(t, s), "R" + _right(t, e), "S" + mask, "T" + _LETTERS.findall(m.group())[-1].lower()]

    def __call__(self, t: str) -> list[tuple[str, int, int, str, list[str]]]:
        out = []
        low = t if "@" in t else t.lower()
        if "@" in low or "(at" in low or "[at" in low:
            out += self._mails(t)
        mails = [(s, e) for _, s, e, _, _ in out]
        if _DIGIT.search(t):
            out += [x for x in (*self._number(t), *self._addresses(t))]
        out += self._names(t)
        if _CJK.search(t):
            out += self._east_names(t)
        return [x for x in out if x[0] == "email" or not any(s < x[2] and x[1] < e for s, e in mails)] if mails else out


#: What a pattern may add to an instance by its class: what follows an item never suffices alone.
_WEIGHT = {"L": 0.9, "R": 0.45, "S": 0.9, "A": 0.9, "B": 0.9, "T": 0.6}
#: Contexts that say nothing: the start and the end of a sentence.
_EMPTY = ("L^", "R$", "A", "B", "S", "L", "R", "T")


OCCURRENCE = "mem_key string, text_field string, shape string, s int, e int, surface string, seed string, patterns array<string>, id long"


#: Patterns up to which their scores are sent to all tasks, and name parts that may be given.
MOST_SENT, MOST_PARTS = 100_000, 1_000_000
#: Contexts of names up to which their list is sent to all tasks; longer ones are joined.
MOST_CONTEXTS = 1000
_CJK_ONE = re.compile(_CJK_PART)
_SPAN = re.compile(rf"{_CJK_PART}{{1,5}}[ 　]?{_CJK_PART}{{1,4}}")


def _contexts(df: DataFrame, fields: tuple[str, ...], parts: list[tuple[str, str]]) -> DataFrame | None:
    """(le, ri): contexts of seed names in scripts without blanks that occur at least twice and with two different names."""
    finder = Finder(parts)
    if finder.east_seed is None:
        return None
    known = "(?:" + finder.east_seed.pattern + ")"
    texts = df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("t")).where(F.col("t").rlike(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                for m in finder.east_seed.finditer(t):
                    le, ri = t[max(0, m.start() - 3) : m.start()], t[m.end() : m.end() + 2]
                    le, ri = le[re.search(r"[^\s。！？.!?\n]*[ 　]?$", le).start() :], ri[: re.match(r"\s?\S{0,2}", ri).end()]
                    if len(le.strip()) >= 2 and len(ri.strip()) >= 1:
                        rows.append((le, ri, m.group()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["le", "ri", "x"])

    seen = texts.mapInArrow(run, "le string, ri string, x string").groupBy("le", "ri").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("x").alias("y"))
    return seen.where("n >= 2 and x <> y").select("le", "ri")


def _with_contexts(df: DataFrame, contexts: DataFrame, key: str, fields: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """key, fields, contexts: each row with the contexts that enclose some span of its texts, whatever their number."""
    rows = scratch.write(df.where(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col(key).cast("string"), *fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                out = []
                for i, t in enumerate(zip(*(batch.column(j + 1).slice(at, 256).to_pylist() for j in range(len(fields))))):
                    # a context is at most three characters before a span and two behind it, both not blank alone
                    out += [(ids[at + i], le, ri) for le, ri in {x for f in t if f and _CJK.search(f) for x in _around(f)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *[pa.array([r[j] for r in out], pa.string()) for j in (1, 2)]], ["id", "le", "ri"])

    near = rows.select("id", *fields).mapInArrow(run, "id long, le string, ri string")
    mine = near.join(contexts, ["le", "ri"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("le", "ri"))).alias("contexts"))
    return rows.join(mine, "id", "left").drop("id")


def _around(t: str) -> Iterator[tuple[str, str]]:
    """(left, right) of every span of ``t`` that may be a name."""
    for s in range(2, len(t)):
        if not _CJK_ONE.match(t[s]):
            continue
        les = [le for n in (2, 3) if s >= n and len((le := t[s - n : s]).strip()) >= 2]
        for e in range(s + 2, min(s + 10, len(t) - 1) + 1) if les else ():
            if _SPAN.fullmatch(t, s, e):
                for n in (1, 2):
                    if e + n <= len(t) and (ri := t[e : e + n]).strip():
                        yield from ((le, ri) for le in les)


def occurrences(df: DataFrame, parts: list[tuple[str, str]], delimiters: list[tuple[str, str]], key: str, fields: tuple[str, ...]) -> DataFrame:
    """All candidates of the texts (``OCCURRENCE``); a column ``contexts`` holds a row's own delimiters."""
    own = ["contexts"] if "contexts" in df.columns else []
    names = ["mem_key", "text_field", "shape", "s", "e", "surface", "seed", "patterns"]
    seeds = SEEDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(parts, delimiters)
        for batch in batches:
            rows = []
            keys = batch.column(0).to_pylist()
            around = [[(x["le"], _between(x["le"], x["ri"])) for x in xs or ()] for xs in batch.column(len(fields) + 1).to_pylist()] if own else None
            for i, f in enumerate(fields):
                for j, (k, t) in enumerate(zip(keys, batch.column(i + 1).to_pylist())):
                    if t:
                        if around is not None:
                            find.delimited = around[j]
                        rows += [(k, f, shape, s, e, x, kind if kind and int.from_bytes(md5(x.encode("utf-8", "surrogatepass")).digest()[:4], "little") % seeds == 0 else "", ps) for shape, s, e, kind, ps in find(t) if (x := t[s:e])]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(8)], names)

    found = df.select(F.col(key).cast("string"), *fields, *own).where(F.col(key).isNotNull()).mapInArrow(run, OCCURRENCE.rsplit(",", 1)[0])
    return found.withColumn("id", F.xxhash64("shape", "surface", "patterns"))


def _scored(edges: DataFrame, score: DataFrame | None, hot: skew.HotKeys | None) -> DataFrame:
    """id, n, seed, ps, s1, s2: instances with how well their patterns vouch for the first and the second kind of their form."""
    if score is None:
        rows = edges.withColumn("k1", F.lit(0.0)).withColumn("k2", F.lit(0.0))
    elif score.count() <= MOST_SENT:  # the list of patterns is sent to all tasks only while it is short
        rows = edges.join(F.broadcast(score), "p", "left")
    else:
        rows = skew.salted_join(edges, score.hint("shuffle_hash"), "p", F.col("id"), hot, "left")
    vouch = lambda k: 1 - F.exp(F.sum(F.log(1 - F.col("w") * F.coalesce(F.col(k), F.lit(0.0)))))
    return rows.groupBy("id").agg(F.first("n").alias("n"), F.first("seed").alias("seed"), F.collect_list(F.struct("p", "part")).alias("ps"), vouch("k1").alias("s1"), vouch("k2").alias("s2"))


def _label(rows: DataFrame) -> DataFrame:
    """Adds ``is``: 1 or 2 for the kind that an instance is believed to be, 0 if none."""
    better = F.when((F.col("s1") >= BELIEVED) & (F.col("s1") >= F.col("s2")), 1).when(F.col("s2") >= BELIEVED, 2).otherwise(0)
    return rows.withColumn("is", F.when(F.col("seed") > 0, F.col("seed")).otherwise(better))


def believe(occ: DataFrame, scratch: Scratch, rounds: int = ROUNDS, least_hot: int = skew.LEAST) -> DataFrame:
    """id, is, score: the instances that are believed after ``rounds`` rounds.

    Works on distinct instances with their counts. An instance counts for its patterns once
    it is believed, not by degrees, so that weak contexts cannot raise each other; patterns
    that occurred once vouch for nothing.
    """
    second = F.max((F.col("seed") == "id_number").cast("int") * 2 + (F.col("seed").isin("email", "phone", "address", "name")).cast("int"))
    nodes = occ.groupBy("id").agg(F.count("*").alias("n"), second.alias("seed"), F.first("shape").alias("shape"), F.first("patterns").alias("patterns"))
    kept = F.filter("patterns", lambda p: ~p.isin(*_EMPTY))
    edges = nodes.select("id", "n", "seed", "shape", F.explode_outer(F.when(F.size(kept) > 0, kept)).alias("x"))
    weight = F.lit(0.0)
    for c, w in _WEIGHT.items():
        weight = F.when(F.substring("x", 1, 1) == c, w).otherwise(weight)
    edges = scratch.write(edges.select("id", "n", "seed", F.coalesce(F.xxhash64("shape", "x"), F.lit(0)).alias("p"), weight.alias("w"), F.substring("x", 1, 1).isin("A", "B").alias("part")))
    hot = skew.hot_keys(edges, "p", least_hot)
    score = None
    for _ in range(rounds):
        inst = _label(_scored(edges, score, hot)).select("n", "is", F.explode("ps").alias("x")).select("n", "is", "x.p", "x.part")
        n_of = lambda k: F.sum(F.when(F.col("is") == k, F.col("n")).otherwise(0))
        pat = inst.groupBy("p", "part").agg(n_of(1).alias("n1"), n_of(2).alias("n2"), n_of(0).alias("n0")).where("n0 + n1 + n2 > 1 and n1 + n2 > 0")
        room = F.col("n1") + F.col("n2") + F.when(F.col("part"), UNKNOWN_PART).otherwise(UNKNOWN) * F.col("n0") + 1
        last, score = score, scratch.write(pat.select("p", (F.col("n1") / room).alias("k1"), (F.col("n2") / room).alias("k2")))
        if last is not None:
            scratch.drop(last)
    sure = _label(_scored(edges, score, hot)).where("is > 0")
    return scratch.write(sure.select("id", "is", F.when(F.col("seed") > 0, 1.0).otherwise(F.greatest("s1", "s2")).alias("score")))


def find_items(df: DataFrame, name_parts: DataFrame, key: str = "storage_key", fields: tuple[str, ...] = ("content", "raw_text", "original_message"), rounds: int = ROUNDS, least_hot: int = skew.LEAST, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """mem_key, text_field, kind, s, e, pii, score, seed: the items of each text in the order of their place, without overlaps.

    ``seed`` tells the few that were given from those that patterns discovered. Null keys,
    null and empty texts have no items. Rows delivered twice give their items once.
    ``name_parts`` (name_part, kind) is a reference list that does not grow with the data;
    more than ``MOST_PARTS`` of them are an error, as the list is sent to all tasks.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pii")
    given = name_parts.select("name_part", "kind").where("name_part <> '' and kind is not null").distinct().limit(MOST_PARTS + 1).collect()
    if len(given) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    parts = sorted((r[0], r[1]) for r in given)
    contexts = _contexts(df, fields, parts)
    few = []
    if contexts is not None:
        contexts = scratch.write(contexts)
        few = sorted((r[0], r[1]) for r in contexts.limit(most_contexts + 1).collect())
    many = len(few) > most_contexts
    occ = scratch.write(occurrences(_with_contexts(df, contexts, key, fields, scratch) if many else df, parts, [] if many else few, key, fields))
    found = believe(occ, scratch, rounds, least_hot)
    hot = skew.hot_keys(occ, "id", least_hot)
    by = skew.salted_join(occ.drop("patterns"), found, "id", F.xxhash64("mem_key", "s"), hot)
    kind = F.lit(None).cast("string")
    for shape, kinds in KINDS.items():
        for i, k in enumerate(kinds, 1):
            kind = F.when((F.col("shape") == shape) & (F.col("is") == i), k).otherwise(kind)
    by = by.select("mem_key", "text_field", kind.alias("kind"), "s", "e", F.col("surface").alias("pii"), "score", (F.col("seed") != "").alias("seed"))
    # overlaps within one text: bounded by the text
    every = by.distinct().groupBy("mem_key", "text_field").agg(F.collect_list(F.struct("score", "s", "e", "kind", "pii", "seed")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, f, xs in zip(*(c.to_pylist() for c in batch.columns)):
                free: list[dict] = []
                for x in sorted(xs, key=lambda x: (-round(x["score"], 2), x["s"] - x["e"], x["s"], x["kind"])):
                    if all(x["e"] <= y["s"] or y["e"] <= x["s"] for y in free):
                        free.append(x)
                rows += [(k, f, x["kind"], x["s"], x["e"], x["pii"], x["score"], x["seed"]) for x in sorted(free, key=lambda x: x["s"])]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(8)], ["mem_key", "text_field", "kind", "s", "e", "pii", "score", "seed"])

    return every.mapInArrow(run, "mem_key string, text_field string, kind string, s int, e int, pii string, score double, seed boolean")


def redact(df: DataFrame, items: DataFrame, key: str = "storage_key", fields: tuple[str, ...] = ("content", "raw_text", "original_message")) -> DataFrame:
    """``key`` and the fields with ``[KIND]`` in place of every item and all else unchanged; one row per key.

    Null texts stay null; rows with a null key are left out.
    """
    spans = items.groupBy("mem_key").agg(F.collect_list(F.struct("text_field", "s", "e", "kind")).alias("spans"))
    rows = df.select(F.col(key).cast("string").alias("mem_key"), *fields).where(F.col(key).isNotNull()).dropDuplicates(["mem_key"]).join(spans, "mem_key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for i, spans in enumerate(cols[-1]):
                for x in sorted(spans or (), key=lambda x: -x["s"]):
                    j = 1 + fields.index(x["text_field"])
                    t = cols[j][i]
                    cols[j][i] = f"{t[: x['s']]}[{x['kind'].upper()}]{t[x['e'] :]}"
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:-1]], [key, *fields])

    return rows.mapInArrow(run, ", ".join(f"`{c}` string" for c in (key, *fields)))
