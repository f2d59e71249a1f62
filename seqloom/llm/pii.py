"""Personal data, by patterns and by information-theoretic sanitisation, in DataFrame functions only.

Patterns find the protected entities: e-mail addresses, IP addresses, payment cards and phone numbers. The corpus then tells which other terms give
an entity away. A term t discloses an entity c by PMI(c; t) = log2 p(c, t) / (p(c) p(t)), which reaches the entity's whole information
IC(c) = -log2 p(c) where t never occurs without c. p(c) and p(t) are shares of all different texts, p(c, t) the share in which t stands within
``CONTEXT`` code points of c. Besides its value, an entity also counts as what it has in common with others: the domain of an e-mail address, the first two numbers of an IP
address, the issuer of a card, the area of a phone number; a term may give that away where no single value occurs twice. A term that discloses at least ``REMOVE`` of the information is removed, at least ``GENERALISE`` of it is generalised to a
placeholder, wherever it stands in any text, provided that chance alone would hardly make them meet as often: a bound of the hypergeometric tail, times the number of
pairs, is at most ``CHANCE``. So an entity of two texts can have such terms, and a line that stands in many texts counts once for each of them; copies of
a whole text are one text, so that a document that was copied often does not by itself make its words disclosing. A single text
is enough only where few pairs are compared.

Null texts count as empty and, like empty ones, hold nothing. Places are code points, end exclusive. Rows are told apart by a key of their own,
so repeated rows and null or repeated doc_ids do not mix. Columns other than the text pass through; columns that have the names of results are
replaced. Very long texts are searched with possessive patterns, which neither backtrack nor recurse. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import keep

#: The patterns, in forms that match the same and never backtrack over a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = 80
CHANCE = 0.05
GENERALISE, REMOVE = 0.8, 0.95
_BLOCK = 256
_CHUNK = 4096
_FOUND = "array<struct<start:int,end:int,value:string>>"
_NEAR = "array<struct<kind:string,value:string,term:string>>"


def _running(lengths: Column) -> Column:
    """Sums of what stands before each element."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    return F.aggregate(lengths, start, step, lambda a: a["out"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column) -> Column:
    """The same for long arrays, by blocks, as appending copies an array. ``lengths`` should be bound by let()."""
    count = F.ceil(F.size(lengths) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))

    def join(parts: Column) -> Column:
        sums = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(_running(sums), lambda offsets: F.flatten(F.transform(parts, lambda b, i: let(F.get(offsets, i), lambda o: F.transform(_running(b), lambda v: v + o)))))

    return F.when(F.size(lengths) <= _BLOCK, _running(lengths)).otherwise(let(blocks, join))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match, leftmost first, not overlapping: what lies between them gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def place(m: Column, b: Column) -> Column:
        lengths = F.transform(m, lambda x, i: F.length(x) + F.get(b, i))
        before = let(lengths, running)
        return let(
            before,
            lambda at: F.transform(
                m,
                lambda x, i: let(
                    F.get(at, i) + F.get(b, i),
                    lambda start: F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("value")),
                ),
            ),
        )

    return let(found, lambda m: F.when(F.size(m) > 0, let(between, lambda b: place(m, b))).otherwise(F.array().cast(_FOUND)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the last digit on, every second one is doubled."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _base(text: Column) -> dict[str, Column]:
    none = F.array().cast(_FOUND)
    some = lambda guard, found: F.when(guard, found).otherwise(none)
    email = some(F.contains(text, F.lit("@")), matches(text, EMAIL))
    ip = some(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(matches(text, IP), lambda x: x["value"].rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")))
    card = some(
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        F.filter(
            F.filter(matches(text, CARD), lambda x: F.length(_digits(x["value"])).between(13, 19)),
            lambda x: luhn(_digits(x["value"])),
        ),
    )
    phone = some(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: F.length(_digits(x["value"])).between(9, 15)))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def _entities() -> Column:
    """All base spans of a row, with kind and the value in one form."""
    one = lambda kind: F.transform(
        F.col(kind),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            (F.lower(x["value"]) if kind == "email" else x["value"] if kind == "ip" else _digits(x["value"])).alias("value"),
            x["start"].alias("start"),
            x["end"].alias("end"),
        ),
    )
    return F.concat(*(one(k) for k in KINDS))


def _near(text: Column, entities: Column) -> Column:
    """Every whole word (letters only) within CONTEXT of an entity, lowered, with the entity.

    Contexts are cut from overlapping chunks, as finding a place in a text takes as long as the text before it.
    """
    chunk = F.length(text) / F.lit(_CHUNK)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(chunk).cast("int")), lambda c: F.substring(text, _origin(c) + 1, F.lit(_CHUNK + 2 * CONTEXT)))

    def cut(parts: Column, start: Column, length: Column, anchor: Column) -> Column:
        c = F.floor(anchor / _CHUNK).cast("int")
        return F.substring(F.get(parts, c), start - _origin(c) + 1, length)

    def of(parts: Column, x: Column) -> Column:
        from_ = F.greatest(x["start"] - CONTEXT, F.lit(0))
        before = cut(parts, from_, x["start"] - from_, x["start"])
        after = cut(parts, x["end"], F.lit(CONTEXT), x["end"])
        return let(F.struct(before.alias("b"), after.alias("a")), lambda c: words(x, from_, c["b"], c["a"]))

    def words(x: Column, from_: Column, before: Column, after: Column) -> Column:
        left = F.filter(matches(before, r"\p{L}++"), lambda w: (w["start"] > 0) | (from_ == 0))
        right = F.filter(matches(after, r"\p{L}++"), lambda w: (w["end"] < CONTEXT))
        word = lambda w: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), F.lower(w["value"]).alias("term"))
        return F.concat(F.transform(left, word), F.transform(right, word))

    found = let(chunks, lambda parts: F.flatten(F.transform(entities, lambda x: of(parts, x))))
    return F.when(F.size(entities) > 0, found).otherwise(F.array().cast(_NEAR))


def _origin(c: Column) -> Column:
    return F.greatest(c * _CHUNK - CONTEXT, F.lit(0))


def _terms(text: Column) -> Column:
    """Every different word of a text, lowered."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}++"), F.lit(0)), lambda w: F.lower(w)))


def _chance(n: Column, whole: Column, drawn: Column, both: Column) -> Column:
    """Log of Hoeffding's bound that of ``drawn`` out of ``n`` texts at least ``both`` are among ``whole`` given ones; 0 if that is to be expected."""
    q, p = both / drawn, whole / n
    miss = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(F.lit(0.0))
    return F.when(q > p, -drawn * (q * F.log(q / p) + miss)).otherwise(F.lit(0.0))


def _general(x: Column) -> Column:
    """What an entity (with kind and value) has in common with others, told apart from any value by its mark."""
    value = x["value"]
    shared = (
        F.when(x["kind"] == "email", F.substring_index(value, "@", -1)).when(x["kind"] == "ip", F.substring_index(value, ".", 2))
        .when(x["kind"] == "card", F.substring(value, 1, 6)).otherwise(F.substring(value, 1, 4))
    )
    return F.concat(F.lit("in "), shared)


def _with_general(found: Column, *others: str) -> Column:
    """Different entities, or entities with terms, each by its value and by what it has in common."""
    made = lambda x, value: F.struct(x["kind"].alias("kind"), value.alias("value"), *(x[o].alias(o) for o in others))
    return F.array_distinct(F.concat(F.transform(found, lambda x: made(x, x["value"])), F.transform(found, lambda x: made(x, _general(x)))))


def disclosing(found: DataFrame, threshold: float = GENERALISE) -> DataFrame:
    """(kind, value, term, disclosure) of the terms that give an entity away; counts cover all different texts.

    Every count is a partial aggregate first. ``found`` is written, with a row for every text (``_read``).
    """
    entity = ["kind", "value"]
    hashed = found.select("row", F.md5("_read").alias("h"))
    first = keep(hashed.groupBy("h").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = keep(hashed.join(first, "h").where("row <> first").select("row"))
    once = found.join(again, "row", "left_anti")
    total = once.count()
    entities = once.select(F.explode(_with_general(_entities())).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n_entity"))
    met = once.select(F.explode(_with_general(F.col("near"), "term")).alias("w"))
    together = met.groupBy("w.kind", "w.value", "w.term").agg(F.count("*").alias("n_both"))
    counted = once.select(F.explode(_terms(F.col("_read"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    pairs = keep(together.join(entities, entity))
    n = F.lit(float(max(total, 1)))
    both = F.least("n_both", "n_entity", "n_term")
    pmi = F.log2(both * n / (F.col("n_entity") * F.col("n_term")))
    information = F.log2(n / F.col("n_entity"))
    told = F.when(information > 0, pmi / information).otherwise(F.lit(0.0))
    chance = F.least(_chance(n, F.col("n_entity"), F.col("n_term"), both), _chance(n, F.col("n_term"), F.col("n_entity"), both))
    rare = chance <= F.log(F.lit(CHANCE / max(pairs.count(), 1)))
    return pairs.join(counted, "term").where(rare).select(*entity, "term", told.alias("disclosure")).where(F.col("disclosure") >= threshold)


def find(documents: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """The columns ``passed`` (all by default), with email, ip, card and phone: arrays of (start, end, value), and term: of (start, end, removed).

    Texts are written with what is found in them, as terms are looked for in all of them once they are known.
    """
    names = (*KINDS, "term", "near", "row", "_read")
    columns = [c for c in (documents.columns if passed is None else passed) if c not in names]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*columns, text.alias("_read"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("*", *(c.alias(k) for k, c in _base(F.col("_read")).items()))
    rows = rows.withColumn("_entities", _entities()).withColumn("near", _near(F.col("_read"), F.col("_entities"))).drop("_entities")
    # texts stay once in the written table
    found = keep(rows.drop("_read") if "text" in columns else rows)
    read = found.withColumn("_read", text) if "text" in columns else found
    told = keep(disclosing(read).groupBy("term").agg(F.max("disclosure").alias("d")))
    hits = read.select("row", F.explode(_terms(F.col("_read"))).alias("term")).join(told, "term")
    known = keep(hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("known")))
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    share = lambda w: F.try_element_at("known", F.lower(w["value"]))
    places = F.transform(
        F.filter(matches(F.col("_read"), r"\p{L}++"), lambda w: share(w).isNotNull()),
        lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), (share(w) >= REMOVE).alias("removed")),
    )
    term = F.when(F.col("known").isNull(), none).otherwise(places)
    return read.join(known, "row", "left").withColumn("term", term).drop("row", "near", "known", "_read")


def spelled(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these kinds, in that order, comma-joined."""
    one = lambda k: F.transform(F.col(k), lambda x: F.concat_ws(":", F.lit(k), x["start"], x["end"]))
    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")


def _clean(text: Column) -> Column:
    """``text`` with every span replaced; spans that overlap become one, named after the first."""
    label = lambda k: F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("label")))
    term = F.transform(
        "term", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["removed"], "").otherwise("[TERM]").alias("label"))
    )
    kind = "array<struct<start:int,end:int,label:string>>"
    spans = F.array_sort(F.concat(*(label(k) for k in KINDS), term).cast(kind))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["label"].alias("label"))
        overlaps = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > x["start"])
        return F.when(overlaps, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x))).cast(kind)

    merged = F.aggregate(spans, F.array().cast(kind), add)
    end_before = lambda i: F.when(i > 0, F.get(F.col("_spans"), i - 1)["end"]).otherwise(0)
    parts = F.transform("_spans", lambda x, i: F.concat(F.substring(text, end_before(i) + 1, x["start"] - end_before(i)), x["label"]))
    tail = F.substring(text, F.element_at("_spans", -1)["end"] + 1, F.length(text))
    return merged, F.concat(F.array_join(parts, ""), tail)


def sanitise(documents: DataFrame) -> DataFrame:
    """``documents`` with every entity replaced by its kind and every disclosing term generalised or removed."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    whole = documents.select(F.struct(*rest, F.lit(True).alias("_")).alias("_whole"), "text")
    found = find(whole)
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") + F.size("term") > 0
    merged, text = _clean(F.col("text"))
    clean = found.where(~some)
    changed = found.where(some).withColumn("_spans", merged).withColumn("text", text)
    columns = [F.col("text") if c == "text" else F.col("_whole").getField(c).alias(c) for c in documents.columns]
    return clean.select(*columns).unionByName(changed.select(*columns))
