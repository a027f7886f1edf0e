"""Personal data and what gives it away, with DataFrame functions only.

Patterns find the protected entities (addresses, numbers). Corpus co-occurrence then
tells how much of an entity's information content the terms of its documents disclose:
a term that hardly occurs without the entity reveals it even when the entity itself is
blanked. Such terms are generalised along with the entities, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scale import broadcast_if_small
from shelfmark.llm.common import written

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of the entity's information content from which a term discloses it, and texts' worth of doubt in what few texts tell.
DISCLOSURE, DOUBT = 0.95, 0.5

# stand-ins of one character: of a separator inside a match, and around a match; a text's own go to a third character
_INNER, _EDGE, _OTHER = "\u0002", "\u0003", "\u0001"
_LOCAL = r"A-Za-z0-9._%+\x02-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[A-Za-z0-9-]++\x02)[A-Za-z0-9\x02-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x02]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"(?<![\p{L}\p{N}@_%+-])\p{L}{3,}(?![\p{L}\p{N}@_%+-])"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _pieces(text: Column, pattern: str) -> Column:
    """The text in turn outside and inside matches; lengths add up to the text's."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_EDGE}$1{_EDGE}"), _EDGE, -1)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Matches as (start, kind, end, value), start and end in code points."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.array(F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), piece.alias("value")))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.when(acc["i"] % 2 == 1, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_pieces(text, pattern), start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def weigh(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_part(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) == 0) | ((F.length(short) <= 3) & (F.when(F.length(short) <= 3, short).try_cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """Entities of a text: (start, kind, end, value) by start, then kind; kinds are numbered as in ``KINDS``.

    Each kind's matches are leftmost and do not overlap; a match that fails its
    check (parts of an address, digits, check digit) is dropped without a retry.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), _INNER + _EDGE, _OTHER + _OTHER)
    none = F.array().cast(_SPAN)
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _INNER)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _INNER)
    count = lambda s: F.length(_digits(s["value"]))
    email = F.when(F.contains(plain, F.lit("@")), _matches(dotted, _EMAIL, 0)).otherwise(none)
    ip = F.when(plain.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(plain, _IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), _small_part))).otherwise(none)
    card = F.when(plain.rlike(r"[0-9][\x20-]?[0-9]"), F.filter(_matches(joined, _CARD, 2), lambda s: F.when(count(s).between(12, 19), _luhn(s["value"])).otherwise(False))).otherwise(none)
    phone = F.when(F.contains(plain, F.lit("+")), F.filter(_matches(plain, _PHONE, 3), lambda s: count(s).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def entity_of(span: Column) -> Column:
    """One name for all spellings of an entity: its kind and its value, lower-cased, or its digits."""
    value = F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(F.translate(span["value"], _INNER, ".")))
    return F.concat_ws(":", span["kind"].cast("string"), value)


def _blanked(text: Column, spans: Column) -> Column:
    """The text, of the same length, without the letters and digits of its entities: what is left of words stands outside them."""
    plain = F.translate(text, _INNER + _EDGE, _OTHER + _OTHER)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(plain, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        rest = F.substring(s["value"], F.greatest(acc["at"] - s["start"], F.lit(0)) + 1, F.length(s["value"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.regexp_replace(rest, r"[\p{L}\p{N}]", "0")).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(plain, acc["at"] + 1, F.length(plain))))


def _words(blanked: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blanked, F.lit(f"({_TERM})"), 1), lambda w: F.lower(w)))


def _occurrences(blanked: Column, terms: Column) -> Column:
    """Every place of the given terms in a text, as spans without a value."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.array(F.struct(acc["at"].alias("start"), F.lit(4).alias("kind"), end.alias("end"), F.lit("").alias("value")))
        told = F.when(acc["i"] % 2 == 1, F.array_contains(terms, F.lower(piece))).otherwise(False)
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.when(told, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_pieces(blanked, _TERM), start, step, lambda acc: acc["out"])


_KEY = ["__id", "__text"]


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of what a row's spans depend on: repeated rows share it, and their spans."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("__text", F.xxhash64("text"))


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """The terms (term) of the corpus that disclose an entity, from rows of (__text, spans, words).

    Co-occurrence is counted per document, over all documents: with N documents, n_e
    of them with the entity, n_t with the term and n_et with both, the term discloses
    PMI / IC(e) = log(N * n_et / (n_e * n_t)) / log(N / n_e) of the entity's
    information content. Support discounts the PMI smoothly, by log(1 + ``DOUBT`` / w)
    where w different texts hold both: copies of one text are one piece of evidence.
    Terms of at least ``DISCLOSURE`` for any entity are returned.

    As n_et is at most n_e, such a term stands in N^(1 - DISCLOSURE) * n_e^DISCLOSURE
    documents at most; more common ones are left out before pairs are made.
    """
    names = F.array_distinct(F.transform("spans", entity_of))
    held = rows.where(F.size("spans") > 0).groupBy("__text").agg(F.count(F.lit(1)).alias("copies"), F.first(names).alias("entities"), F.first("words").alias("words"))
    held = written(held)
    n_e = written(held.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_e")))
    n = rows.count()
    most = n_e.where(F.col("n_e") < n).agg(F.max("n_e").alias("m")).first().m
    if most is None:
        return rows.select(F.lit("").alias("term")).limit(0)
    reach = lambda of: F.pow(F.lit(float(n)), F.lit(1 - DISCLOSURE)) * F.pow(of.cast("double"), F.lit(DISCLOSURE)) * (1 + 1e-9)
    words = held.select("__text", "copies", F.explode("words").alias("term"))
    candidates = written(words.groupBy("term").agg(F.sum("copies").alias("least")).where(F.col("least") <= reach(F.lit(most))).select("term"))
    n_t = rows.select(F.explode("words").alias("term")).join(broadcast_if_small(candidates), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    rare = written(n_t.where(F.col("n_t") <= reach(F.lit(most))))
    left = words.join(broadcast_if_small(rare), "term").select("__text", "copies", "term", "n_t")
    right = held.select("__text", F.explode("entities").alias("entity")).join(broadcast_if_small(n_e.where(F.col("n_e") < n)), "entity")
    pairs = left.join(right, "__text").where(F.col("n_t") <= reach(F.col("n_e"))).groupBy("entity", "term").agg(
        F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("texts"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")
    )
    pmi = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) - F.log(1 + F.lit(DOUBT) / F.col("texts"))
    return pairs.where(pmi >= DISCLOSURE * F.log(F.lit(float(n)) / F.col("n_e"))).select("term").distinct()


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key and its ``spans``: entities (kinds 0 to 3) and disclosing terms (kind 4), by start, then kind.

    A term that discloses an entity is a span wherever it stands: in every document,
    whether the entity is spelled out there or not.

    One row per row of ``docs``. Null texts are empty and have no spans, null
    doc_ids are ids like any other, repeated rows get the same spans, other columns
    are ignored, an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = _keyed(docs)
    found = written(keyed.withColumn("spans", base_spans(F.col("text"))).withColumn("words", _words(_blanked(F.col("text"), F.col("spans")))).drop("text"))
    telling = broadcast_if_small(written(disclosing_terms(found)))
    marked = found.select(*_KEY, F.explode("words").alias("term")).join(telling, "term", "left_semi").groupBy(*_KEY).agg(F.collect_set("term").alias("terms"))
    marked = broadcast_if_small(written(marked))
    blanked = _blanked(F.col("text"), base_spans(F.col("text")))
    terms = keyed.join(marked, _KEY).select(*_KEY, _occurrences(blanked, F.col("terms")).alias("terms")).dropDuplicates(_KEY)
    return found.drop("words").join(terms, _KEY, "left").withColumn(
        "spans", F.array_sort(F.concat("spans", F.coalesce("terms", F.array().cast(_SPAN))))
    ).drop("terms")


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span generalised to its kind, as in ``<EMAIL>``; what overlaps a span before it goes with that."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs``, whole rows, with the text's entities and disclosing terms generalised. Texts without any stay as they are, null ones null."""
    spans = all_spans(docs).where(F.size("spans") > 0).select(*_KEY, F.col("spans").alias("__spans")).dropDuplicates(_KEY)
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = keyed.join(broadcast_if_small(written(spans)), _KEY, "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__spans"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
