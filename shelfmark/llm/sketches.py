"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

Two sketches keep the same hashes of what their texts share, whatever the lengths,
so sizes of intersections and unions scale by the fraction: containment of a short
text in a very long one is estimated as well as likeness of equals, and the sketch of
a union is the union of sketches. A text without a hash below the fraction keeps its
smallest one, so that every text with words has a sketch. DataFrame and SQL functions
only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import written

SHINGLE_WORDS = 5
#: Hexadecimal hashes below this one are kept: one eighth.
BELOW = "2"
HASH_DIGITS = 16


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once: a lambda's variable is a value, a repeated expression is not."""
    return F.transform(F.array(value), then)[0]


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the word shingles of a text (the whole sequence where it has fewer words; none without words)."""

    def hashed(shingle: Column) -> Column:
        return F.substring(F.md5(F.array_join(shingle, " ")), 1, HASH_DIGITS)

    def of_words(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: hashed(F.slice(words, i, size)))
        return F.when(n >= size, many).when(n > 0, F.array(hashed(words))).otherwise(_none())

    return _let(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), of_words)


def _none() -> Column:
    return F.array().cast("array<string>")


def retained(hashes: Column, below: str = BELOW) -> Column:
    """The sketch: distinct hashes under ``below`` in ascending order, or the smallest one where none is."""

    def of_hashes(all_: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(all_, lambda h: h < below)))
        return _let(low, lambda kept: F.when(F.size(kept) > 0, kept).when(F.size(all_) > 0, F.array(F.array_min(all_))).otherwise(_none()))

    return _let(hashes, of_hashes)


def sketch(text: Column, size: int = SHINGLE_WORDS, below: str = BELOW) -> Column:
    return retained(shingle_hashes(F.coalesce(text, F.lit("")), size), below)


def merged(a: Column, b: Column, below: str = BELOW) -> Column:
    """The sketch of two texts together: the union, without a smallest hash that only stood in for none."""
    return retained(F.array_union(a, b), below)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has (nothing in nothing: 1)."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger, 0 to 1 (two empty: 1, one empty: 0)."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def packed(a: Column) -> Column:
    """A sketch as bytes, eight a hash, for exchanges."""
    return F.unhex(F.array_join(a, ""))


def unpacked(a: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(a)), F.lit(f".{{{HASH_DIGITS}}}"), F.lit(0))


def spelled(a: Column) -> Column:
    return F.array_join(a, ",")


def group_sketch(docs: DataFrame, groups: list[str], text: str = "text", below: str = BELOW) -> DataFrame:
    """``groups``, hash: the merged sketch of each group in rows, so that a group of any size stays spread."""
    hashes = docs.select(*groups, F.explode(sketch(F.col(text), below=below)).alias("hash")).distinct()
    low = F.col("hash") < below
    least = hashes.groupBy(*groups).agg(F.min("hash").alias("__least"))
    keep = [F.col(f"l.{g}").eqNullSafe(F.col(f"h.{g}")) for g in groups]
    on = keep[0]
    for k in keep[1:]:
        on = on & k
    alone = least.where(F.col("__least") >= below).alias("l").join(hashes.alias("h"), on & (F.col("l.__least") == F.col("h.hash"))).select(*[F.col(f"h.{g}") for g in groups], F.col("h.hash"))
    return hashes.where(low).unionByName(alone)


#: Order of documents of one doc_id, and a name of each (doc_id, text) for joins that keep nulls.
_NAME = "__name"


def next_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """name, next_name, ``key``, n_chars, copies: of each distinct (key, text) the one after it (after the last: the first).

    Ordered by key, then the text's MD5; null keys first. Only keys and digests are
    sorted, over range partitions whose first rows meet in one small table.
    """
    rows = docs.groupBy(key, F.md5(text).alias("digest"), F.char_length(text).cast("bigint").alias("n_chars")).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col(key).asc_nulls_first(), F.col("digest")]
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    name = _name(F.col(key), F.col("digest"))
    inside = Window.partitionBy("part").orderBy(*order)
    firsts = ranged.groupBy("part").agg(F.min_by(name, F.struct(F.col(key).isNotNull(), key, "digest")).alias("first"))
    parts = Window.orderBy("part")  # one row per partition
    after = firsts.select("part", F.lead("first").over(parts).alias("after"), F.min_by("first", "part").over(Window.partitionBy()).alias("very_first"))
    led = ranged.select("*", name.alias("name"), F.lead(name).over(inside).alias("next_name"))
    return led.join(F.broadcast(after), "part").select("name", F.coalesce("next_name", "after", "very_first").alias("next_name"), key, "n_chars", "copies")


def _name(key: Column, digest: Column) -> Column:
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), digest)


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are; the columns of query ``op11``.

    The edited text has its last quarter (code points, rounded down) replaced by as many
    from the start of the next document. Null texts count as empty (an empty fingerprint,
    like only to an empty one). Rows alike in key and text count as one document and get
    one result each; rows of one key with different texts are ordered by the text's MD5.
    An empty table stays empty, other columns are left aside, texts are taken whole.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = written(next_rows(docs, "doc_id", "text"))
    told = docs.select(_name(F.col("doc_id"), F.md5("text")).alias(_NAME), "text", packed(sketch(F.col("text"))).alias("mark"))
    texts = told.groupBy(_NAME).agg(F.first("text").alias("text"), F.first("mark").alias("mark"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    heads = texts.join(links, F.col(_NAME) == F.col("next_name")).select(
        F.col("name").alias(_NAME), "doc_id", "n_chars", "copies", F.substring("text", F.lit(1), quarter).alias("head"), F.col("mark").alias("next_mark")
    )
    both = texts.join(heads, _NAME)
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.col("head"))
    both = both.select("doc_id", "n_chars", "copies", unpacked(F.col("mark")).alias("mark"), unpacked(F.col("next_mark")).alias("next_mark"), edited.alias("edited"))
    both = both.select("*", sketch(F.col("edited")).alias("edited_mark"))
    rows = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("mark")).alias("fingerprint"), spelled(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"), "copies",
    )
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")
