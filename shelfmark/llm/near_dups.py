"""Near-duplicate detection by min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum
and its maximum, so 80 hash evaluations fill 160 values. They are banded; documents
that share a band are candidates, and a candidate becomes a link only when the full
shingle sets confirm it. Documents with equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scale import broadcast_if_small
from shelfmark.llm.common import discard, mixed, named_words, slices, whole_texts, written
from shelfmark.operators.components import connected_components

PERMUTATIONS, ROWS_PER_BAND = 80, 5
BANDS = 2 * PERMUTATIONS // ROWS_PER_BAND
#: Further hubs tried in buckets of several components, before what lies beyond the first hub is looked at.
STAR_ROUNDS = 1
#: Documents that tell which shingles are rare, and the bits of a name that are counted.
ORDER_ROWS, ORDER_BITS = 4000, 18
PAIRS_PER_PIECE = 2048

_rng = np.random.default_rng(20240607)
_TIMES = _rng.integers(0, 2**63, PERMUTATIONS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, PERMUTATIONS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.uint64(0x9DDFEA08EB382D69)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each text, ascending, one after another, and where each text's begin.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words
    than ``size`` has its whole sequence as one shingle, one without words none.
    """
    names, first = named_words(texts, lower=True)
    counts = np.diff(first)
    parts: list[np.ndarray] = []
    whole = names[: max(0, len(names) - size + 1)].copy()
    for j in range(1, size):
        whole = mixed(whole * _ORDER + names[j : len(names) - size + 1 + j])
    for i, n in enumerate(counts.tolist()):
        if n >= size:
            parts.append(np.unique(whole[first[i] : first[i] + n - size + 1]))
        elif n:
            h = names[first[i] : first[i] + 1]
            for j in range(1, n):
                h = mixed(h * _ORDER + names[first[i] + j : first[i] + j + 1])
            parts.append(mixed(h + np.uint64(n)))
        else:
            parts.append(names[:0])
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.concatenate(parts) if parts else names[:0], at


def min_max_bands(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Band hashes (texts x BANDS) of non-empty sets."""
    signature = np.empty((2 * PERMUTATIONS, len(at) - 1), np.uint64)
    for j in range(PERMUTATIONS):
        turned = values * _TIMES[j] + _PLUS[j]
        signature[2 * j] = np.minimum.reduceat(turned, at[:-1])
        signature[2 * j + 1] = np.maximum.reduceat(turned, at[:-1])
    bands = np.empty((len(at) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(at) - 1, b + 1, np.uint64)
        for row in signature[b::BANDS]:
            h = mixed(h * _ORDER + row)
        bands[:, b] = h
    return bands


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit name (set_a, set_b) and its band hashes, one row per document."""
    whole_texts(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(part.column("text"), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                name = np.zeros((2, len(n)), np.uint64)
                spread = np.zeros(len(n) + 1, np.int64)
                np.cumsum(np.where(n > 0, BANDS, 0), out=spread[1:])
                flat = np.zeros(0, np.int64)
                if len(full):
                    name[0, full] = np.add.reduceat(mixed(values), at[full])
                    name[1, full] = np.add.reduceat(mixed(values ^ _ORDER), at[full])
                    flat = min_max_bands(values, np.append(at[full], at[-1])).ravel().view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(spread.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), *(pa.array(x.view(np.int64)) for x in name), bands],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.mapInArrow(run, schema)


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur in a sample of documents, by the leading bits of their names.

    It only orders shingles, rarest first, for ``beyond_hub``: any other order
    gives the same links, with more pairs compared on the way.
    """
    share = F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1 << 20)) < int(min(1.0, ORDER_ROWS / max(docs.count(), 1)) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                values, _ = shingle_sets(part.column("text"), size)
                total += np.bincount((values >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    table = docs.where(share).select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.zeros(1 << ORDER_BITS, np.int32)
    out[table.column("cell").to_numpy()] = np.minimum(table.column("n").to_numpy(), 2**31 - 1)
    return out


def full_sets(docs: DataFrame, size: int, counts: np.ndarray) -> DataFrame:
    """doc_id and the whole set of shingle names, the rarest by ``counts`` first."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingle_sets(part.column("text"), size)
                often = shared.value[(values >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                values = values[np.lexsort((values, often, np.repeat(np.arange(len(at) - 1), np.diff(at))))]
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, schema)


def side_by_side(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both full sets (left, right) and the size of what they share.

    ``a`` is the hub of its pairs; a hub of very many pairs is copied to one piece
    per ``PAIRS_PER_PIECE`` of them, so its pairs spread over tasks.
    """
    pieces = pairs.groupBy("a").agg((1 + F.floor(F.count(F.lit(1)) / PAIRS_PER_PIECE)).cast("int").alias("pieces"))
    hubs = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")).join(pieces, "a").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    ).drop("pieces")
    members = pairs.join(pieces, "a").withColumn("piece", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int")).drop("pieces").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b"
    )
    return members.join(hubs, ["a", "piece"]).drop("piece").withColumn("shared", F.size(F.array_intersect("left", "right")))


def linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.size("left") + F.size("right") - F.col("shared"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    return side_by_side(pairs, sets).where(linked(percent)).select("a", "b")


def beyond_hub(groups: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links of members with their hub, the pairs of members in different components that can still be links, and the scratch tables both read.

    ``groups`` has a (the hub), b (a member), n (size of its set) and comp. Two
    linked sets share at least s = p / (100 + p) * (|x| + |y|) shingles. Inside the
    hub h they share at most what either has in common with h; so, if that is less
    than s, they share some shingle outside h. The first few of x's own shingles, in
    one order for all (rarest first), must then hold one of y's: how many those are
    follows from the smallest y that could be linked. If it is not less than s, then
    y is so small that |y| <= (100 + p) / p * |x & h| - |x|; those sizes, few where x
    is no link of h, are looked up. Pairs that are both links of h need no look.
    """
    several = groups.groupBy("a").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("a")
    both = side_by_side(groups.join(several, "a"), sets).withColumn("is_link", linked(percent)).withColumn("own", F.array_except("right", "left"))
    smallest, hub = F.ceil(F.col("n") * percent / 100), F.size("left")
    # three classes of size, so that what a partner must share is known well: about as large as the hub, a little less, less
    floors = [hub - F.floor(hub / 50), F.ceil(hub * 0.9), F.lit(0)]
    lists = []
    for k, low in enumerate(floors):
        least = F.ceil((F.col("n") + F.greatest(smallest, low)) * percent / (100 + percent)) - F.col("shared")
        taken = F.greatest(F.size("own") - F.greatest(least, F.lit(1)) + 1, F.lit(0)).cast("int")
        lists.append(F.struct(F.lit(k).alias("their"), F.slice("own", F.lit(1), taken).alias("first")))
    largest = F.floor(F.col("shared") * (100 + percent) / percent) - F.col("n")
    sizes = F.when(~F.col("is_link") & (largest >= smallest), F.sequence(smallest.cast("int"), largest.cast("int"))).otherwise(F.array().cast("array<int>"))
    mine = F.when(F.col("n") >= floors[0], 0).when(F.col("n") >= floors[1], 1).otherwise(2)
    seen = written(both.select("a", "b", F.col("n").cast("int").alias("n"), "comp", "is_link", mine.alias("mine"), F.array(*lists).alias("lists"), sizes.alias("sizes")))

    def mates(keys: list[str], one: DataFrame, two: DataFrame) -> DataFrame:
        one = one.withColumnsRenamed({"b": "x", "n": "xn", "comp": "xc", "is_link": "xl"})
        two = two.withColumnsRenamed({"b": "y", "n": "yn", "comp": "yc", "is_link": "yl"})
        alike = (F.col("x") != F.col("y")) & (F.col("xc") != F.col("yc")) & ~(F.col("xl") & F.col("yl"))
        alike &= 100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn")
        return one.join(two, keys).where(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    tokens = seen.select("a", "b", "n", "comp", "is_link", "mine", F.explode("lists").alias("list"))
    tokens = tokens.select("a", "b", "n", "comp", "is_link", "mine", "list.their", F.explode("list.first").alias("shingle"))
    common = tokens.groupBy("a", "shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("a", "shingle")
    tokens = written(tokens.join(common, ["a", "shingle"]))
    near = mates(["a", "shingle", "mine", "their"], tokens.where(~F.col("is_link")), tokens.withColumnsRenamed({"mine": "other", "their": "mine"}).withColumnRenamed("other", "their"))
    wanted = seen.select("a", "b", "comp", "is_link", F.col("n").alias("wn"), F.explode("sizes").alias("n")).withColumn("size", F.col("n")).drop("n").withColumnRenamed("wn", "n")
    small = mates(["a", "size"], wanted, seen.select("a", "b", "n", "comp", "is_link", F.col("n").alias("size")))
    return seen.where("is_link").select("a", "b"), near.unionByName(small).distinct(), [seen, tokens]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, one row per row of ``docs``.

    Two documents are linked if their sets of ``size``-word shingles have
    100 * intersection >= percent * union. Texts that are null or have no words are
    linked with nothing; a row with null doc_id takes no part (component null,
    kept). Rows of one doc_id count as one document. Other columns are ignored;
    an empty table gives no rows.

    At 80 per cent a pair misses all 32 bands of 5 with probability 3e-6. Inside a
    bucket every member is compared with one hub, the one most often in company, and
    where several components are left with another. In buckets that stay split, what
    two members have in common beyond the first hub (see ``beyond_hub``) shows which of them can still be linked; those are compared in full. So a bucket
    of copies, or of documents round one passage, costs a few pairs a member, and no
    candidate link is lost.
    """
    sig = written(signatures(docs, size))
    full = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"))
    reps = classes.select(F.col("first").alias("doc_id")).distinct()
    rows = full.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("band")
    members = written(rows.join(buckets, "band"))
    company = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    weight = members.join(company, "band").groupBy("id").agg(F.sum("size").alias("weight"))  # in how much company a document is: a group's middle has most
    unweighted, members = members, written(members.join(weight, "id"))
    discard(unweighted)
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text")
    rare = shingle_counts(texts, size)
    sets = written(full_sets(texts.join(broadcast_if_small(ids), "doc_id", "left_semi"), size, rare))

    def alike(a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def with_hub(rows: DataFrame, key: Column) -> DataFrame:
        hub = rows.groupBy("band").agg(F.min(F.struct(key.alias("key"), "id", "n", "comp")).alias("hub"))
        return rows.join(hub, "band").select(
            F.col("hub.id").alias("a"), F.col("hub.n").alias("an"), F.col("hub.comp").alias("ac"), F.col("id").alias("b"), "n", "comp"
        ).where("a <> b").distinct()

    star = with_hub(members.withColumn("comp", F.col("id")), -F.col("weight"))
    links = written(confirmed(star.where(alike("an", "n")).select("a", "b").distinct(), sets, percent))
    component = connected_components(links)

    def placed(rows: DataFrame, id: str) -> DataFrame:
        return rows.drop("comp").join(component.withColumnRenamed("node", id), id, "left").withColumn("comp", F.coalesce("component", id)).drop("component")

    now = written(placed(members, "id"))
    discard(members)
    for turn in range(STAR_ROUNDS):
        before, now = now, placed(now, "id") if turn else now
        split = now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high and size > 2").select("band")
        now = written(now.join(split, "band"))
        discard(before)
        star = with_hub(now, F.xxhash64("id", "band", F.lit(turn)))
        fresh = written(confirmed(star.where(alike("an", "n")).where("ac <> comp").select("a", "b").distinct(), sets, percent))
        if fresh.limit(1).count() == 0:
            break
        links = written(links.unionByName(fresh))
        component = connected_components(links)

    now = placed(now, "id")
    split = now.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high and size > 2").select("band")
    groups = written(with_hub(now.join(split, "band"), -F.col("weight")).select("a", "b", "n", "comp").distinct())
    found, left, scratch = beyond_hub(groups, sets, percent)
    fresh = written(found.unionByName(confirmed(left, sets, percent)))
    discard(groups, sets, *scratch)
    if fresh.limit(1).count():
        component = connected_components(written(links.unionByName(fresh)))

    named = sig.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    named = named.withColumn("first", F.when(own, F.col("first")).otherwise(F.col("doc_id")))
    out = named.join(component.withColumnRenamed("node", "first"), "first", "left")
    final = F.coalesce("component", "first")
    return out.select("doc_id", "n_shingles", final.alias("component_id"), F.coalesce(F.col("doc_id") == final, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, whole rows, without near duplicates: of each group the document with the smallest doc_id stays, once."""
    verdict = near_duplicates(docs, size, percent)
    flags = written(verdict.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("kept").alias("__kept"), (F.count(F.lit(1)) > 1).alias("__repeated")).where("__repeated or not __kept"))
    stay = docs.join(broadcast_if_small(flags), "doc_id", "left").where("coalesce(__kept, true)").withColumn("__repeated", F.coalesce("__repeated", F.lit(False)))
    if flags.where("__repeated and __kept").limit(1).count():
        again = stay.where("__repeated")
        stay = stay.where("not __repeated").unionByName(again.dropDuplicates(["doc_id"]))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
