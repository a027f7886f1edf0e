"""A stored lexical index and exact top k by bound pruning.

The corpus is tokenised once, into a forward index in the shared folder; inverted
postings, term counts and maximal scores are read from there. Chunks are dealt into
blocks, and for every token and block the largest score part is known (``bounds``).

A query is answered in three steps. The k chunks that its strongest terms like best
are scored in full: a floor under the k-th best score. Its weakest terms, as many as
together stay under the floor, can find no chunk by themselves; the other terms are
scored, and a pair of query and chunk stays only if its score so far plus the largest
parts of the weak terms in the chunk's block reaches the floor. Only those few pairs
meet the long postings of common terms. Nothing is approximated: what is left out
cannot be among the best k.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.scale import BROADCAST_LIMIT_BYTES, broadcast_if_small, ensure_checkpoint_dir, payload_bytes
from shelfmark.functions.text import tokenize

SCORE_DIGITS = 9  # equal texts must tie, whatever order their terms were summed in
#: Chunks of a block, on average; the bounds of a token take one row per block it occurs in.
BLOCK_CHUNKS = 512
#: Postings of one token in one piece; a token of more is dealt to pieces by block.
PIECE_POSTINGS = 1 << 20
#: The floor is found by the strongest terms, which hold the rest of this share of a query's largest possible score.
SEED_SHARE = 0.6
#: Pairs of a query and a posting that are scored in one pass; beyond it, bounds leave out most of them.
DIRECT_PAIRS = 1 << 33
#: Pairs a task scores in one pass, on average; so many it adds up at once.
TASK_PAIRS, STEP_PAIRS = 1 << 21, 1 << 20
#: Queries of a tile; chunks and postings of a pack. A task holds the scores of one tile by one pack.
QUERY_TILE, PACK_CHUNKS, PACK_POSTINGS = 1024, 4096, 1 << 18
_SLACK = 1e-8


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table (to the shared checkpoint folder unless a path is given) and read it again."""
    spark = df.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted_terms(text: Column | str) -> Column:
    """Distinct tokens with their counts as an array of (token, tf): runs of the sorted tokens, no exchange."""
    tokens = F.sort_array(tokenize(text))

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (s[i - 1] != s[i - 2]))
        return F.transform(
            F.arrays_zip(starts.alias("at"), F.concat(F.slice(starts, 2, F.size(starts)), F.array(n + 1)).alias("to")),
            lambda p: F.struct(s[p["at"] - 1].alias("token"), (p["to"] - p["at"]).alias("tf")),
        )

    empty = F.array().cast("array<struct<token:string,tf:int>>")
    return F.transform(F.array(tokens), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))[0]


@dataclass(frozen=True)
class LexicalIndex:
    """``forward``: chunk_id, block, dl, terms (token, tf), one row per chunk. ``n`` and ``avgdl`` are the corpus's."""

    forward: DataFrame
    n: int
    avgdl: float

    def postings(self) -> DataFrame:
        """token, chunk_id, block, tf, dl."""
        return self.forward.select("chunk_id", "block", "dl", F.explode("terms").alias("t")).select("t.token", "chunk_id", "block", "t.tf", "dl")

    def frequencies(self) -> DataFrame:
        """token, df, counted map-side: a common token costs one row per task."""
        return self.forward.select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def idf(self, df: Column) -> Column:
        return F.ln(1 + (self.n - df + 0.5) / (df + 0.5))

    def part(self, k1: float, b: float) -> Column:
        """What one occurrence list of a token adds to a chunk's score, before its idf."""
        return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.avgdl)))


def build_index(chunks: DataFrame, path: str | None = None) -> LexicalIndex:
    """Tokenise ``chunks`` (chunk_id, text) once and store the forward index at ``path`` (the shared scratch folder if none).

    Null texts have no tokens. An index of no chunks answers every query with nothing.
    """
    rows = chunks.select("chunk_id", counted_terms("text").alias("terms"))
    dl = F.aggregate("terms", F.lit(0), lambda a, t: a + t["tf"])
    return _opened(stored(rows.select("chunk_id", dl.alias("dl"), "terms"), path))


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index that ``build_index`` stored."""
    return _opened(spark.read.parquet(path))


def _opened(forward: DataFrame) -> LexicalIndex:
    one = forward.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1e-9)).alias("avgdl")).first()
    blocks = 1 + one.n // BLOCK_CHUNKS
    return LexicalIndex(forward.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks))), one.n, one.avgdl or 1e-9)


def inverted(index: LexicalIndex, path: str, buckets: int = 64) -> DataFrame:
    """The postings as a table partitioned by a bucket of their token, for queries that read only a few tokens.

    Within a bucket rows lie by token and block. A token of more than ``PIECE_POSTINGS``
    postings is dealt to several tasks by block.
    """
    pieces = index.frequencies().where(F.col("df") > PIECE_POSTINGS).select("token", F.ceil(F.col("df") / PIECE_POSTINGS).cast("int").alias("pieces"))
    dealt = index.postings().join(broadcast_if_small(pieces), "token", "left").withColumn(
        "piece", F.pmod(F.xxhash64("block"), F.coalesce("pieces", F.lit(1))).cast("int")
    ).drop("pieces")
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    laid = dealt.withColumn("bucket", bucket).repartition("token", "piece").sortWithinPartitions("bucket", "token", "block").drop("piece")
    laid.write.partitionBy("bucket").parquet(path)
    return index.forward.sparkSession.read.parquet(path)


def of_tokens(index: LexicalIndex, vocabulary: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Postings of the given distinct tokens; from an ``inverted`` table only their buckets are read."""
    rows = index.postings() if table is None else table
    if table is not None:
        buckets = table.select(F.max("bucket")).first()[0]
        if buckets is not None:
            asked = vocabulary.select(F.pmod(F.xxhash64("token"), F.lit(buckets + 1)).cast("int").alias("bucket")).distinct()
            rows = rows.join(F.broadcast(asked), "bucket", "left_semi")  # at most one row per bucket
    return rows.join(broadcast_if_small(vocabulary), "token", "left_semi").select("token", "chunk_id", "block", "tf", "dl")


def topk(
    index: LexicalIndex, terms: DataFrame, k: int, k1: float = fv.BM25_K1, b: float = fv.BM25_B, table: DataFrame | None = None, direct_pairs: int = DIRECT_PAIRS
) -> DataFrame:
    """Exact best ``k`` chunks of each query by BM25: query_id, chunk_id, score, rank.

    ``terms`` has each token of a query once (query_id, token). Ties go to the smaller
    chunk_id. Where queries and postings make no more than ``direct_pairs`` pairs,
    counted beforehand, all are scored in one pass; more are pruned by bounds. Both
    give the same rows.
    """
    vocabulary = terms.select("token").distinct()
    small = broadcast_if_small(vocabulary)
    df = index.frequencies().join(small, "token", "left_semi")
    weights = stored(terms.join(df, "token").select("query_id", "token", "df", index.idf(F.col("df")).alias("idf")))
    pairs, asking = weights.agg(F.coalesce(F.sum("df"), F.lit(0)), F.approx_count_distinct(F.coalesce(F.col("query_id").cast("string"), F.lit("")))).first()
    if pairs > direct_pairs:
        return _pruned(index, terms, k, k1, b, table)
    # a fixed number of tasks, by their work: few bytes of postings may meet many queries
    rows = of_tokens(index, vocabulary, table).select("chunk_id", "token", index.part(k1, b).alias("part"))
    dealt = rows.repartition(1 + pairs // TASK_PAIRS, "chunk_id").sortWithinPartitions("chunk_id")
    scored = _tiled_scores(dealt, weights.drop("df"), 1 + asking // QUERY_TILE, k)
    return _best(scored.select("query_id", "chunk_id", F.round("score", SCORE_DIGITS).alias("score")), "score", k)


def _packed(rows: DataFrame) -> DataFrame:
    """Postings sorted by chunk_id packed into rows of whole chunks: lists of chunk_id, token, part."""
    names = ["chunk_id", "token", "part"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def row(t: pa.Table) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(n).combine_chunks()) for n in names]
            return pa.RecordBatch.from_arrays(lists, names=names)

        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            codes = held.column("chunk_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            # dictionary codes follow the sorted ids; the last chunk may go on in the next batch
            begins = np.flatnonzero(np.diff(codes, prepend=-1))
            at = 0
            while begins[-1] - at >= PACK_POSTINGS or codes[begins[-1]] - codes[at] >= PACK_CHUNKS:
                ends = begins[(begins > at) & (begins - at <= PACK_POSTINGS) & (codes[begins] - codes[at] <= PACK_CHUNKS)]
                to = int(ends[-1]) if len(ends) else int(begins[begins > at][0])
                yield row(held.slice(at, to - at))
                at = to
            held = held.slice(at)
            if len(codes) - begins[-1] > PACK_POSTINGS:
                # a chunk_id of so many rows: its sums per token stand for them
                held = held.group_by(["chunk_id", "token"], use_threads=False).aggregate([("part", "sum")]).rename_columns(names)
        if held is not None and held.num_rows:
            yield row(held)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*names).mapInArrow(pack, ", ".join(f"{n} array<{kinds[n]}>" for n in names))


def _tiled_scores(rows: DataFrame, weights: DataFrame, tiles: int, k: int) -> DataFrame:
    """Scores of query_id and chunk_id that can be among the best ``k`` of a query, with all that tie.

    ``rows`` (chunk_id, token, part) holds each chunk in one partition, sorted by chunk_id.
    Chunks are packed where they are; tiles of queries are broadcast behind their measured
    size, else joined with the packs by a group number.
    """
    asked = weights.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(tiles)).alias("tile")).agg(F.collect_list(F.struct("query_id", "token", "idf")).alias("asked"))
    small = payload_bytes(weights) <= BROADCAST_LIMIT_BYTES
    groups = 1 if small else rows.sparkSession.sparkContext.defaultParallelism
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("tile")
    packs = _packed(rows).withColumn("group", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query, word, idf = batch.column("asked")[i].values.flatten()
                queries = query.dictionary_encode(null_encoding="encode")
                chunks = batch.column("chunk_id")[i].values.dictionary_encode(null_encoding="encode")
                words = word.dictionary_encode()
                # the weights in the order of their words: those of word w lie from first[w] to first[w + 1]
                code = words.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                first = np.searchsorted(code[order], np.arange(len(words.dictionary) + 1))
                asker, idf = queries.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), idf.to_numpy(zero_copy_only=False)[order]
                met = pc.fill_null(pc.index_in(batch.column("token")[i].values, value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(met >= 0)
                met, part = met[hit], batch.column("part")[i].values.to_numpy(zero_copy_only=False)[hit]
                chunk = chunks.indices.to_numpy(zero_copy_only=False)[hit].astype(np.int64)
                times = first[met + 1] - first[met]
                upto = np.concatenate([[0], np.cumsum(times)])
                width = len(queries.dictionary)
                scores = np.zeros((len(chunks.dictionary), width))
                at = 0
                while at < len(hit):
                    to = max(at + 1, int(np.searchsorted(upto, upto[at] + STEP_PAIRS, side="right")) - 1)
                    n = times[at:to]
                    posting = np.repeat(np.arange(at, to), n)
                    place = np.arange(len(posting)) - np.repeat(upto[at:to] - upto[at], n) + first[met[posting]]
                    low, high = chunk[at], chunk[to - 1] + 1  # the chunks of a pack are in order
                    sums = np.bincount((chunk[posting] - low) * width + asker[place], weights=idf[place] * part[posting], minlength=(high - low) * width)
                    scores[low:high] += sums.reshape(-1, width)
                    at = to
                scores = np.ascontiguousarray(scores.T)
                kth = max(0, scores.shape[1] - k)
                floor = np.partition(scores, kth, axis=1)[:, kth] - 10.0**-SCORE_DIGITS * 2
                who, which = np.nonzero((scores >= floor[:, None]) & (scores > 0))
                yield pa.RecordBatch.from_arrays([queries.dictionary.take(pa.array(who)), chunks.dictionary.take(pa.array(which)), pa.array(scores[who, which])], names=["query_id", "chunk_id", "score"])

    met = packs.join(F.broadcast(asked) if small else asked, "group").select("asked", "chunk_id", "token", "part")
    kinds = [(n, df.schema[n].dataType.simpleString()) for n, df in (("query_id", weights), ("chunk_id", rows))]
    return met.mapInArrow(kernel, ", ".join(f"{n} {t}" for n, t in kinds) + ", score double")


def _pruned(index: LexicalIndex, terms: DataFrame, k: int, k1: float, b: float, table: DataFrame | None) -> DataFrame:
    rows = stored(of_tokens(index, terms.select("token").distinct(), table).select("token", "chunk_id", "block", index.part(k1, b).alias("part")))
    bounds = stored(rows.groupBy("token", "block").agg(F.max("part").alias("most"), F.count(F.lit(1)).alias("n")))
    known = bounds.groupBy("token").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    weights = terms.join(known, "token").select("query_id", "token", index.idf(F.col("df")).alias("idf"), "most")
    reach = F.col("idf") * F.col("most")
    whole = Window.partitionBy("query_id")
    weakest_first = whole.orderBy(reach.asc(), "token").rowsBetween(Window.unboundedPreceding, 0)
    # ``upto``: the most that a chunk can gain from this and all weaker terms
    weights = stored(weights.select("query_id", "token", "idf", F.sum(reach).over(weakest_first).alias("upto"), F.sum(reach).over(whole).alias("all")))
    gain = F.sum(F.col("idf") * F.col("part"))
    # measured once: parts of ``weights`` are smaller, and seeds are at most k rows a query
    size = payload_bytes(weights)

    def side(df: DataFrame, bound: int = size) -> DataFrame:
        return F.broadcast(df) if bound <= BROADCAST_LIMIT_BYTES else df

    by_chunk = rows.repartition("chunk_id")  # then no sum of a pair of query and chunk is exchanged
    terms_of = side(weights.select("query_id", "token", "idf"))

    # a floor: k chunks that the strongest terms like best, scored in full
    strong = side(weights.where(F.col("upto") > SEED_SHARE * F.col("all")).select("query_id", "token", "idf"))
    liked = by_chunk.join(strong, "token").groupBy("query_id", "chunk_id").agg(gain.alias("gained"))
    seeds = stored(_best(liked, "gained", k).select("query_id", "chunk_id"))
    near = rows.join(side(seeds.select("chunk_id").distinct(), k * size), "chunk_id", "left_semi").join(terms_of, "token")
    full = near.join(side(seeds, k * size), ["query_id", "chunk_id"], "left_semi").groupBy("query_id", "chunk_id").agg(gain.alias("score"))
    floor = full.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0.0).alias("floor"))
    ranked = stored(weights.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - _SLACK))

    # terms that all together stay under the floor find no chunk by themselves
    finding = F.col("upto") >= F.col("floor")
    essential = side(ranked.where(finding).select("query_id", "token", "idf"))
    weak = side(ranked.where(~finding).select("query_id", "token", "idf"))
    tail = bounds.select("token", "block", "most").join(weak, "token").groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("tail"))
    floors = side(ranked.select("query_id", "floor").distinct())
    partial = by_chunk.join(essential, "token").groupBy("query_id", "chunk_id", "block").agg(gain.alias("partial"))
    alive = partial.join(floors, "query_id").join(broadcast_if_small(stored(tail)), ["query_id", "block"], "left")
    alive = stored(alive.where(F.col("partial") + F.coalesce("tail", F.lit(0.0)) >= F.col("floor")).select("query_id", "chunk_id", "partial"))

    # the weak terms of the pairs that are still open
    open_chunks = broadcast_if_small(alive.select("chunk_id").distinct())
    open_rows = rows.join(side(ranked.where(~finding).select("token").distinct()), "token", "left_semi").join(open_chunks, "chunk_id", "left_semi")
    added = alive.select("query_id", "chunk_id").join(weak, "query_id").join(open_rows.select("token", "chunk_id", "part"), ["token", "chunk_id"])
    added = added.groupBy("query_id", "chunk_id").agg(gain.alias("added"))
    score = F.round(F.col("partial") + F.coalesce("added", F.lit(0.0)), SCORE_DIGITS)
    return _best(alive.join(added, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", score.alias("score")), "score", k)


def _best(scored: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(by), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", by, "rank")
