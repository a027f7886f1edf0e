"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter changes a word's letter counts by one or
two, so the squared distance of two near words' counts is 1 or 2. Letters are dealt
into ``GROUPS`` groups; words with the same number of letters of each group form a
block (its words have one length). A near word lies in the same block or in one
that differs by one letter more, or by one letter moved between two groups: a word
visits those adjacent blocks, and there one product of count matrices gives all
squared distances. Pairs within the distance are confirmed letter by letter. Large
blocks are cut in tiles, so that no task holds more than one tile by one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scale import broadcast_if_small
from shelfmark.llm.common import written

#: Letters of a word: ASCII letters and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
GROUPS = 6
HOME_TILE, GUEST_TILE = 1024, 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODES = 256
_GROUP = np.arange(_CODES) % GROUPS
#: A block is named by a linear hash of its counts per group, so the name of an adjacent block is a sum.
_WEIGHT = np.random.default_rng(20240613).integers(1, 1 << 62, GROUPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A guest's counts less its host's: the same, one letter of group g more, or one of g more and one of a later group h less.
_STEPS = np.array([
    [0] * GROUPS,
    *[[int(k == g) for k in range(GROUPS)] for g in range(GROUPS)],
    *[[int(k == g) - int(k == h) for k in range(GROUPS)] for g in range(GROUPS) for h in range(g + 1, GROUPS)],
])
_STEP_NAMES = (_STEPS.astype(np.int64).view(np.uint64) * _WEIGHT).sum(axis=1, dtype=np.uint64)
assert len(set(_STEP_NAMES.tolist())) == len(_STEPS)
_AT_ONCE = 1 << 22


def misspelt(run: Column, key: Column) -> Column:
    """The run without one letter where 31 divides the CRC-32 of ``key:run`` (a null key is empty), else the run."""
    h = F.crc32(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), run))
    k = (h % F.char_length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the distinct words of at least seven letters that occur at least twice in whole ``text``.

    Words are the maximal letter runs, A to Z lower-cased, as ``misspelt`` leaves them;
    null texts have none. Repeated rows count as often as they stand.
    """
    # an outer generator: an inner one would have the runs searched once more, to filter texts without any
    runs = docs.select(F.col(key).alias("key"), F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.where(F.col("run").isNotNull())
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    words = runs.select("key", low.alias("run")).select(misspelt(F.col("run"), F.col("key")).alias("word"))
    kept = words.where(F.char_length("word") >= LEAST_LENGTH)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as bytes (code points up to 255), and the offset of each word."""
    at = np.zeros(len(words) + 1, np.int64)
    texts = words.to_pylist()
    np.cumsum([len(w) for w in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8), at


def _counts(codes: np.ndarray, at: np.ndarray, bins: np.ndarray, width: int) -> np.ndarray:
    """A row per word: how often each bin of ``bins`` occurs in it."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(row * width + bins[codes], minlength=(len(at) - 1) * width).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the word's own block and the blocks it visits (those to which it would be the adjacent one)."""
    for batch in batches:
        codes, at = _letters(batch.column("word"))
        held = _counts(codes, at, _GROUP, GROUPS)
        name = (held.astype(np.uint64) * _WEIGHT).sum(axis=1, dtype=np.uint64)
        there = (held[:, None, :] >= _STEPS[None, :, :]).all(2)  # no block has fewer than no letters of a group
        targets = (name[:, None] - _STEP_NAMES[None, :])[there].view(np.int64)
        ends = np.concatenate(([0], np.cumsum(there.sum(1)))).astype(np.int32)
        visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(targets))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name.view(np.int64)), visits], names=[*batch.schema.names, "block", "visits"])


def _distance_pairs(home: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose counts lie at a squared distance of at most two, by one matrix product."""
    exact = np.float32 if max(int((home**2).sum(1).max()), int((guest**2).sum(1).max())) < 1 << 23 else np.float64
    a, b = home.astype(exact), guest.astype(exact)
    gram = a @ b.T
    gram *= -2
    gram += (a**2).sum(1)[:, None]
    gram += (b**2).sum(1)[None, :]
    return np.nonzero(gram <= 2)


def _one_edit(codes_a, at_a, codes_b, at_b, i, j) -> np.ndarray:
    """Which pairs (word i of a, word j of b, as long or one letter longer) are exactly one edit apart."""
    out = np.zeros(len(i), bool)
    size = (at_a[1:] - at_a[:-1])[i]
    longer = (at_b[1:] - at_b[:-1])[j] - size
    for n in np.unique(size).tolist():
        here = np.flatnonzero(size == n)
        step = max(1, _AT_ONCE // n)
        for k in range(0, len(here), step):
            rows = here[k : k + step]
            a = codes_a[at_a[i[rows]][:, None] + np.arange(n)]
            start = at_b[j[rows]]
            same = longer[rows] == 0
            wrong = a != codes_b[start[:, None] + np.arange(n)]
            swap = same & (wrong.sum(1) == 1)
            plus = np.flatnonzero(longer[rows] == 1)
            if len(plus):
                # after the first difference the rest of a must stand one place later in b
                head = wrong[plus]
                first = np.where(head.any(1), head.argmax(1), n)
                late = (a[plus] != codes_b[start[plus][:, None] + np.arange(1, n + 1)]) & (np.arange(n) >= first[:, None])
                swap[plus] = ~late.any(1)
            out[rows] = swap
    return out


def _near(home: pa.Table, guest: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a home tile and a guest tile that are one edit apart, each pair of words in one direction only."""
    codes_a, at_a = _letters(home.column("word").combine_chunks())
    codes_b, at_b = _letters(guest.column("word").combine_chunks())
    used, place = np.unique(np.concatenate([codes_a, codes_b]), return_inverse=True)
    bins = np.zeros(_CODES, np.int64)
    bins[used] = np.arange(len(used))
    count_a, count_b = _counts(codes_a, at_a, bins, len(used)), _counts(codes_b, at_b, bins, len(used))
    i, j = _distance_pairs(count_a, count_b)
    longer = np.diff(at_b)[j] - np.diff(at_a)[i]
    keep = (longer == 0) | (longer == 1)
    i, j, longer = i[keep], j[keep], longer[keep]
    ok = _one_edit(codes_a, at_a, codes_b, at_b, i, j)
    i, j, longer = i[ok], j[ok], longer[ok]
    # a replaced letter: the pair is taken where the guest's letter is of the lower group, within a group where the guest is the greater word
    moved = (count_b[j] - count_a[i]).astype(np.int8) if len(i) else np.zeros((0, max(1, len(used))), np.int8)
    group_of = _GROUP[used] if len(used) else np.zeros(1, np.int64)
    gained, lost = group_of[moved.argmax(1)], group_of[moved.argmin(1)]
    words_a, words_b = home.column("word").to_pylist(), guest.column("word").to_pylist()
    greater = np.array([words_b[q] > words_a[p] for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
    take = (longer == 1) | (gained < lost) | ((gained == lost) & greater)
    return i[take], j[take]


_PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _pairs_of_tile(tile: pa.Table) -> pa.Table:
    is_home = tile.column("home")
    home, guest = tile.filter(is_home), tile.filter(pc.invert(is_home))
    if not (home.num_rows and guest.num_rows):
        return _PAIRS.empty_table()
    i, j = _near(home, guest)
    a, b = home.take(pa.array(i)), guest.take(pa.array(j))
    return pa.Table.from_arrays([a.column("word"), a.column("n"), b.column("word"), b.column("n")], schema=_PAIRS)


def near_pairs(words: DataFrame, home_tile: int = HOME_TILE, guest_tile: int = GUEST_TILE) -> DataFrame:
    """word, n, near, near_n: every pair of ``words`` (word, n; distinct words) one edit apart, once.

    Words of any length with letters up to U+00FF; no words, no pairs. The tiles bound
    what a task holds, not the result.
    """
    placed = written(words.select("word", "n").mapInArrow(_blocks, "word string, n bigint, block bigint, visits array<bigint>"))
    homes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("homes"))
    calls = placed.select(F.explode("visits").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("guests"))
    tiles = written(homes.join(calls, "block").select(
        "block", F.ceil(F.col("homes") / home_tile).cast("int").alias("rows"), F.ceil(F.col("guests") / guest_tile).cast("int").alias("cols")
    ))
    tiles, deal = broadcast_if_small(tiles), F.xxhash64("word")
    home = placed.select("word", "n", "block").join(tiles, "block").select(
        "block", F.pmod(deal, "rows").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(True).alias("home"), "word", "n"
    )
    guest = placed.select("word", "n", F.explode("visits").alias("block")).join(tiles, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(deal, "cols").cast("int").alias("col"), F.lit(False).alias("home"), "word", "n"
    )
    return home.unionByName(guest).groupBy("block", "row", "col").applyInArrow(_pairs_of_tile, "word string, n bigint, near string, near_n bigint")


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n; distinct words).

    form: the near word of largest n (ties: the smallest), where that n is at least
    ``ratio`` (2 or more) times the word's own, else null. root: the last word reached
    by following forms. No words, no rows.
    """
    words = written(words.select("word", "n"))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    found = written(both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select(
        "word", "n_near", *[F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col(f"best.{c}")).alias(o) for c, o in (("near", "form"), ("near_n", "form_n"))]
    ))
    # each step multiplies n by two or more, so a chain of a 64-bit count has under 64 steps: six doublings reach every end
    jumps = written(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    for _ in range(6):
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumps = written(jumps.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return words.join(found, "word", "left").join(jumps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )
