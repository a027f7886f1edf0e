"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words in a short window and ignore the others. The
masked hashes of all document windows are joined with those of the benchmark; around
every hit the document and the item are compared word by word on that alignment,
so passages with substituted words are found and chance hits are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.common import PUNCTUATION, mixed, named_words, slices, whole_texts

#: 1: the word counts, 0: any word. With one word in five substituted, 15 words practically always keep one of them whole.
MASKS = ("110111", "1011011", "101010101")
#: A stretch is an overlap with this many equal words (or all an item of fewer words allows), at least so large a share of it equal.
MIN_WORDS, SHARE = 13, 0.8
#: Benchmark words per block: about 100 bytes of index each. A larger benchmark is handled in several blocks, one pass each.
BLOCK_WORDS = 400_000

_PICKS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
_TIMES = np.random.default_rng(7).integers(0, 2**62, 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_GATE_BITS = 22


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the masked words at every position where the mask fits."""
    picks = _PICKS[mask]
    n = max(0, len(words) - int(picks[-1]))
    total = np.full(n, mask + 1, np.uint64)
    for k, p in enumerate(picks):
        total += words[p : p + n] * _TIMES[k]
    return mixed(total)


@dataclass
class Index:
    """Seeds of a block of the benchmark, ordered by hash, and the items' words."""

    items: list
    words: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    gate: np.ndarray
    short: dict[int, list[tuple[int, np.ndarray]]]


def build_index(rows: list[tuple[object, str | None]]) -> Index:
    """Index of (item_id, text) rows. Items shorter than a mask are kept by their first word and compared whole."""
    names, first = named_words(pc.utf8_lower(pa.array([t or "" for _, t in rows], pa.string())), between=PUNCTUATION)
    words = [names[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    hashes, item, place = [], [], []
    short: dict[int, list[tuple[int, np.ndarray]]] = {}
    least = max(len(m) for m in MASKS)
    for i, w in enumerate(words):
        if 0 < len(w) < least:
            short.setdefault(int(w[0]), []).append((i, w))
            continue
        for m in range(len(MASKS)):
            h = seed_hashes(w, m)
            hashes.append(h)
            item.append(np.full(len(h), i))
            place.append(np.arange(len(h)))
    joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (item, np.int64), (place, np.int64))]
    order = np.argsort(joined[0], kind="stable")
    gate = np.zeros(1 << _GATE_BITS, bool)
    gate[joined[0] >> np.uint64(64 - _GATE_BITS)] = True
    return Index([r[0] for r in rows], words, *(x[order] for x in joined), gate, short)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the stretch with most of them, at least ``SHARE`` of it equal."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0 - SHARE, -SHARE))))
    count = np.concatenate(([0], np.cumsum(equal)))
    low = np.minimum.accumulate(sums)
    start = np.minimum(np.searchsorted(-low, -sums - 1e-9), np.arange(len(sums)))  # the earliest from which the sum is not negative
    end = int(np.argmax(count - count[start]))
    first = int(start[end])
    n = int(count[end] - count[first])
    return (first + int(np.argmax(equal[first:end])), end, n) if n else (0, 0, 0)


def needed(length: int) -> int:
    return min(MIN_WORDS, int(np.ceil(SHARE * length - 1e-9)))


def overlaps(texts: pa.Array, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """Overlaps in a slice: (row, item, first document word, first item word, length, equal words), the best of each row and item."""
    names, first = named_words(pc.utf8_lower(texts.fill_null("")), between=PUNCTUATION)
    keys = []
    for m in range(len(MASKS)):
        h = seed_hashes(names, m)
        at = np.flatnonzero(index.gate[h >> np.uint64(64 - _GATE_BITS)])
        left, right = (np.searchsorted(index.hashes, h[at], side=s) for s in ("left", "right"))
        many = right - left
        at, left, many = at[many > 0], left[many > 0], many[many > 0]
        if len(at):
            entry = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            row = np.searchsorted(first, at, side="right") - 1
            keys.append(np.stack([row, index.item[entry], at - index.place[entry]], axis=1))
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for row, item, shift in np.unique(np.concatenate(keys), axis=0).tolist() if keys else []:
        words = index.words[item]
        a, b = max(first[row], shift), min(first[row + 1], shift + len(words))
        if b <= a:
            continue
        start, end, equal = best_stretch(names[a:b] == words[a - shift : b - shift])
        if equal >= needed(len(words)) and equal > found.get((row, item), (0,) * 5)[4]:
            found[row, item] = (int(a + start - first[row]), int(a + start - shift), end - start, 0, equal)
    out = [(r, i, s, p, n, e) for (r, i), (s, p, n, _, e) in sorted(found.items())]
    if index.short:
        for at in np.flatnonzero(np.isin(names, np.fromiter(index.short, np.uint64))).tolist():
            row = int(np.searchsorted(first, at, side="right")) - 1
            for item, words in index.short[int(names[at])]:
                if at + len(words) <= first[row + 1] and (names[at : at + len(words)] == words).all() and (row, item) not in found:
                    found[row, item] = ()
                    out.append((row, item, int(at - first[row]), 0, len(words), len(words)))
    return out


def benchmark_blocks(bench: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's distinct rows in blocks of at most ``BLOCK_WORDS`` words (a longer item is a block of its own)."""
    block, size = [], 0
    for r in bench.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        n = len(r.text.split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def find_overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_equal: the best overlap of every document and benchmark item that have one.

    Words are runs of letters and digits, lower-cased; places are counted in words
    from 0. An overlap is an aligned stretch with at least ``MIN_WORDS`` equal words
    (for an item of fewer words, 80 per cent of it), and at least 80 per cent of
    the stretch equal. Items under the longest mask must occur whole. Null and empty
    texts overlap nothing; repeated documents and items under several ids are
    reported each; other columns are ignored; empty tables give no rows. Nothing is
    shuffled, so neither a common passage nor a long document can fill a task.
    """
    whole_texts(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    ids = [docs.schema["doc_id"], T.StructField("item_id", bench.schema["item_id"].dataType)]
    schema = T.StructType([*ids, *(T.StructField(c, T.IntegerType()) for c in ("doc_word", "item_word", "n_words", "n_equal"))])
    out = docs.sparkSession.createDataFrame([], schema)
    kind = pa.int64() if isinstance(ids[1].dataType, T.LongType) else None
    for block in benchmark_blocks(bench):
        index = docs.sparkSession.sparkContext.broadcast(build_index(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    hits = overlaps(part.column("text"), index.value)
                    rows = pa.array([h[0] for h in hits], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(rows), pa.array([index.value.items[h[1]] for h in hits], kind), *(pa.array([h[k] for h in hits], pa.int32()) for k in range(2, 6))],
                        names=schema.names,
                    )

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def without_overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs``, whole rows and all columns, without the documents that overlap a benchmark item (see ``find_overlaps``)."""
    whole_texts(docs.sparkSession)
    for block in benchmark_blocks(bench):
        index = docs.sparkSession.sparkContext.broadcast(build_index(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[h[0] for h in overlaps(part.column("text"), index.value)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
