"""Long repeats by recompression.

Words are symbols. A round names runs of one symbol, then pairs of neighbours whose
symbols fall on the two sides of a fixed split; names are hashes of what they stand
for, so equal passages anywhere in the corpus get equal names inside. A symbol is
certain within a window of words if no word outside the window had a say in it. Spark
counts the symbols of all documents; a window that holds a certain symbol seen once
cannot repeat, and the few windows left are compared whole, by 128-bit names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import mixed, text_bytes, word_names, word_spans

WINDOW = 20
ROUNDS, LONGEST = 5, 5
GROUP_WORDS = 80_000
#: Text bytes per block of documents, and per part of the symbols and windows that meet in one task.
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
_NO_ID = np.iinfo(np.int64).max
_PAIR, _RUN = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)
_ROLL = np.uint64(0x9FB21C651E98DF25)


def recompress(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``ROUNDS`` rounds over all texts at once: name, and the first and last (exclusive) word that had a say in it.

    ``first`` holds where each text's words begin. No symbol spans two texts, and
    one that touches a text's edge had the edge as a say: its range reaches one
    word beyond. Symbols of ``LONGEST`` words or more are left as they are.
    """
    n = len(words)
    name, start, end = words, np.arange(n), np.arange(1, n + 1)
    low, high = start, end
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    for k in range(ROUNDS):
        if len(name) < 2:
            break
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & ~opens[start[1:]]
        if same.any():  # runs of one symbol get one name
            head = np.flatnonzero(~same)
            size = np.diff(np.append(head, len(name)))
            low, high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
            start, end, name = start[head], end[head + size - 1], name[head]
            runs = np.flatnonzero(size > 1)
            name[runs] = mixed(name[runs] * _RUN + size[runs].astype(np.uint64))
        # an unlike word beside a symbol settles that its run ends there; else the neighbour's whole range has a say
        side_low, side_high = np.minimum(low, start - 1), np.maximum(high, end + 1)
        outer, inner = words[end - 1], words[start]
        i = 1 + np.flatnonzero((outer[1:] == outer[:-1]) & ~opens[start[1:]])
        side_low[i] = np.minimum(side_low[i], low[i - 1])
        i = np.flatnonzero((inner[1:] == inner[:-1]) & ~opens[start[1:]])
        side_high[i] = np.maximum(side_high[i], high[i + 1])
        # pairs of a left-hand and a right-hand symbol; a name's bit tells its hand in this round
        hand = (name >> np.uint64(k + 7)) & np.uint64(1) == 1
        whole = end - start >= LONGEST
        left, right = ~hand & ~whole, hand & ~whole
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & right[1:] & ~opens[start[1:]]
        taken = np.zeros(len(name), bool)
        taken[1:] = pair[:-1]
        # a symbol left alone depends on the neighbour it might have paired with
        low, high = side_low.copy(), side_high.copy()
        i = np.flatnonzero(left & ~pair & ~opens[end])
        high[i] = np.maximum(high[i], side_high[i + 1])
        i = np.flatnonzero(right & ~taken & ~opens[start])
        low[i] = np.minimum(low[i], side_low[i - 1])
        p = np.flatnonzero(pair)
        name = name.copy()
        name[p] = mixed(mixed(name[p] * _PAIR) + name[p + 1])
        low[p] = np.minimum(side_low[p], side_low[p + 1])
        high[p] = np.maximum(side_high[p], side_high[p + 1])
        end = end.copy()
        end[p] = end[p + 1]
        keep = ~taken
        name, start, end, low, high = name[keep], start[keep], end[keep], low[keep], high[keep]
    return name, low, high


def window_names(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of every run of ``length`` words."""
    n = max(0, len(words) - length + 1)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    other = mixed(words ^ _RUN)
    for k in range(length):
        one = one * _ROLL + words[k : k + n]
        two = two * _PAIR + other[k : k + n]
    return mixed(one), mixed(two)


class Block:
    """The words of a block of texts, and the symbols that are certain within some window."""

    def __init__(self, texts: pa.Array):
        self.data, at = text_bytes(texts)
        self.starts, self.ends, self.first = word_spans(self.data, at)
        self.words = word_names(self.data, self.starts, self.ends)
        self.row_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        found = []
        cuts = np.unique([0, *np.searchsorted(self.first, np.arange(GROUP_WORDS, len(self.words), GROUP_WORDS)), len(texts)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # groups of texts that fit a processor's cache
            base = self.first[a]
            name, low, high = recompress(self.words[base : self.first[b]], self.first[a : b + 1] - base)
            found.append((name, low + base, high + base))
        name, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (self.words, self.first[:0], self.first[:0])
        fits = np.flatnonzero((high - low <= WINDOW) & (low >= 0) & (high <= len(self.words)))
        fits = fits[self.row_of[low[fits]] == self.row_of[high[fits] - 1]]
        self.name, self.low, self.high = name[fits], low[fits], high[fits]

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct certain symbols, ascending, and whether the block has each more than once."""
        names, counts = np.unique(self.name, return_counts=True)
        return names, counts > 1

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """First words of the windows that hold no certain symbol seen once in the corpus."""
        names, _ = self.symbols()
        once = ~repeated[np.searchsorted(names, self.name)]
        low, high = self.low[once], self.high[once]
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, np.maximum(high - WINDOW, self.first[self.row_of[low]]), 1)
        np.add.at(change, low + 1, -1)
        free = np.cumsum(change[:-1]) == 0
        room = np.zeros(len(self.words), bool)
        n = max(0, len(self.words) - WINDOW + 1)
        room[:n] = self.row_of[:n] == self.row_of[WINDOW - 1 : WINDOW - 1 + n]
        return np.flatnonzero(free & room)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit names of the windows that begin at ``at``."""
        one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            word = self.words[at + k]
            one = one * _ROLL + word
            two = two * _PAIR + (word ^ (word >> np.uint64(29))) * _RUN
        return mixed(one), mixed(two)

    def covered(self, at: np.ndarray) -> np.ndarray:
        """The words inside windows that begin at ``at``."""
        change = np.zeros(len(self.words) + 1, np.int64)
        change[at] += 1
        np.add.at(change, at + WINDOW, -1)
        return np.cumsum(change[:-1]) > 0

    def kept(self, gone: np.ndarray) -> tuple[list[int], list[str]]:
        """Per text: words removed, and the checksum of those that stay, joined by one space."""
        removed, sums = [], []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            at = a + np.flatnonzero(~gone[a:b])
            digest = hashlib.sha256()
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                words = [self.data[s:e].tobytes() for s, e in zip(self.starts[part].tolist(), self.ends[part].tolist(), strict=True)]
                digest.update((b" " if k else b"") + b" ".join(words))
            removed.append(b - a - len(at))
            sums.append(digest.hexdigest())
        return removed, sums


def ranges(names: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, last) of ascending names by their leading ``bits``, empty parts left out."""
    part = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(names)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(part[a]), a, b


def _numbers(column: pa.ChunkedArray, kind=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _bits(column: pa.ChunkedArray, sizes: list[int]) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(column.to_pylist(), sizes, strict=True)]


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


_ANSWER = "block int, kind int, part int, size int, flags binary"


def _answers(table: pa.Table, kind: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    """One row per sending block: a bit for each name it sent, in the order it sent them."""
    cuts = np.cumsum([0, *sizes])
    n = table.num_rows
    return pa.table({
        "block": table.column("block").combine_chunks(), "kind": pa.array([kind] * n, pa.int32()), "part": table.column("part").combine_chunks(),
        "size": pa.array(sizes, pa.int32()), "flags": pa.array([_packed(flags[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
    })


def _seen_again(table: pa.Table) -> pa.Table:
    """Which symbols of a part stand more than once in the corpus."""
    names = _numbers(table.column("names"))
    sizes = [len(x) for x in names]
    weight = 1 + np.concatenate(_bits(table.column("more"), sizes))
    _, at = np.unique(np.concatenate(names), return_inverse=True)
    return _answers(table, 0, np.bincount(at, weights=weight)[at] > 1, sizes)


def _groups(one: np.ndarray, two: np.ndarray, then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the two names and then the last of ``then`` first, and where in it a new pair of names begins."""
    order = np.lexsort((*then, two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    return order, fresh


def _earliest(table: pa.Table) -> pa.Table:
    """For which windows of a part the sending block has the smallest doc_id of the corpus."""
    one, two, docs = (_numbers(table.column(c), k) for c, k in (("one", np.uint64), ("two", np.uint64), ("docs", np.int64)))
    sizes = [len(x) for x in one]
    one, two, docs = np.concatenate(one), np.concatenate(two), np.concatenate(docs)
    order, fresh = _groups(one, two, (docs,))
    least = docs[order[np.flatnonzero(fresh)]][np.cumsum(fresh) - 1]
    flags = np.zeros(len(docs), bool)
    flags[order] = docs[order] == least
    return _answers(table, 1, flags, sizes)


def _flags(answers: pa.Table, kind: int) -> np.ndarray:
    """All bits of a block's answers, in the order of the names it sent."""
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
    parts = [np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["size"]).astype(bool) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


class _Windows:
    """The candidate windows of a block, grouped by their words."""

    def __init__(self, table: pa.Table, answers: pa.Table):
        self.block = Block(table.column("text").combine_chunks())
        self.docs = table.column("doc_id").combine_chunks().fill_null(_NO_ID).to_numpy()
        self.at = self.block.candidates(_flags(answers, 0))
        self.one, self.two = self.block.windows(self.at)
        self.row = self.block.row_of[self.at]
        self.order, self.fresh = _groups(self.one, self.two, (self.at, self.row, self.docs[self.row]))


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``, whole texts.

    A word is removed if it lies in a window of ``WINDOW`` consecutive words whose
    sequence also starts earlier: in a row of smaller doc_id, or earlier in the same
    row. Rows of one doc_id are not earlier than each other; null doc_ids come after
    all others. doc_id is a whole number. Null and empty texts have no words and the
    checksum of no bytes. Other columns are ignored; an empty table gives no rows.

    Texts are dealt once, to blocks of about ``BLOCK_BYTES``, by doc_id and text;
    three steps read that one exchange. Each block sends its distinct symbols (then
    its distinct candidate windows) as packed numbers to the part their leading bits
    name, and gets back one bit for each. However often a passage occurs, a block
    sends it once, so no passage fills a part; parts and blocks grow in number with
    the input, not in size.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, bits = 1 + total // BLOCK_BYTES, max(3, int(total // PART_BYTES).bit_length())
    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def send_symbols(table: pa.Table) -> pa.Table:
        names, more = Block(table.column("text").combine_chunks()).symbols()
        rows = list(ranges(names, bits))
        return pa.table({
            "part": pa.array([p for p, _, _ in rows], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()),
            "names": pa.array([names[a:b].tobytes() for _, a, b in rows], pa.binary()), "more": pa.array([_packed(more[a:b]) for _, a, b in rows], pa.binary()),
        })

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("part", pa.int32()), ("block", pa.int32()), ("one", pa.binary()), ("two", pa.binary()), ("docs", pa.binary()))})
        w = _Windows(table, answers)
        first = w.order[w.fresh]
        one, two, ids = w.one[first], w.two[first], w.docs[w.row[first]]
        rows = list(ranges(one, bits))
        return pa.table({
            "part": pa.array([p for p, _, _ in rows], pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()),
            **{c: pa.array([x[a:b].tobytes() for _, a, b in rows], pa.binary()) for c, x in (("one", one), ("two", two), ("docs", ids))},
        })

    def strike(table: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Windows(table, answers)
        group = np.cumsum(w.fresh) - 1
        row, ids = w.row[w.order], w.docs[w.row[w.order]]
        first_in_row = w.fresh.copy()
        first_in_row[1:] |= row[1:] != row[:-1]
        own = ids == ids[np.flatnonzero(w.fresh)][group] if len(group) else np.zeros(0, bool)
        stays = first_in_row & own & (_flags(answers, 1)[group] if len(group) else own)
        removed, sums = w.block.kept(w.block.covered(w.at[w.order[~stays]]))
        return pa.table({
            "doc_id": table.column("doc_id").combine_chunks(), "n_words": pa.array(np.diff(w.block.first)),
            "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string()),
        })

    by_block = placed.groupBy("block")
    symbols = by_block.applyInArrow(send_symbols, "part int, block int, names binary, more binary")
    repeated = symbols.groupBy("part").applyInArrow(_seen_again, _ANSWER)
    windows = by_block.cogroup(repeated.groupBy("block")).applyInArrow(send_windows, "part int, block int, one binary, two binary, docs binary")
    earliest = windows.groupBy("part").applyInArrow(_earliest, _ANSWER)
    return by_block.cogroup(repeated.unionByName(earliest).groupBy("block")).applyInArrow(
        strike, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )
