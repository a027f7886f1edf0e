"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

The words of a block of documents are laid out once, as bytes. An inverted index
leads from each merge to the positions where its pair stands; merges are replayed
over the whole block in rank order, and each touches only its neighbours, whose
new pairs enter the index. Blocks are slices of Spark partitions: no row is
shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.common import slices, whole_texts

#: Words of one generation of a worker's store. When it is full it becomes the older one, and words met again move on; ids stay the same.
REMEMBERED_WORDS = 100_000
#: Text bytes laid out at a time.
LAID_OUT_BYTES = 1 << 19
#: White space as Unicode has it, which is what the pattern's ``\s`` means.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def word_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern, with white space spelled out."""
    spelled = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    return regex.compile(spelled)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a rank file (base64 token, rank)."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Replay:
    """Merge replay over lists of words; built from the tokens in rank order."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.merge: dict[int, int] = {}
        for token, rank in self.rank.items():
            for k in range(1, len(token)):
                left, right = self.rank.get(token[:k]), self.rank.get(token[k:])
                if left is not None and right is not None:
                    self.merge[left << 32 | right] = rank
        none = np.iinfo(np.int64).max
        self.pairs = np.array([*sorted(self.merge), none], np.int64)
        self.ranks = np.array([self.merge.get(p, none) for p in self.pairs.tolist()], np.int64)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers. A word that is a token is that token; the others are merged together, lowest rank first."""
        whole = list(map(self.rank.get, words))
        rest = [w for w, rank in enumerate(whole) if rank is None and words[w]]
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in whole]
        if not rest:
            return out
        data = np.frombuffer(b"".join([words[w] for w in rest]), np.uint8)
        ends = np.cumsum([len(words[w]) for w in rest])
        starts = np.concatenate(([0], ends[:-1]))
        token = self.byte[data]
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1], before[starts] = -1, -1
        # the index: places of every pair that is a merge, by its rank
        pairs = token[:-1] << 32 | token[1:]
        at = np.searchsorted(self.pairs, pairs)
        known = self.pairs[at] == pairs  # the last pair is none, so every place found is inside
        known[ends[:-1] - 1] = False
        places = np.flatnonzero(known)
        ranks = self.ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        distinct, first = np.unique(ranks[order], return_index=True)
        index = {rank: part.tolist() for rank, part in zip(distinct.tolist(), np.split(places[order], first[1:]), strict=True)} if len(places) else {}
        merged = token.tolist()
        self._replay(merged, after.tolist(), before.tolist(), index)
        # what merges took up is marked, so the ids of a word are what is left between its ends
        left = np.array(merged)
        alive = left >= 0
        raw = left[alive].astype("<u4").tobytes()
        upto = (4 * np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64))).tolist()
        begin = 0
        for w, end in zip(rest, upto, strict=True):
            out[w] = raw[begin:end]
            begin = end
        return out

    def _replay(self, token: list[int], after: list[int], before: list[int], index: dict[int, list[int]]) -> None:
        known, waiting = self.merge.get, list(index)
        heapify(waiting)

        def add(rank: int, place: int) -> None:
            places = index.get(rank)
            if places is None:
                index[rank] = [place]
                heappush(waiting, rank)
            else:
                places.append(place)

        while waiting:
            rank = heappop(waiting)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) > 1:
                places.sort()
            high = rank << 32
            for done, p in enumerate(places):
                q = after[p]
                if q < 0 or token[p] < 0 or known(token[p] << 32 | token[q]) != rank:
                    continue  # a merge before took this place's pair
                token[p], token[q] = rank, -1
                n, left = after[q], before[p]
                after[p] = n
                after[q] = -1
                lower = False
                if n >= 0:
                    before[n] = p
                    fresh = known(high | token[n])
                    if fresh is not None:
                        lower = fresh < rank
                        add(fresh, p)
                if left >= 0:
                    fresh = known(token[left] << 32 | rank)
                    if fresh is not None:
                        lower = lower or fresh < rank
                        add(fresh, left)
                if lower:  # an earlier merge has come up: it goes first, the rest of these places wait
                    for rest in places[done + 1 :]:
                        add(rank, rest)
                    break


class Store:
    """The merges of one vocabulary and the ids of words met lately; one per worker process, so later tasks find them."""

    def __init__(self, tokens: list[bytes], version: str):
        self.version, self.replay = version, Replay(tokens)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words (at least these), as little-endian bytes."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = words.difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        fresh = list(new - again)
        known.update(zip(fresh, self.replay.encode([w.encode() for w in fresh]), strict=True))
        return known


_STORES: list[Store] = []


def _store_of(tokens: list[bytes], version: str) -> Store:
    if not _STORES or _STORES[0].version != version:
        _STORES[:] = [Store(tokens, version)]
    return _STORES[0]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids_le") -> DataFrame:
    """``docs`` with the ids of each whole text as little-endian unsigned 32-bit numbers in the binary column ``ids``.

    Each match of ``pattern`` is encoded by itself, without special tokens. Null
    and empty texts have no ids (an empty value). Rows, ties and repeats stay as
    they are, an empty table stays empty, a column of that name is replaced.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    ranks = read_ranks(ranks_path)
    tokens, version = spark.sparkContext.broadcast(ranks), hashlib.sha256(b"\n".join(base64.b64encode(t) for t in ranks)).hexdigest()
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = word_pattern(pattern).findall
        store = _store_of(tokens.value, version)
        for batch in batches:
            for part in slices(batch, text, LAID_OUT_BYTES):
                split = [find(t) if t else [] for t in part.column(text).to_pylist()]
                known = store.learn(set(chain.from_iterable(split)))
                packed = [b"".join(map(known.__getitem__, words)) for words in split]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary())], names=[*part.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids_le", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the binary column ``out``; null ids give an empty value."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in batches:
            for part in slices(batch, ids, LAID_OUT_BYTES):
                texts = [b"".join(map(table.__getitem__, memoryview(x).cast("I"))) if x else b"" for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, out])

    return encoded.mapInArrow(run, schema)

