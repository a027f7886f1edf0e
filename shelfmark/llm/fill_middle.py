"""Fill-in-middle: texts cut in three, the middle moved to the end, by displacement scatter.

A batch's texts lie in one byte array. Every piece of a text moves as a whole, so
its displacement is written once where the piece begins, into a difference array;
the cumulative sum gives every byte its output shift and one numpy scatter builds
all outputs. Restoring scans the markers in the outputs, lays out the same shifts
and gathers the bytes back. Work and memory follow the bytes of a slice of the
batch; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import slices, text_bytes, whole_texts

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred texts with no marker in them so many stay plain, and of the others so many put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_WIDTH = 3


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from the SHA-256 of ``seed:key`` (a null key is empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def plan_cuts(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``docs`` with n (code points), form, prefix_chars and middle_chars (null if plain).

    A null text counts as empty. Empty texts and texts that hold a marker stay plain.
    Rows of one key and text are cut alike; columns of those names are replaced.
    """
    h1, h2, h3, h4 = draws(F.col(key), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.char_length(whole).cast("bigint")
    a, b = h1 % (n + 1), h2 % (n + 1)
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((n == 0) | marked | (h3 % 100 >= 100 - PLAIN_PERCENT), PLAIN).when(h4 % 100 < SPM_PERCENT, SPM).otherwise(PSM)
    cut = form != PLAIN
    return docs.withColumns({"n": n, "form": form, "prefix_chars": F.when(cut, F.least(a, b)), "middle_chars": F.when(cut, F.abs(a - b))})


def _moved(at: np.ndarray, first: np.ndarray, second: np.ndarray, cut: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shift of every byte, offsets of the outputs, and where each marker of a cut text stands (a row per text: P, S, M).

    ``at`` are the offsets of the texts, ``first`` and ``second`` the bytes at which prefix and middle end.
    """
    start, end = at[:-1], at[1:]
    out = np.zeros(len(at), np.int64)
    np.cumsum(end - start + np.where(cut, 3 * _WIDTH, 0), out=out[1:])
    begin = out[:-1]
    prefix, middle, suffix = first - start, second - first, end - second
    p_mark = np.where(spm, begin + _WIDTH + suffix, begin)
    s_mark = np.where(spm, begin, begin + _WIDTH + prefix)
    m_mark = begin + 2 * _WIDTH + prefix + suffix
    shift_p = np.where(cut, p_mark + _WIDTH, begin) - start
    shift_m = np.where(cut, m_mark + _WIDTH - first, shift_p)
    shift_s = np.where(cut, s_mark + _WIDTH - second, shift_p)
    change = np.zeros(int(at[-1]) + 1, np.int64)
    np.add.at(change, start, shift_p - np.concatenate(([0], shift_s[:-1])))
    np.add.at(change, first, shift_m - shift_p)
    np.add.at(change, second, shift_s - shift_m)
    return np.cumsum(change[:-1]), out, np.stack([p_mark, s_mark, m_mark], 1)


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _scatter(part: pa.RecordBatch, text: str) -> pa.Array:
    data, at = text_bytes(part.column(text))
    form = part.column("form").to_numpy(zero_copy_only=False)
    cut, spm = form != PLAIN, form == SPM
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte at which each code point begins
    origin = np.searchsorted(chars, at[:-1])
    before = np.where(cut, part.column("prefix_chars").fill_null(0).to_numpy(), 0)
    inside = np.where(cut, part.column("middle_chars").fill_null(0).to_numpy(), 0)
    first, second = chars[origin + before], chars[origin + before + inside]
    shift, out, marks = _moved(at, first, second, cut, spm)
    built = np.empty(int(out[-1]), np.uint8)
    built[np.arange(len(data)) + shift] = data
    for k, marker in enumerate(MARKERS):
        for i, byte in enumerate(marker.encode()):
            built[marks[cut, k] + i] = byte
    return _strings(out, built)


def _gather(part: pa.RecordBatch, output: str) -> pa.Array:
    data, at = text_bytes(part.column(output))
    form = part.column("form").to_numpy(zero_copy_only=False)
    cut, spm = form != PLAIN, form == SPM
    size = np.diff(at) - np.where(cut, 3 * _WIDTH, 0)
    place = []
    for marker in MARKERS:  # texts that hold a marker are never cut, so each cut output has each marker once
        a, b, c = marker.encode()
        hits = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)) if len(data) > 2 else np.zeros(0, np.int64)
        where = np.zeros(len(cut), np.int64)
        owner = np.searchsorted(at, hits, side="right") - 1
        whole = cut[owner] & (hits + _WIDTH <= at[owner + 1])  # not a match over two outputs
        where[owner[whole]] = hits[whole]
        place.append(where)
    p_mark, s_mark, m_mark = place
    prefix = np.where(cut, np.where(spm, m_mark, s_mark) - p_mark - _WIDTH, 0)
    middle = np.where(cut, at[1:] - m_mark - _WIDTH, 0)
    back = np.concatenate(([0], np.cumsum(size)))
    first = back[:-1] + prefix
    shift, _, _ = _moved(back, first, first + middle, cut, spm)
    return _strings(back, data[np.arange(int(back[-1])) + shift])


def fill_in_middle(planned: DataFrame, text: str = "text", output: str = "output") -> DataFrame:
    """``planned`` (see ``plan_cuts``) with the arranged text in the column ``output``.

    plain: the text; psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle.
    A null text gives an empty output. Rows, ties and repeats stay; an empty table stays
    empty; a column of that name is replaced. A text is one cell of a batch, whole at any length.
    """
    return _mapped(planned, text, output, _scatter)


def restore(arranged: DataFrame, output: str = "output", restored: str = "restored") -> DataFrame:
    """``arranged`` with the text rebuilt from ``output`` and ``form`` alone (null output: empty)."""
    return _mapped(arranged, output, restored, _gather)


def _mapped(df: DataFrame, source: str, target: str, build) -> DataFrame:
    whole_texts(df.sparkSession)
    df = df.drop(target)
    schema = T.StructType([*df.schema.fields, T.StructField(target, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                yield pa.RecordBatch.from_arrays([*part.columns, build(part, source)], names=[*part.schema.names, target])

    return df.mapInArrow(run, schema)
