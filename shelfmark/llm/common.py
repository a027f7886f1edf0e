"""What the operators of this subpackage share: tables, scratch tables, batch sizes, word names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfmark.functions.scale import ensure_checkpoint_dir

ROWS_PER_BATCH = "1000"
SLICE_BYTES = 2 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession) -> None:
    """Send whole texts to Python in batches of a thousand rows instead of ten thousand (a setting made by the user stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ROWS_PER_BATCH)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again: cuts lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _COLLECTING.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_COLLECTING: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())


@contextmanager
def collecting() -> Iterator[list[str]]:
    """Paths of the tables that ``written`` makes meanwhile, for ``delete`` when nothing will read them any more."""
    made: list[str] = []
    token = _COLLECTING.set((*_COLLECTING.get(), made))
    try:
        yield made
    finally:
        _COLLECTING.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again, and let Spark drop the shuffle files of jobs that are over.

    Those files go when the driver's garbage collector finds their jobs unreachable; an
    idle driver may not collect for half an hour, while the files fill the executors' disks.
    """
    for df in tables:
        delete(df.sparkSession, sorted({f.rpartition("/")[0] for f in df.inputFiles()}))
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Row ranges of a batch whose texts stay near ``limit`` bytes; a longer text is a range of its own."""
    sizes = np.diff(offsets_of(batch.column(column)))
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of the texts of a string or binary array (nulls are empty)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    return raw.astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and the offsets of each."""
    texts = texts.fill_null("")
    at = offsets_of(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte but letters and digits: words then carry no punctuation.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    out = np.empty(_BLOCK + 1, np.uint64)
    out[0] = 1
    filled = 1
    while filled <= _BLOCK:
        step = min(filled, _BLOCK + 1 - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (SplitMix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (``[^\\x20\\x09-\\x0D]+``, or runs without the bytes ``between``) and, per text, the index of its first word."""
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word: equal words, equal names, wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _BLOCK, side="right"))
        if j == i:  # a word longer than a block
            out[i] = _long_name(data[base : int(ends[i])])
            i += 1
            continue
        part = data[base : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _UP[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mixed(out)


def _long_name(word: np.ndarray) -> np.uint64:
    total = 0
    for k in range(0, len(word), _BLOCK):
        part = word[k : k + _BLOCK].astype(np.uint64) + np.uint64(1)
        total = (total + int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k, 1 << 64)) % (1 << 64)
    return np.uint64((total + len(word) * 0xD6E8FEB86659FD93) % (1 << 64))


def named_words(texts: pa.Array, lower: bool = False, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words of the texts, and per text the index of its first word (one more entry closes the last)."""
    data, at = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    starts, ends, first = word_spans(data, at, between)
    return word_names(data, starts, ends), first
