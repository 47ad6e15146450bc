"""Shared helpers of the corpus operators: shared tables, Arrow batches as byte arrays, word and window hashes."""

from __future__ import annotations

import ctypes
import gc
import threading
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder

#: Bytes of text that one step of a mapper holds as arrays; a longer document is one step of its own.
STEP_BYTES = 1 << 20


#: Rows of an Arrow batch: batches are counted in rows, and rows hold whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of BATCH_ROWS rows at most, so that tasks hold little text at once; results do not change."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_left = threading.local()


def _paths() -> list[str]:
    """Folders that this thread has written and not deleted, in order."""
    if not hasattr(_left, "paths"):
        _left.paths = []
    return _left.paths


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    _paths().append(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def settled(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files behind tables that are stored; it does so once the driver has collected the
    objects that stand for them, which it may put off for long."""
    for _ in range(2):  # what the first round frees names more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def mark() -> int:
    """A point in this thread's work, for dropped() and taken()."""
    return len(_paths())


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def taken(since: int) -> list[str]:
    """The tables that this thread has written since a mark; whoever takes them deletes them."""
    paths = _paths()
    made = paths[since:]
    del paths[since:]
    return made


def dropped(spark: SparkSession, since: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that this thread has written since a mark, once their readers have stored what they made of them;
    tables in `keep` stay."""
    held = {df.stored_at for df in keep}
    made = taken(since)
    deleted(spark, [p for p in made if p not in held])
    _paths().extend(p for p in made if p in held)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins (one more at the end); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def released() -> None:
    """Give freed memory back to the system: a worker that is idle stays beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = bytes_of(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    released()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(way: str, n: int) -> np.ndarray:
    """Powers 0..n of the odd base ("up") or of its inverse modulo 2^64 ("down")."""
    if len(_powers[way]) <= n:
        base = _BASE if way == "up" else pow(_BASE, -1, 1 << 64)
        out = np.ones(n + 1, np.uint64)
        out[1:] = np.uint64(base)
        _powers[way] = np.multiply.accumulate(out)
    return _powers[way]


_letter = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def byte_values(lower: bool = False) -> np.ndarray:
    """A random 64-bit value per byte; with lower, A-Z have those of a-z."""
    out = _letter.copy()
    if lower:
        out[65:91] = out[97:123]
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each of the ascending spans, which may touch but not overlap."""
    out = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + STEP_BYTES, side="right")))
        lo, hi = int(start[first]), int(end[last - 1])
        with np.errstate(over="ignore"):
            summed = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[data[lo:hi]] * _power("up", hi - lo)[: hi - lo], out=summed[1:])
            s, e = start[first:last] - lo, end[first:last] - lo
            out[first:last] = mixed((summed[e] - summed[s]) * _power("down", hi - lo)[s] + (e - s).astype(np.uint64))
        first = last
    return out


#: Bytes of the words [^\x20\x09-\x0D]+ .
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, letters and all that is not ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (one more at the end)."""
    inside = is_word[data] if len(data) else np.zeros(0, bool)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every run of `width` words that lies within one row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    pos = np.flatnonzero(row[:n] == row[width - 1 :])
    with np.errstate(over="ignore"):
        total = np.zeros(len(pos), np.uint64)
        for i in range(width):
            total = (total * np.uint64(_BASE)) + words[pos + i]
    return mixed(total + np.uint64(width)), pos, row[pos]
