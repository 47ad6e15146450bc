"""Spelling variants grouped by full neighbourhood generation.

Words are counted where texts are read. Each word of the vocabulary then emits all distinct strings one deletion,
replacement or insertion away, over the alphabet that the vocabulary shows; those that are words themselves are its
neighbours, found by a hash join of strings, so no distance is ever computed. Distinct edits are emitted once: in a run of
equal letters one deletion stands for all, and a letter is inserted only behind a run of itself.

A word of ten letters has about 900 such strings, nearly none of which is a word. So that they do not all cross the
network, a Bloom filter of the vocabulary is sent to the tasks (its bits are set by a Spark aggregate; at most FILTER_BITS,
64 MiB). Hashes of edited words come from the hashes of the parts before and behind the edit, whole arrays at once; only
strings that the filter lets pass are built and joined. With a vocabulary too large for a sparse filter more of them
pass; the result is the same.

A word's form is its most frequent neighbour, if that is at least FACTOR times as frequent. Forms grow along a chain, so
chains are short and have no cycles; roots are found by pointer doubling, in as many joins as the logarithm of the
longest chain.

Defined cases: a null text has no words; a null id is an empty text in the hash that picks words; repeated rows count
again; an empty table gives an empty result; a word of any length takes part, its neighbourhood is made in steps. Other
columns take no part.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

LETTERS = r"[a-z\x{C0}-\x{FF}]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One of so many (document, word) pairs loses a letter.
SLIP = 97
FILTER_BITS = 1 << 29
BITS_PER_WORD = 24
#: Hashes that a task holds at once.
STEP = 1 << 20
_BUCKET = 1 << 15  # bits of one of Spark's bitmaps


def runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """word: every run of letters of every text; a fixed share has lost one of its letters."""
    lower = F.translate(F.col(f"`{text}`").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    each = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("CAST(h % length(run) AS INT)")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words long and frequent enough."""
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _value(codes: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each code point."""
    with np.errstate(over="ignore"):
        return C.mixed(codes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the words of one length, and their code points, a row a word."""
    size = np.array([len(w) for w in words], np.int64)
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        codes = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), -1)
        yield own, codes


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Column i: the hash of the first i letters."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_value(codes) * C._power("up", codes.shape[1])[: codes.shape[1]], axis=1, out=out[:, 1:])
    return out


def _key(hashes: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mixed(hashes + np.uint64(length) * np.uint64(0x9E3779B97F4A7C15))


def _bit(key: np.ndarray, j: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key + np.uint64(j) * ((key >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def _edits(codes: np.ndarray, alphabet: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """All edits in steps: change of length, hash keys (rows x places x letters), which are distinct, the first place."""
    rows, length = codes.shape
    before = _prefix_hashes(codes)
    up, base = C._power("up", length + 1), C._power("up", 1)[1]
    back, values, total = C._power("down", 1)[1], _value(alphabet), before[:, -1:]
    with np.errstate(over="ignore"):
        if length - 1 in lengths:
            last = np.ones((rows, length), bool)
            last[:, :-1] = codes[:, :-1] != codes[:, 1:]
            keys = _key(before[:, :-1] + (total - before[:, 1:]) * back, length - 1)
            yield -1, keys[:, :, None], last[:, :, None], 0
        for change in (0, 1):
            if length + change not in lengths:
                continue
            wide = max(1, STEP // max(1, rows * len(alphabet)))
            for first in range(0, length + change, wide):
                at = np.arange(first, min(first + wide, length + change))
                if change:
                    rest = before[:, at] + (total - before[:, at]) * base
                    here = np.zeros((rows, len(at)), np.uint32)
                    inner = at < length
                    here[:, inner] = codes[:, at[inner]]
                else:
                    rest, here = before[:, at] + (total - before[:, at + 1]), codes[:, at]
                keys = _key(rest[:, :, None] + values[None, None, :] * up[at][None, :, None], length + change)
                yield change, keys, here[:, :, None] != alphabet[None, None, :], first


def _edited(codes: np.ndarray, change: int, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The strings: each row of codes with its edit at place `at`."""
    width = codes.shape[1] + change
    place = np.arange(width)[None, :]
    if change < 0:
        made = np.take_along_axis(codes, place + (place >= at[:, None]), axis=1)
    elif change == 0:
        made = np.where(place == at[:, None], letters[:, None], codes)
    else:
        made = np.take_along_axis(codes, np.clip(place - (place > at[:, None]), 0, codes.shape[1] - 1), axis=1)
        made = np.where(place == at[:, None], letters[:, None], made)
    return np.ascontiguousarray(made.astype(np.uint32)).view(f"<U{width}").ravel()


def _filter_of(vocab: DataFrame, n: int, bits_per_word: int = BITS_PER_WORD, most_bits: int = FILTER_BITS) -> tuple[np.ndarray, int]:
    """The bytes of a Bloom filter of the words, and how many bits a word sets."""
    bits = _BUCKET
    while bits < min(n * bits_per_word, most_bits):
        bits *= 2
    k = max(1, min(8, round(bits / max(n, 1) / 2)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _by_length(batch.column(0).to_pylist()):
                keys = _key(_prefix_hashes(codes)[:, -1], codes.shape[1])
                at = np.unique(np.concatenate([_bit(keys, j, bits) for j in range(k)])).astype(np.int64)
                yield pa.record_batch([at >> 15, at & (_BUCKET - 1)], ["bucket", "at"])

    placed = vocab.select("word").mapInArrow(places, "bucket bigint, at bigint")
    made = placed.groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in made.toLocalIterator():  # FILTER_BITS at most
        out[row["bucket"] * (_BUCKET // 8) :][: _BUCKET // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out, k


def neighbours(vocab: DataFrame, **filter_sizes: int) -> DataFrame:
    """word, n, near, near_n: each word with each word one edit away; vocab: word, n."""
    spark = vocab.sparkSession
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint32)  # letters of the pattern at most
    n = vocab.count()
    lengths = np.array([r["size"] for r in vocab.select(F.length("word").alias("size")).distinct().collect()])  # one number a length
    held, k = _filter_of(vocab, n, **filter_sizes)
    sent = spark.sparkContext.broadcast(held)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = sent.value
        bits = len(marked) * 8
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for own, codes in _by_length(words):
                some = max(1, STEP // max(1, (codes.shape[1] + 1) * len(alphabet)))
                for low in range(0, len(own), some):
                    part = codes[low : low + some]
                    for change, keys, distinct, first in _edits(part, alphabet, lengths):
                        at = np.flatnonzero(distinct)
                        flat = keys.ravel()[at]
                        for j in range(k):
                            place = _bit(flat, j, bits)
                            passed = (marked[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                            at, flat = at[passed], flat[passed]
                        row, place, letter = np.unravel_index(at, keys.shape)
                        most = max(1, STEP // (codes.shape[1] + 1))
                        for i in range(0, len(at), most):
                            r = row[i : i + most]
                            made = _edited(part[r], change, place[i : i + most] + first, alphabet[letter[i : i + most]])
                            mine = own[low + r]
                            yield pa.record_batch([pa.array([words[x] for x in mine], pa.string()), pa.array(counts[mine]), pa.array(made.tolist(), pa.string())], ["word", "n", "near"])

    made = vocab.select("word", "n").mapInArrow(edits, "word string, n bigint, near string")
    return made.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form; forms: word, form (null if none)."""
    held = C.written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = C.written(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        held = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return held


def grouped(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, **filter_sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n; words: word, a row an occurrence."""
    vocab = C.written(vocabulary(words, least_length, least_count), "vocabulary")
    near = neighbours(vocab, **filter_sizes).select("word", "n", F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")).alias("near"))
    alone = vocab.select("word", "n", F.lit(None).cast(near.schema["near"].dataType).alias("near"))
    best = near.unionByName(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), F.min("near").alias("best"))
    strong: Column = -F.col("best.less") >= factor * F.col("n")
    found = C.written(best.select("word", "n", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    rooted = found.join(roots(found), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
