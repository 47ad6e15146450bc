"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of WINDOW consecutive words (an item of fewer words is one window). A window is the set
of its word shingles; as it must be contained whole, one necessary shingle is enough to find it: the rarest in the
corpus, by counts over all documents. Shingles of documents are joined with these prefix shingles; the length and the
position bound place the window in the document, and its words are compared one by one.

Up to KNOWN_SHINGLES of the items are sent to the tasks, so that documents' other shingles are not shuffled; a larger
benchmark joins them all. Counts are summed in each task before they are shuffled. Occurrences are joined one by one, so the
shingle of a passage that many documents share is a hot key of that join, which Spark's skew join splits; behind it copies
of one text count as one.

Defined cases: a null or word-less text has no words and no hits; a null item id counts as the empty id; repeated
documents each get their own row, repeated items count once per id; an empty benchmark hits nothing; an empty documents
table gives an empty result; other columns of documents pass through untouched; a text of any length is read whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

WINDOW = 13
SHINGLE = 5
#: Shingles that a task holds to pass others over at once; with more, every shingle goes to the join.
KNOWN_SHINGLES = 2_000_000
MIN_PERCENT = 5


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = C.word_spans(data, at, C.ALNUM_WORD)
    return start, end, first, C.span_hashes(data, start, end, C.byte_values(lower=True))


def _lower(data: np.ndarray) -> bytes:
    """A-Z lower-cased, and every byte outside a word a space."""
    table = np.where(C.ALNUM_WORD, np.arange(256), 32).astype(np.uint8)
    table[65:91] += 32
    return table[data].tobytes()


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: window (its words, joined by spaces), width, step (words in a shingle), shingles, items."""
    source = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            data, at = C.bytes_of(batch.column("text"))
            start, end, first, words = _words(data, at)
            flat = _lower(data)
            out = defaultdict(list)
            for row, item in enumerate(batch.column("item").to_pylist()):
                lo, hi = int(first[row]), int(first[row + 1])
                width = min(window, hi - lo)
                step = min(shingle, width)
                if not width:
                    continue
                hashes = C.window_hashes(words[lo:hi], np.array([0, hi - lo]), step)[0].view(np.int64)
                said = [flat[a:b] for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]
                for i in range(hi - lo - width + 1):
                    out["item"].append(item)
                    out["window"].append(b" ".join(said[i : i + width]))
                    out["width"].append(width)
                    out["step"].append(step)
                    out["shingles"].append(hashes[i : i + width - step + 1].tolist())
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=arrow)

    arrow = pa.schema([("item", pa.string()), ("window", pa.binary()), ("width", pa.int32()), ("step", pa.int32()), ("shingles", pa.list_(pa.int64()))])
    found = source.mapInArrow(mapper, "item string, window binary, width int, step int, shingles array<bigint>")
    return found.groupBy("window").agg(
        F.first("width").alias("width"), F.first("step").alias("step"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items")
    )


_FILTER = 1 << 20


class Known:
    """Some shingles by step, with a small filter in front of the exact look-up. None stands for all shingles."""

    def __init__(self, rows: dict[int, np.ndarray]) -> None:
        self.sets = {step: np.sort(hashes.view(np.uint64)) for step, hashes in rows.items()}
        self.bits = {}
        for step, hashes in self.sets.items():
            self.bits[step] = np.zeros(_FILTER, bool)
            self.bits[step][(hashes & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def places(self, step: int, seen: np.ndarray) -> np.ndarray:
        hashes = self.sets[step]
        place = np.flatnonzero(self.bits[step][(seen & np.uint64(_FILTER - 1)).astype(np.int64)])
        return place[hashes[np.minimum(np.searchsorted(hashes, seen[place]), len(hashes) - 1)] == seen[place]]


def _known(tokens: DataFrame) -> tuple[dict[int, int], object]:
    """Steps of tokens (step, shingle; distinct), and a broadcast Known of them, or None where they are too many."""
    sizes = dict(tokens.groupBy("step").count().collect())  # a row per number of words, `shingle` at most
    if sum(sizes.values()) > KNOWN_SHINGLES:
        return sizes, None
    table = tokens.select("step", "shingle").toArrow()  # KNOWN_SHINGLES rows at most
    steps, hashes = table.column("step").to_numpy(), table.column("shingle").to_numpy()
    return sizes, tokens.sparkSession.sparkContext.broadcast(Known({s: hashes[steps == s] for s in sizes}))


def shingle_counts(docs: DataFrame, tokens: DataFrame, text: str = "text") -> DataFrame:
    """step, shingle, n: how often each of the tokens (step, shingle; distinct) occurs over all documents."""
    steps, known = _known(tokens)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {s: Counter() for s in steps}

        def flushed() -> Iterator[pa.RecordBatch]:
            for step, counts in total.items():
                if counts:
                    keys, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), step, np.int32)), pa.array(keys), pa.array(n)], names=["step", "shingle", "n"])
                    counts.clear()

        for batch in C.steps(batches, "text"):
            _, _, first, words = _words(*C.bytes_of(batch.column("text")))
            for step in steps:
                seen, _, _ = C.window_hashes(words, first, step)
                met = seen if known is None else seen[known.value.places(step, seen)]
                total[step].update(dict(zip(*(x.tolist() for x in np.unique(met.view(np.int64), return_counts=True)), strict=True)))
            if sum(map(len, total.values())) > 200_000:
                yield from flushed()
        yield from flushed()

    made = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(mapper, "step int, shingle bigint, n bigint")
    counted = made.groupBy("step", "shingle").agg(F.sum("n").alias("n"))
    return counted.join(tokens, ["step", "shingle"]) if known is None else counted


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window that can occur, with its rarest shingle: window, width, step, items, shingle, place (of it)."""
    tokens = windows.select("window", "width", "step", "items", F.posexplode("shingles").alias("place", "shingle"))
    ranked = tokens.join(counts, ["step", "shingle"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("window").agg(
        F.first("width").alias("width"),
        F.first("step").alias("step"),
        F.first("items").alias("items"),
        F.min(F.struct("n", "place", "shingle")).alias("rarest"),
    )
    return rarest.filter("rarest.n > 0").select("window", "width", "step", "items", "rarest.shingle", "rarest.place")


_MET = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("shingle", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("before", T.IntegerType()),
        T.StructField("words", T.StringType()),
    ]
)


def met_shingles(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """rk, n_words, met: for each row of docs (rk, text) its occurrences of the tokens (step, shingle; distinct): `at` is
    the word at which one begins, `words` the words from `before` words ahead of it that any window around it may hold."""
    steps, known = _known(tokens)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            data, at = C.bytes_of(batch.column("text"))
            start, end, first, words = _words(data, at)
            flat = _lower(data)
            met: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for step in steps:
                seen, pos, row = C.window_hashes(words, first, step)
                place = np.arange(len(seen)) if known is None else known.value.places(step, seen)
                more = WINDOW - step if step == SHINGLE else 0  # windows of fewer words are one shingle
                r, w = row[place], pos[place]
                lo, hi = np.maximum(first[r], w - more), np.minimum(first[r + 1], w + step + more)
                for h, i, p, a, b in zip(seen[place].view(np.int64).tolist(), r.tolist(), w.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    said = b" ".join([flat[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])
                    met[i].append({"step": step, "shingle": h, "at": p - int(first[i]), "before": p - a, "words": said.decode()})
            yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array(np.diff(first).astype(np.int64)), pa.array(met, arrow)], names=["rk", "n_words", "met"])

    arrow = pa.list_(pa.struct([("step", pa.int32()), ("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))
    return docs.mapInArrow(mapper, T.StructType([docs.schema["rk"], T.StructField("n_words", T.LongType()), T.StructField("met", T.ArrayType(_MET))]))


def hits(met: DataFrame, prefix: DataFrame) -> DataFrame:
    """rk, n_hit, item_ids (sorted): what occurs in each text that has a hit; met: rk, met; prefix: see prefixes()."""
    each = met.select("rk", F.inline("met"))
    joined = each.join(prefix, ["step", "shingle"])
    # where the window begins in `words`; it lies there whole if it is contained
    begin = F.col("before") - F.col("place")
    same = (begin >= 0) & (F.array_join(F.slice(F.split("words", " "), F.greatest(begin, F.lit(0)) + 1, F.col("width")), " ") == F.col("window").cast("string"))
    found = joined.filter(same).select("rk", (F.col("at") - F.col("place")).alias("begin"), "width", "items")
    spans = found.groupBy("rk", "begin", "width").agg(F.first("items").alias("items"))  # once for all copies of a text
    before = F.max(F.col("begin") + F.col("width")).over(Window.partitionBy("rk").orderBy("begin", "width").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.greatest(F.lit(0), F.col("begin") + F.col("width") - F.greatest("begin", F.coalesce(before, F.lit(0)))))
    return new.groupBy("rk").agg(F.sum("new").cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))


def _found(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """rk, n_words of every row of docs, stored; hits()."""
    C.small_batches(docs.sparkSession)
    windows = C.written(item_windows(items, item_id, item_text), "windows")
    tokens = windows.select("step", F.explode("shingles").alias("shingle")).distinct()
    counts = shingle_counts(docs, tokens, text)
    prefix = C.written(prefixes(windows, counts), "prefixes")
    keyed = docs.select(_key(F.col(f"`{text}`")).alias("rk"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    met = C.written(met_shingles(keyed, prefix.select("step", "shingle").distinct()), "met")
    return met, hits(met.filter(F.size("met") > 0), prefix)


def _key(text: Column) -> Column:
    """Two hashes and the length of a text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(whole).alias("h"), F.crc32(whole.cast("binary")).alias("c"), F.octet_length(whole).alias("n"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Per document: row (its columns, or `columns` of them), n_words, n_hit, item_ids (sorted), n_items, items_sha256, contaminated."""
    met, found = _found(docs, items, text, item_id, item_text)
    sizes = met.groupBy("rk").agg(F.first("n_words").alias("n_words")).join(found, "rk", "left").select(F.struct("rk", "n_words", "n_hit", "item_ids").alias("of"))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), _key(F.col(f"`{text}`")).alias("rk"))
    none, n_hit = F.array().cast("array<string>"), F.coalesce("of.n_hit", F.lit(0))
    joined = source.join(sizes, F.col("rk") == F.col("of.rk"))
    made = joined.select("row", "of.n_words", n_hit.cast("bigint").alias("n_hit"), F.coalesce("of.item_ids", none).alias("item_ids"))
    return made.withColumns(
        {
            "n_items": F.size("item_ids").cast("bigint"),
            "items_sha256": F.sha2(F.array_join("item_ids", ",").cast("binary"), 256),
            "contaminated": _contaminated(),
        }
    )


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= MIN_PERCENT * F.col("n_words"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, columns unchanged."""
    met, found = _found(docs, items, text, item_id, item_text)
    sizes = met.filter(F.size("met") > 0).groupBy("rk").agg(F.first("n_words").alias("n_words"))
    bad = C.written(sizes.join(found, "rk").filter(_contaminated()).select(F.struct("rk").alias("of")), "contaminated")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col(f"`{text}`")).alias("rk"))
    return source.join(bad, F.col("rk") == F.col("of.rk"), "left_anti").select("row.*")
