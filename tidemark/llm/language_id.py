"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (all lengths in SPECTRUM together, presence only) that both hold,
divided by the geometric mean of their own numbers. LANDMARKS texts of the training sample, as many of each
language, span a Nyström feature space; one ridge regression per language is solved in it. A text's score is linear in its n-gram presences, so rows are scored
a batch at a time: presence matrix times landmark matrix times weights.

Only the fit reads a sample: about PER_LANGUAGE labelled rows of each language, chosen by a hash of the id, whole texts.
It is bounded whatever the corpus; languages themselves are counted over all labelled rows. Prediction reads the text
alone.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled rows every text is `und`;
texts shorter than an n-gram use the shorter ones; rows with equal texts get equal results; other columns
pass through; a text of any length is read whole, as a row of presences of bounded width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

SPECTRUM = (1, 2, 3)
PER_LANGUAGE = 300
LANDMARKS = 256
RIDGE = 1e-2
UNKNOWN = "und"

_CODES = (1 << 24) + (1 << 16) + (1 << 8)


def _gram_codes(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the place and code of every n-gram that lies within its row; A-Z count as a-z."""
    lower = np.arange(256)
    lower[65:91] += 32
    x = lower[data].astype(np.int32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    base = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}
    for n in SPECTRUM:
        if len(x) < n:
            continue
        code = x[: len(x) - n + 1].copy()
        for i in range(1, n):
            code = code * 256 + x[i : len(x) - n + 1 + i]
        inside = row[: len(code)] == row[n - 1 :]
        yield row[: len(code)][inside], code[inside] + base[n]


def presences(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The distinct n-gram codes of each row."""
    out = []
    for r in range(len(at) - 1):
        part = data[at[r] : at[r + 1]]
        codes = [c for _, c in _gram_codes(part, np.array([0, len(part)]))]
        out.append(np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int32))
    return out


class Model:
    """Landmarks' n-grams, and for each of them its weight towards every language, once solved."""

    def __init__(self, landmarks: list[np.ndarray], languages: list[str]) -> None:
        self.languages = languages
        self.vocabulary = np.unique(np.concatenate([*landmarks, np.zeros(0, np.int32)]))
        self.size = np.array([max(1, len(g)) for g in landmarks], float)
        self.marks = self.seen(landmarks)
        value, vector = np.linalg.eigh(self._common(self.marks) / np.sqrt(np.outer(self.size, self.size)))
        good = value > 1e-8 * value.max()
        self.root = vector[:, good] / np.sqrt(value[good])  # Nyström: features = kernel with landmarks, whitened

    def seen(self, grams: list[np.ndarray]) -> np.ndarray:
        """Which of the vocabulary each text holds, a byte each."""
        out = np.zeros((len(grams), len(self.vocabulary)), np.uint8)
        for i, g in enumerate(grams):
            at = np.minimum(np.searchsorted(self.vocabulary, g), max(0, len(self.vocabulary) - 1))
            out[i, at[self.vocabulary[at] == g] if len(self.vocabulary) else []] = 1
        return out

    def _common(self, seen: np.ndarray) -> np.ndarray:
        """Numbers of n-grams in common with each landmark, a few landmarks at a time."""
        rows = seen.astype(np.float32)
        return np.concatenate([rows @ self.marks[i : i + 64].T.astype(np.float32) for i in range(0, len(self.marks), 64)], 1).astype(float)

    def features(self, grams: list[np.ndarray]) -> np.ndarray:
        size = np.array([max(1, len(g)) for g in grams], float)
        return self._common(self.seen(grams)) / np.sqrt(np.outer(size, self.size)) @ self.root

    def solve(self, squares: np.ndarray, targets: np.ndarray, rows: int) -> None:
        """squares: features' products with each other; targets: with +1 or -1 for every language; over `rows` texts."""
        weights = np.linalg.solve(squares + RIDGE * rows * np.eye(len(squares)) / 100, targets)
        self.landmark_weights = (self.root @ weights) / np.sqrt(self.size)[:, None]
        self.per_gram = np.zeros((len(self.vocabulary), len(self.languages)), np.float32)
        for i in range(0, len(self.vocabulary), 4096):
            self.per_gram[i : i + 4096] = self.marks[:, i : i + 4096].T.astype(np.float64) @ self.landmark_weights
        self.marks = self.root = None

    def lookup(self) -> np.ndarray:
        table = np.full(_CODES, -1, np.int32)
        table[self.vocabulary] = np.arange(len(self.vocabulary))
        return table

    def scores(self, data: np.ndarray, at: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        """One row of margins per text. The text's own number of n-grams scales all margins alike, so it is left out."""
        rows, width = len(at) - 1, len(self.vocabulary)
        out = np.zeros((rows, len(self.languages)), np.float64)
        held = max(1, (8 << 20) // max(1, width))
        for first in range(0, rows, held):
            last = min(rows, first + held)
            part = data[at[first] : at[last]]
            seen = np.zeros((last - first) * width, np.float32)
            for row, code in _gram_codes(part, at[first : last + 1] - at[first]):
                index = lookup[code]
                known = index >= 0
                seen[row[known] * width + index[known]] = 1
            seen = seen.reshape(last - first, width)
            size = np.sqrt(np.maximum(1, seen.sum(1)))
            out[first:last] = (seen @ self.per_gram) / size[:, None]
        return out


def training_rows(docs: DataFrame, allowed: Column, id_column: str, text: str, label: str, per_language: int) -> DataFrame:
    """label, h, grams (packed int32): about `per_language` allowed rows of each label, by a hash of id and text."""
    rows = docs.select(
        F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text}`")).alias("h"), allowed.alias("allowed")
    ).filter("allowed AND label IS NOT NULL AND text IS NOT NULL AND text <> ''")
    shares = rows.groupBy("label").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))  # one row per language
    picked = rows.join(F.broadcast(shares), "label").filter(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("label", "text", "h")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            grams = presences(*C.bytes_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), pa.array([g.astype(np.int32).tobytes() for g in grams], pa.binary())], names=["label", "h", "grams"])

    return picked.mapInArrow(mapper, "label string, h bigint, grams binary")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(g, np.int32) for g in column.to_pylist()]


def fitted(docs: DataFrame, allowed: Column, id_column: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """The model, or None without a labelled row. The driver holds LANDMARKS texts' n-grams and matrices of LANDMARKS
    columns; features of the sample are made and summed where the sample is."""
    spark = docs.sparkSession
    C.small_batches(spark)
    sample = C.written(training_rows(docs, allowed, id_column, text, label, per_language), "training")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # one row per language
    if not counts:
        return None
    each = max(1, LANDMARKS // len(counts))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h", "grams"))
    chosen = sample.withColumn("n", nth).filter(F.col("n") <= each).orderBy("label", "n").collect()  # LANDMARKS rows, or one per language
    model = Model([np.frombuffer(r["grams"], np.int32) for r in chosen], sorted(counts))
    shared = spark.sparkContext.broadcast(model)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, None
        for batch in C.steps(batches, "grams"):
            labels = np.array(batch.column("label").to_pylist(), object)
            feature = own.features(_unpacked(batch.column("grams")))
            target = np.where(labels[:, None] == np.array(own.languages, object)[None, :], 1.0, -1.0)
            made = feature.T @ np.concatenate([feature, target], 1)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "sums"])

    def summed(rows: pa.Table) -> pa.Table:
        parts = sorted(rows.column("sums").to_pylist())
        return pa.table({"i": rows.column("i")[:1], "sums": pa.array([sum(np.frombuffer(p) for p in parts).tobytes()], pa.binary())})

    schema = "i bigint, sums binary"
    lines = sample.mapInArrow(partial, schema).groupBy("i").applyInArrow(summed, schema).orderBy("i").collect()  # one row a feature
    sums, width = np.stack([np.frombuffer(r["sums"]) for r in lines]), len(lines)
    model.solve(sums[:, :width], sums[:, width:], sum(counts.values()))
    return model


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Per row of docs: row (its columns), lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), texts.alias("text"), texts.rlike(r"\p{L}").alias("letters"))

    C.small_batches(docs.sparkSession)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lookup = shared.value, None
        for batch in C.steps(batches, "text"):
            n = batch.num_rows
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if own is not None:
                lookup = own.lookup() if lookup is None else lookup
                margin = own.scores(*C.bytes_of(batch.column("text")), lookup)
                likely = np.exp(4 * (margin - margin.max(1, keepdims=True)))
                likely /= likely.sum(1, keepdims=True)
                best = margin.argmax(1)
                names = np.where(letters, np.array(own.languages, object)[best], UNKNOWN)
                score = np.where(letters, likely[np.arange(n), best].round(6), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    schema = T.StructType([source.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(mapper, schema)
