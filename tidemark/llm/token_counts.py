"""Token counts without token ids.

Documents are cut into pre-tokens (words with the spaces before them), which no token of the model crosses. The pieces of
each distinct pre-token are counted once. The counts of the most frequent pre-tokens (HOT at most, so the broadcast has
a bound) are added up where the document is read; frequencies of all others go to a join with the table
of distinct pre-tokens and are summed by document.

Defined cases: a null or empty text has no tokens; rows with the same id and text get the same count each; a null id is
kept as null; an empty table gives an empty result; a text is cut whole, in the memory of one task, however long.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

SPACE = "▁"
HOT = 1 << 18
LIMIT = 4096
#: Distinct pre-tokens, and characters of text, that a task counts before it passes them on.
TASK_WORDS = 100_000
TASK_CHARACTERS = 1 << 25


@lru_cache(maxsize=2)
def library(path: str) -> tuple[sentencepiece.SentencePieceProcessor, re.Pattern]:
    """The library's model, and the pattern of pre-tokens that its pieces allow."""
    made = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [made.id_to_piece(i) for i in range(made.get_piece_size()) if not (made.is_byte(i) or made.is_control(i) or made.is_unknown(i))]
    if any(SPACE in p.lstrip(SPACE) for p in usual):
        raise ValueError("a piece has a space inside")
    if any("\n" in p for p in usual):
        raise ValueError("a piece has a line feed")
    return made, re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def _words(text: str, pattern: re.Pattern) -> list[str]:
    return pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


def piece_counts(words: list[str], path: str) -> list[int]:
    """Pieces of each pre-token. A line feed is put in front, as the library adds a space before a text only."""
    made, _ = library(path)
    alone = len(made.encode("\n"))
    return [len(x) - alone for x in made.encode(["\n" + w for w in words], num_threads=1)]


def pre_tokens(texts: DataFrame, path: str) -> DataFrame:
    """word, n (occurrences in the corpus), pieces; texts: text."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pattern = library(path)
        seen: Counter = Counter()
        read = 0
        for batch in C.steps(batches, "text"):
            for text in batch.column("text").to_pylist():
                seen.update(_words(text, pattern))
                read += len(text)
            if len(seen) >= TASK_WORDS or read >= TASK_CHARACTERS:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                seen, read = Counter(), 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("pieces", pa.array(piece_counts(batch.column("word").to_pylist(), path), pa.int64()))

    distinct = texts.mapInArrow(mapper, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(count, "word string, n bigint, pieces bigint")


def hot_words(table: DataFrame, hot: int) -> DataFrame:
    """word, pieces of at most `hot` words: all that occur at least as often as the least number of times that fits.

    The numbers of words by the power of two that holds their frequency, and then by the frequency within one power, find
    that number; no task gets more than a row for each."""
    power = F.floor(F.log2(F.col("n").cast("double")))
    sizes = dict(table.groupBy(power.alias("power")).count().collect())  # 64 rows at most
    least, room = 1, hot
    for p in sorted(sizes, reverse=True):
        if sizes[p] > room:
            step = max(1, (1 << p) >> 10)
            inner = dict(table.filter(power == p).groupBy(F.expr(f"n div {step}").alias("part")).count().collect())  # 1024 rows at most
            part = (2 << p) // step
            while (taken := inner.get(part - 1, 0)) <= room and part * step > 1 << p:
                part, room = part - 1, room - taken
            least = part * step
            break
        room -= sizes[p]
    return table.filter(F.col("n") >= least).select("word", "pieces")


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row of docs: id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    texts = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(texts).alias("rk"), F.octet_length(texts).cast("bigint").alias("n_bytes"), texts.alias("text"))
    C.small_batches(spark)
    table = C.written(pre_tokens(source.select("text"), path), "pretokens")
    top = hot_words(table, hot).toArrow()  # `hot` rows at most
    known = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("pieces").to_pylist(), strict=True)))
    kind = source.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row without a word for each row of docs, with what is known; a row for each other word of the document."""
        _, pattern = library(path)
        counts = known.value
        for batch in C.steps(batches, "text"):
            sums, own, words, times = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                total, cold = 0, defaultdict(int)
                for w in _words(text, pattern):
                    n = counts.get(w)
                    if n is None:
                        cold[w] += 1
                    else:
                        total += n
                sums.append(total)
                own += [r] * len(cold)
                words += cold.keys()
                times += cold.values()
            n = batch.num_rows
            take = pa.array([*range(n), *own], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take), batch.column("rk").take(take),
                    pa.array(words and [*batch.column("n_bytes").to_pylist(), *[None] * len(own)] or batch.column("n_bytes").to_pylist(), pa.int64()),
                    pa.array([*[None] * n, *words], pa.string()),
                    pa.array([*sums, *times], pa.int64()),
                ],
                names=["id", "rk", "n_bytes", "word", "n"],
            )

    parts = source.mapInArrow(split, f"id {kind}, rk bigint, n_bytes bigint, word string, n bigint")
    # rows without a word match nothing; a key of their own keeps them apart
    keyed = parts.withColumn("key", F.coalesce("word", F.concat(F.lit("\n\n"), F.col("rk").cast("string"))))
    joined = keyed.join(table.select(F.col("word").alias("key"), "pieces"), "key", "left")
    summed = joined.groupBy("id", "rk").agg(
        F.sum(F.when(F.col("word").isNull(), 1).otherwise(0)).alias("rows"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"),
    )
    # identical rows were summed together
    return summed.select(
        F.col("id").alias(id_column), "n_bytes", F.expr("n_tokens div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_copy")
    ).drop("_copy")
