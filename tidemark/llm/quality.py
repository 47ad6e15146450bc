"""Quality rules by weak supervision.

Each rule reads whole-text statistics and votes good (1), bad (-1) or abstains (0). The corpus-wide counts of vote
patterns (at most 3 ** number of rules) feed an expectation-maximisation that estimates how far each rule can be
trusted in good and in bad documents; a document is kept when its posterior probability of being good reaches a
threshold. Hard limits (too few words, too many repeated words) reject on their own.

Rules judge shares and rates, so none behaves otherwise for long texts. The rule of function words knows the languages
of STOP_WORDS and abstains on texts in other scripts.

Defined cases: a null text has no words, as an empty one; both fail the base limits. Null ids stay null, repeated
rows each get their own result, an empty table gives an empty result, other columns pass through untouched. A text is
counted whole, in the memory of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WIDTH = 8
THRESHOLD = 0.5

#: Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = (
    "the and of to in is that for it was on are as with "
    "der die das und in zu den von mit ist auf ein eine "
    "le la les de des et un une est que qui dans pour "
    "el los las del y en por con para se su "
    "il di che non per sono una della "
    "o os as do da em um uma no na "
    "het een van op te dat niet zijn"
).split()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_distinct", "n_stop", "n_bare", "n_upper", "n_letters", "n_shouts")
STATS = COUNTS + EXTRA

#: name, good when, bad when (on the statistics; abstain between).
Rule = tuple[str, Column, Column]


def rules() -> list[Rule]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    share = lambda name: F.col(name) / words
    variety = F.log(F.greatest(F.col("n_distinct"), F.lit(1))) / F.log(F.greatest(words, F.lit(2)))  # hardly falls with the length
    latin = 2 * F.col("n_letters") >= F.col("word_chars")
    mean_length = share("word_chars")
    upper = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    return [
        ("length", F.col("n_words") >= 50, F.col("n_words") < MIN_WORDS),
        ("word_length", mean_length.between(3.5, 6.5), ~mean_length.between(2.0, 9.0)),
        ("symbols", share("n_symbols") < 0.01, share("n_symbols") >= 0.1),
        ("bare_words", share("n_bare") < 0.02, share("n_bare") >= 0.15),
        ("repeats", share("n_repeat_words") < 0.05, share("n_repeat_words") >= 0.25),
        ("variety", variety >= 0.8, variety < 0.7),
        ("dup_lines", F.col("n_dup_lines") / lines < 0.05, F.col("n_dup_lines") / lines >= 0.5),
        ("capitals", upper < 0.2, upper >= 0.6),
        ("shouting", share("n_shouts") < 0.05, share("n_shouts") >= 0.3),
        ("stop_words", share("n_stop") >= 0.05, (share("n_stop") < 0.01) & latin),
    ]


def _summed(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _of_set(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode())] = True
    return out


def statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each row."""
    rows = len(at) - 1
    start, end, first = C.word_spans(data, at, C.PLAIN_WORD)
    words = C.span_hashes(data, start, end, C.byte_values())
    in_word = C.PLAIN_WORD[data]
    row_of = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    salt = C.mixed(np.arange(rows, dtype=np.uint64) + np.uint64(1))

    out = {"n_words": np.diff(first), "word_chars": _summed(in_word & ((data & 0xC0) != 0x80), at)}
    out["n_symbols"] = _summed(_of_set("#*$%&|<>")[data], at)

    # lines with a word
    new_line = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], new_line + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.append(begin[1:], len(data)), len(data))
    cut = np.searchsorted(new_line, begin)
    stop = np.minimum(stop, np.append(new_line, len(data))[cut])
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[has_word], stop[has_word]
    line_row = np.searchsorted(at, begin, side="right") - 1
    line = np.unique(C.mixed(C.span_hashes(data, begin, stop, C.byte_values()) ^ salt[line_row]), return_index=True)[1]
    out["n_lines"] = np.bincount(line_row, minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[line], minlength=rows)

    # words inside windows that occur twice or more in the text
    window, pos, row = C.window_hashes(words, first, REPEAT_WIDTH)
    _, back, count = np.unique(window ^ salt[row], return_inverse=True, return_counts=True)
    again = pos[count[back] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + REPEAT_WIDTH, -1)
    out["n_repeat_words"] = _summed(np.cumsum(edge[:-1]) > 0, first)

    distinct = np.unique(C.mixed(words ^ salt[row_of]), return_index=True)[1]
    out["n_distinct"] = np.bincount(row_of[distinct], minlength=rows)
    lower = C.span_hashes(data, start, end, C.byte_values(lower=True))
    stops = np.frombuffer("".join(STOP_WORDS).encode(), np.uint8)
    stop_end = np.cumsum([len(w) for w in STOP_WORDS])
    known = C.span_hashes(stops, np.append(0, stop_end[:-1]), stop_end, C.byte_values())
    out["n_stop"] = _summed(np.isin(lower, known), first)
    total = np.append(0, np.cumsum(C.ALNUM_WORD[data]))
    out["n_bare"] = _summed(total[end] == total[start], first)
    is_upper, is_lower = np.zeros(256, bool), np.zeros(256, bool)
    is_upper[65:91] = is_lower[97:123] = True
    out["n_upper"] = _summed(is_upper[data], at)
    out["n_letters"] = out["n_upper"] + _summed(is_lower[data], at)
    out["n_shouts"] = _summed(data == 33, at)
    return {name: out[name].astype(np.int64) for name in STATS}


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One struct column `row` with the columns of docs, and the STATS."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([source.schema["row"], *[T.StructField(n, T.LongType()) for n in STATS]])
    C.small_batches(docs.sparkSession)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            made = statistics(*C.bytes_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(made[n]) for n in STATS]], names=["row", *STATS])

    return source.mapInArrow(mapper, schema)


def with_votes(stats: DataFrame) -> DataFrame:
    """Add base_failed and the votes packed base 3 into `pattern`."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    vote = lambda good, bad: F.when(bad, 0).when(good, 2).otherwise(1)
    pattern = sum((vote(good, bad) * 3**i for i, (_, good, bad) in enumerate(rules())), F.lit(0))
    return stats.withColumns({"base_failed": failed, "pattern": pattern.cast("int")})


def fitted(patterns: list[tuple[int, int]], n_rules: int, rounds: int = 50) -> dict:
    """Expectation-maximisation over (pattern, count): prior of good, each rule's vote rates per class, posteriors.

    A rule's rates start from (and are held near, by pseudo-counts in proportion to the corpus) the belief that it is
    far more often right than wrong when it votes, which also fixes which class is called good.
    """
    if not patterns:
        return {"prior": 0.5, "rates": None, "posterior": {}}
    codes = np.array([p for p, _ in patterns], np.int64)
    weight = np.array([n for _, n in patterns], float)
    votes = np.stack([codes // 3**i % 3 for i in range(n_rules)], 1)  # 0 bad, 1 abstain, 2 good
    believed = np.array([[0.30, 0.30, 0.40], [0.01, 0.29, 0.70]])  # class bad, good
    held = 0.02 * weight.sum()
    rates = np.repeat(believed[:, None, :], n_rules, 1)
    prior = 0.8
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[:, None] + sum(np.log(rates[:, j, votes[:, j]]) for j in range(n_rules))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        by_class = np.stack([(1 - good) * weight, good * weight])
        seen = np.stack([[np.bincount(votes[:, j], by_class[c], 3) for j in range(n_rules)] for c in (0, 1)])
        rates = (seen + held * believed[:, None, :]) / (by_class.sum(1)[:, None, None] + held)
        prior = (by_class[1].sum() + 1) / (weight.sum() + 2)
    return {"prior": float(prior), "rates": rates, "posterior": {int(c): float(p) for c, p in zip(codes, good, strict=True)}}


def judged(voted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add posterior and kept. The model is fitted to all rows that pass the base limits, as the others are decided
    already and would teach it one kind of failure only. `voted` is read twice, so it should be a written table."""
    counts = [(r[0], r[1]) for r in voted.filter("NOT base_failed").groupBy("pattern").count().collect()]  # at most 3 ** rules rows
    model = fitted(counts, len(rules()))
    spark = voted.sparkSession
    table = spark.createDataFrame([(k, v) for k, v in model["posterior"].items()], "pattern int, posterior double")
    return voted.join(F.broadcast(table), "pattern", "left").withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold)
    )


def quality_scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, COUNTS, base_failed, kept, posterior, votes pattern."""
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    stats = with_statistics(narrow).select(F.col("row.id").alias(id_column), *STATS)
    voted = C.written(with_votes(stats), "quality")
    return judged(voted, threshold).select(id_column, *COUNTS, "base_failed", "kept", "posterior", "pattern")


def quality_filter(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, columns unchanged; texts are read once, rows that may be kept are written once."""
    voted = with_votes(with_statistics(docs, text)).filter("NOT base_failed").select("row", "base_failed", "pattern")
    return judged(C.written(voted, "quality"), threshold).filter("kept").select("row.*")
