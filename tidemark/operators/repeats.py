"""Nearly equal sentences: ordered word overlap by matching blocks, and texts without their repeats.

The overlap of two word sequences is counted in blocks: the longest run of words that both have (of equal ones the
earliest in the first, then in the second), then the same to its left and to its right, and so on. A batch of pairs is
worked off together, a level of these blocks at a time, on arrays of word hashes.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.operators.text_rules import MOST_DROPS, text_parts
from tidemark.plans.registry import query
from tidemark.sources.tables import read_table

#: Words from which a sentence is judged at all, and the share from which it repeats another.
LEAST_WORDS, NEAR_EXACT = 4, 0.9
#: Cells of the table of common runs that are held at once.
CELLS = 1 << 20
#: Pairs of sentences that are compared at once.
PAIRS = 20_000


def _padded(words: np.ndarray, low: np.ndarray, high: np.ndarray, filler: int) -> tuple[np.ndarray, np.ndarray]:
    """words[low:high] of each row, side by side, and which places are real."""
    place = np.arange(int((high - low).max()))[None, :]
    real = place < (high - low)[:, None]
    return np.where(real, words[np.minimum(low[:, None] + place, len(words) - 1)], filler), real


def _longest(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, and start in a and in b, of the longest common run of a[at0:at1] and b[at2:at3] for each row of `at`."""
    one, real = _padded(a, at[:, 0], at[:, 1], 0)
    other, there = _padded(b, at[:, 2], at[:, 3], 0)
    n, width = other.shape
    size, in_a, in_b = (np.zeros(n, np.int64) for _ in range(3))
    run = np.zeros((n, width + 1), np.int32)
    for i in range(one.shape[1]):
        same = (other == one[:, i, None]) & there & real[:, i, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        where = run[:, 1:].argmax(axis=1)
        most = run[np.arange(n), where + 1]
        better = most > size
        size[better], in_a[better], in_b[better] = most[better], i + 1 - most[better], where[better] + 1 - most[better]
    return size, at[:, 0] + in_a, at[:, 2] + in_b


def matching_blocks(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The matching blocks of each pair of sequences: the pair, and start in a, start in b and size, in no order."""
    ends = [np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in (a, b)]
    words = [np.concatenate([np.asarray(x, np.int64) for x in side]) if len(side) else np.zeros(0, np.int64) for side in (a, b)]
    at = np.stack([ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:]], axis=1)
    pair = np.arange(len(a))
    blocks, of_pair = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        both = (at[:, 1] > at[:, 0]) & (at[:, 3] > at[:, 2])
        at, pair = at[both], pair[both]
        order = np.argsort((at[:, 3] - at[:, 2]) * 100_000 + at[:, 1] - at[:, 0], kind="stable")  # alike ones together
        at, pair = at[order], pair[order]
        width = at[:, 3] - at[:, 2]
        rest, of = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)]
        first = 0
        while first < len(at):
            last = first + 1
            while last < len(at) and (last + 1 - first) * width[last] <= CELLS and width[last] <= 2 * width[first] + 8:
                last += 1
            part, own = at[first:last], pair[first:last]
            size, in_a, in_b = _longest(words[0], words[1], part)
            found = size > 0
            part, own, size, in_a, in_b = part[found], own[found], size[found], in_a[found], in_b[found]
            blocks.append(np.stack([in_a - ends[0][own], in_b - ends[1][own], size], axis=1))
            of_pair.append(own)
            rest += [np.stack([part[:, 0], in_a, part[:, 2], in_b], axis=1), np.stack([in_a + size, part[:, 1], in_b + size, part[:, 3]], axis=1)]
            of += [own, own]
            first = last
        at, pair = np.concatenate(rest), np.concatenate(of)
    return np.concatenate(of_pair), np.concatenate(blocks)


def matched_words(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of sequences, the words in their matching blocks."""
    pair, blocks = matching_blocks(a, b)
    return np.bincount(pair, weights=blocks[:, 2], minlength=len(a)).astype(np.int64)


def changed_ranges(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[list[list[int]], list[list[int]]]]:
    """For each pair of sequences, the ranges (first, end) of a and of b between their matching blocks; one of two may be empty."""
    pair, blocks = matching_blocks(a, b)
    order = np.lexsort((blocks[:, 0], pair))
    each = np.split(blocks[order], np.searchsorted(pair[order], np.arange(1, len(a)))) if len(a) else []
    out = []
    for x, y, held in zip(a, b, each, strict=True):
        edges = np.concatenate([[[0, 0, 0]], held, [[len(x), len(y), 0]]])
        ranges = np.stack([edges[:-1, 0] + edges[:-1, 2], edges[1:, 0], edges[:-1, 1] + edges[:-1, 2], edges[1:, 1]], axis=1)
        ranges = ranges[(ranges[:, 1] > ranges[:, 0]) | (ranges[:, 3] > ranges[:, 2])]
        out.append((ranges[:, :2].tolist(), ranges[:, 2:].tolist()))
    return out


@F.pandas_udf(T.LongType())
def matched(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words in the matching blocks of two arrays of word hashes."""
    return pd.Series(matched_words(list(a), list(b)))


def ordered_share(a: Column, b: Column) -> Column:
    """Twice the matched words by all words of two arrays of word hashes; null if one has fewer than LEAST_WORDS."""
    judged = (F.size(a) >= LEAST_WORDS) & (F.size(b) >= LEAST_WORDS)
    none = F.array().cast("array<bigint>")
    held = lambda w: F.when(judged, w).otherwise(none)
    return F.when(judged, 2 * matched(held(a), held(b)) / (F.size(a) + F.size(b)))


def _hashed_words(text: Column, pattern: str = r"\S+") -> Column:
    return X.hashed(X.words(text, pattern))


@query("txt_dice_ordered")
def txt_dice_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, dice of each turn with the one before, by matching blocks of words (four words or more), and whether
    they are nearly the same (0.9 or more)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", _hashed_words(F.col("text")).alias("w"))
    pairs = turns.withColumn("before", F.lag("w").over(order)).filter("before IS NOT NULL")
    scored = pairs.select("conv_id", "turn", F.round(ordered_share(F.col("w"), F.col("before")), 6).alias("dice"))
    return scored.withColumn("near_exact", F.coalesce(F.col("dice") >= NEAR_EXACT, F.lit(False)))


def near_exact_pairs(words: list[np.ndarray], share: float = NEAR_EXACT) -> list[tuple[int, int]]:
    """Pairs a, b of sequences, the first by which the ordered share is told, that share `share` or more in order.

    The words matched in order are at most those in common, so two such sentences share one of the first few words in
    order of rarity, each word told apart by how often it came before. Sizes bound the share once more; only what is left
    is compared in order.
    """
    least = share / (2 - share)  # of a sentence's words must be in the other
    numbered = []
    for w in words:
        seen: Counter = Counter()
        numbered.append([(t, seen.update((t,)) or seen[t]) for t in w.tolist()])
    df = Counter(t for each in numbered for t in each)
    holders, met = defaultdict(list), set()
    for b, each in enumerate(numbered):
        for t in sorted(each, key=lambda t: (df[t], t))[: len(each) - math.ceil(len(each) * least) + 1]:
            met.update((a, b) for a in holders[t] if 2 * min(len(words[a]), len(each)) >= share * (len(words[a]) + len(each)) - 1e-9)
            holders[t].append(b)
    pairs, out = sorted(met), []
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        same = matched_words([words[b] for _, b in part], [words[a] for a, _ in part])
        out += [p for p, n in zip(part, same, strict=True) if 2 * n / (len(words[p[0]]) + len(words[p[1]])) >= share]
    return out


def _near_of_texts(share: float):  # noqa: ANN202
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def near(words: pd.Series, ids: pd.Series) -> pd.Series:
        """For each sentence of a text (its words' hashes, null: not judged, and their hash) the others like it, null if it
        comes but once and has none; null for a text without any."""
        out = []
        for w, own in zip(words, ids, strict=True):
            own = [None if x is None else int(i) for x, i in zip(w, own, strict=True)]  # without nulls, which would make the hashes floats
            times = Counter(i for i in own if i is not None)
            first = {i: k for k, i in reversed(list(enumerate(own))) if i is not None}
            each = sorted(times)
            found = defaultdict(list)
            for a, b in near_exact_pairs([np.asarray(w[first[i]], np.int64) for i in each], share):
                found[each[a]].append(each[b]), found[each[b]].append(each[a])
            judged = {i for i in each if times[i] > 1 or i in found}
            out.append([found.get(i, []) if i in judged else None for i in own] if judged else None)
        return pd.Series(out, dtype=object)

    return near


def without_near_repeats(rows: DataFrame, key: str, text: str = "text", floor: int = 0, share: float = NEAR_EXACT, most: int = MOST_DROPS) -> DataFrame:
    """key, dropped, text: sentences that repeat an earlier one that is still there, nearly or exactly, go one by one in
    their order, `most` a text at most (the rule's own limit), as long as the text keeps `floor` characters; sentences of
    fewer than LEAST_WORDS words are never judged. Rows of a null text have a null text. A text's sentences stay together in
    its row, so nothing is shuffled."""
    named, rows, key, text = key, rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text"
    cut = rows.filter(F.col(text).isNotNull()).withColumn("cut", text_parts(F.col(text)))
    cut = cut.withColumn("words", F.transform("cut", lambda p: _hashed_words(F.regexp_replace(p, r"^\s+|\s+$", ""), r"[\p{L}\p{N}]+")))
    cut = cut.withColumn("words", F.transform("words", lambda w: F.when(F.size(w) >= LEAST_WORDS, w)))
    cut = cut.withColumn("ids", F.transform("words", lambda w: F.xxhash64(w)))
    marked = cut.select(key, text, "cut", "ids", _near_of_texts(share)("words", "ids").alias("near"))
    parts = F.transform("cut", lambda p, i: F.struct(i.alias("pos"), p.alias("part"), F.get("near", i).alias("near"), F.get("ids", i).alias("id")))
    whole = marked.select(key, text, F.col("near").isNotNull().alias("judged"), parts.alias("parts"))
    size = F.aggregate("parts", F.lit(0), lambda n, p: n + F.length(p["part"]))
    state = F.struct(size.alias("left"), F.array().cast("array<bigint>").alias("seen"), F.array().cast("array<int>").alias("gone"))

    def step(s: Column, p: Column) -> Column:
        again = F.array_contains(s["seen"], p["id"]) | F.arrays_overlap(s["seen"], p["near"])
        goes = F.coalesce(again, F.lit(False)) & (F.size(s["gone"]) < most) & (s["left"] - F.length(p["part"]) >= floor)
        stays = F.struct(s["left"].alias("left"), F.array_union(s["seen"], F.array(p["id"])).alias("seen"), s["gone"].alias("gone"))
        cut = F.struct((s["left"] - F.length(p["part"])).alias("left"), s["seen"].alias("seen"), F.concat(s["gone"], F.array(p["pos"])).alias("gone"))
        return F.when(goes, cut).otherwise(stays)

    folded = F.aggregate(F.filter("parts", lambda p: p["near"].isNotNull()), state, step)
    kept = whole.withColumn("gone", F.when(F.col("judged"), folded["gone"]).otherwise(F.array().cast("array<int>")))
    texts = F.array_join(F.transform(F.filter("parts", lambda p: ~F.array_contains(F.col("gone"), p["pos"])), lambda p: p["part"]), "")
    made = kept.select(key, F.size("gone").cast("bigint").alias("dropped"), F.when(F.size("gone") > 0, texts).otherwise(F.col(text)).alias("text"))
    empty = rows.filter(F.col(text).isNull()).select(key, F.lit(0).cast("bigint").alias("dropped"), F.lit(None).cast("string").alias("text"))
    return made.unionByName(empty).withColumnRenamed(key, named)


#: Characters that the catalogue's query leaves in a text.
FLOOR = 400


@query("txt_repeat_drop")
def txt_repeat_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_near_repeats(read_table(spark, sf_dir, "documents"), "doc_id", floor=FLOOR).select("doc_id", "dropped", F.md5("text").alias("text"))
