"""Shards by best-fit-decreasing bin packing.

Equal texts are one indivisible group. Groups sorted by size, largest first, enter the open shard with the least
remaining capacity that still takes them, found in a balanced tree. Groups of one size are alike, so packing works on
sizes and their numbers: a run of equal groups fills the tightest shard until it takes no more, which is what placing
them one by one does. Sizes are exact below EXACT bytes and from 1/1024 of a shard on; between, classes of 1/256 width
count as their largest member. So the packer sees at most about a hundred thousand classes, however many documents there
are, and groups are told apart only where they are: each has a rank in its class, ranges of ranks belong to shards.

Defined cases: a null text has no bytes and is a group with other nulls, apart from the empty text; every row, repeated
or not, gets its own slot; null ids are placed like others; an empty table gives an empty result. A group larger than
the mean shard has a shard of its own, and the others share the rest evenly.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

SHARDS = 24
ROW_OVERHEAD = 8
EXACT = 1 << 16
#: Parts of a class, or of a shard, that are numbered apart.
SALTS = 64


class CapacityTree:
    """A treap of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root: list | None = None

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Keys below `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        less, node[2] = self._split(node[2], key)
        return less, node

    def add(self, remaining: int, shard: int) -> None:
        less, rest = self._split(self.root, (remaining, shard))
        priority = (shard * 0x9E3779B97F4A7C15 + remaining * 0xBF58476D1CE4E5B9) % (1 << 61)
        self.root = self._merge(self._merge(less, [(remaining, shard), priority, None, None]), rest)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least key that has room for `size`."""
        less, rest = self._split(self.root, (size, -1))
        if rest is None:
            self.root = less
            return None
        node, above = rest, None
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            rest = node[3]
        else:
            above[2] = node[3]
        self.root = self._merge(less, rest)
        return node[0]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, shards: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, groups placed, shard) in placing order, for sizes with numbers of groups, largest first.

    Without `shards`, new ones are opened as needed; with it, that many are open and None means that not all fits.
    """
    tree, cuts, opened = CapacityTree(), [], 0
    for opened in range(shards or 0):
        tree.add(capacity, opened)
    opened = shards or 0
    for size, left in sizes:
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if shards is not None:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            remaining, shard = found
            n = min(left, remaining // size)
            cuts.append((size, n, shard))
            tree.add(remaining - n * size, shard)
            left -= n
    return cuts


def even_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Best fit decreasing into exactly `shards`, of the least capacity (in steps of doubled slack) that takes all."""
    cuts, free, total = [], shards, sum(s * n for s, n in sizes)
    sizes = [list(x) for x in sizes]
    while free > 1 and sizes and sizes[0][0] * free > total:  # larger than the mean: a shard of its own
        size = sizes[0][0]
        free -= 1
        cuts.append((size, 1, free))
        total -= size
        sizes[0][1] -= 1
        if not sizes[0][1]:
            sizes.pop(0)
    rest, least = [(s, n) for s, n in sizes], -(-total // free)
    slack = 0
    while (packed := best_fit_decreasing(rest, least + slack, free)) is None:
        slack = max(16, 2 * slack)
    return cuts + packed


def _class_of(size: Column, big: int) -> Column:
    """The class of a group's size: the size itself, or the upper end of a class of 1/256 width."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 8).cast("bigint")
    upper = F.expr("0") + F.ceil(size / step) * step
    return F.when((size < EXACT) | (size >= big), size).otherwise(upper.cast("bigint"))


def placed(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    texts = F.col(f"`{text}`").cast("string")
    whole = F.coalesce(texts, F.lit(""))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        (F.octet_length(whole) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(texts.cast("binary"))), F.lit(b"")).alias("key"),
    )
    groups = C.written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    big = max(EXACT, total // shards // 1024)
    classed = groups.select("key", _class_of(F.col("bytes"), big).alias("class"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    salted = classed.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = C.written(salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    sizes = [(r[0], r[1]) for r in offsets.groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("class")).collect()]  # classes only

    upto: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size, n, shard in even_shards(sizes, shards):
        upto[size].append(((upto[size][-1][0] if upto[size] else 0) + n, shard))
    cuts = spark.createDataFrame(list(upto.items()), "class bigint, cuts array<struct<upto:bigint,shard:int>>")
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("key")) - 1
    ranked = classed.withColumn("rank", rank).join(offsets.select("class", "salt", "before"), ["class", "salt"])
    of = F.col("before") + F.col("rank")
    assigned = ranked.join(F.broadcast(cuts), "class").select("key", F.filter("cuts", lambda c: of < c["upto"])[0]["shard"].alias("shard"))

    placed_rows = C.written(rows.join(assigned, "key").withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS))), "placed")
    counts = placed_rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # shards x SALTS rows
    place = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("id", "key")) - 1
    out = placed_rows.withColumn("place", place).join(F.broadcast(starts), ["shard", "salt"])
    return out.select(F.col("id").alias(id_column), "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot"))
