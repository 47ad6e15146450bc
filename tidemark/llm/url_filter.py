"""URL rules by Bloom filter cascades, in DataFrame functions only.

Rules name a host and a path prefix. The keys that a url could match (ends of its host by the rules' numbers of labels,
starts of its path by the rules' path lengths) form the corpus's complete key universe. For each action a cascade holds
the rules' keys: the first level encodes them, the second the keys of the universe that pass the first by mistake, the
third those listed keys that pass the second, and so on until no mistakes are left. Every key of the universe is then
judged exactly, by looking into a few small arrays. The first level's false positive rate is set against the universe's
size, so the arrays grow with the rules and only with the logarithm of the corpus. Up to LITERAL_WORDS words an array is
a literal of the plan, beyond that a column from a broadcast table of one row; more than FILTER_KEYS rules, whose arrays
would be too large to send to every task, are met by a join of keys instead.

Rules are a list or a table (action, host, path).

Defined cases: a null url, or one without "://", has empty host and path and matches no rule; rules whose key no url
could have cost nothing; repeated rows each get their verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: (action, host, path).
Rule = tuple[str, str, str]
#: Words (64 bits) of a filter in the plan itself, and rules that filters are built for.
LITERAL_WORDS = 4096
FILTER_KEYS = 5_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(shapes: list[tuple[int, int]], host: Column, path: Column) -> list[Column]:
    """One column per shape of rule (labels of the host, length of the path): (length, host length, key), null where the
    url has no such key."""
    labels = F.split(host, r"\.")
    out = []
    for n, size in shapes:
        end = F.array_join(F.slice(labels, -n, n), ".")
        key = F.concat(end, F.substring(path, 1, size))
        fits = (F.size(labels) >= n) & (F.length(path) >= size)
        out.append(F.when(fits, F.struct(F.length(key).alias("size"), F.length(end).alias("host_size"), key.alias("key"))))
    return out


class Level:
    """One Bloom filter: `words` of 64 bits, `k` hash functions salted by the level's number."""

    def __init__(self, number: int, bits: int, k: int, words: list[int]) -> None:
        self.number, self.bits, self.k, self.words = number, bits, k, words

    @staticmethod
    def positions(key: Column, number: int, bits: int, k: int) -> Column:
        """k bits of the filter, from two hashes of the key."""
        start, step = (F.pmod(F.xxhash64(key, F.lit(number), F.lit(j)), F.lit(bits)) for j in (1, 2))
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (start + j * step) % bits)

    @classmethod
    def build(cls, keys: DataFrame, number: int, n: int, rate: float) -> Level:
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        k = max(1, round(bits / max(n, 1) * math.log(2))) if rate < 0.5 else 1
        k = min(k, 32)
        at = keys.select(F.explode(cls.positions(F.col("key"), number, bits, k)).alias("at"))
        word = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("set"))
        words = [0] * (bits // 64 + 1)
        for r in word.collect():  # bits / 64 rows, in proportion to the listed keys
            words[r["word"]] = r["set"]
        return cls(number, bits, k, words)

    def words_column(self, name: str) -> Column:
        """The words: a literal array, or the column `name` that attached() adds."""
        if len(self.words) > LITERAL_WORDS:
            return F.col(name)
        return F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded to one literal array

    def attached(self, rows: DataFrame, name: str) -> DataFrame:
        if len(self.words) <= LITERAL_WORDS:
            return rows
        table = rows.sparkSession.createDataFrame([(self.words, 1)], f"{name} array<bigint>, _one int")
        return rows.withColumn("_one", F.lit(1)).join(F.broadcast(table), "_one").drop("_one")  # one row, FILTER_KEYS bounds it

    def passes(self, key: Column, name: str = "_words") -> Column:
        words = self.words_column(name)
        bit = lambda at: F.call_function("getbit", F.element_at(words, F.floor(at / 64).cast("int") + 1), (at % 64).cast("int"))
        return F.forall(self.positions(key, self.number, self.bits, self.k), lambda at: bit(at) == 1)


class Cascade:
    """Exact membership of listed keys, for every key of the universe it was built on."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> Cascade:
        """listed, universe: key, distinct."""
        levels: list[Level] = []
        rate = min(0.5, n_listed * math.sqrt(0.5) / max(1, n_universe))
        inside, outside, n = listed, universe, n_listed
        while n:
            level = Level.build(inside, len(levels) + 1, n, rate)
            levels.append(level)
            wrong = level.attached(outside, "_words").filter(level.passes(F.col("key"))).select("key")
            if len(levels) == 1:  # the universe also has the listed keys, which pass rightly
                flagged = wrong.withColumn("listed", F.lit(0)).unionByName(listed.withColumn("listed", F.lit(1)))
                wrong = flagged.groupBy("key").agg(F.max("listed").alias("listed")).filter("listed = 0").drop("listed")
            wrong = C.written(wrong, "cascade")
            inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
        return cls(levels)

    def attached(self, rows: DataFrame, name: str) -> DataFrame:
        for level in self.levels:
            rows = level.attached(rows, f"{name}{level.number}")
        return rows

    def holds(self, key: Column, name: str = "_words") -> Column:
        out = F.lit(len(self.levels) % 2 == 1)  # passed all levels
        for level in reversed(self.levels):
            out = F.when(~level.passes(key, f"{name}{level.number}"), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def judged(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages in `row`, with host, path, rule and verdict."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "action string, host string, path string")
    table = table.select("action", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size")).distinct()
    shapes = [(r["labels"], r["size"]) for r in table.select("labels", "size").distinct().orderBy("labels", "size").collect()]  # lengths only
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    keys = F.array_compact(F.array(*candidate_keys(shapes, F.col("host"), F.col("path"))))
    sizes = {r["action"]: r["count"] for r in table.groupBy("action").count().collect()}
    if not sizes:
        return parsed.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if sum(sizes.values()) > FILTER_KEYS:
        return _joined(parsed, keys, table, default)
    universe = C.written(parsed.select(F.explode(keys).alias("k")).select("k.key").distinct(), "universe")
    size = universe.count()
    cascades = {}
    for action in sorted(sizes):
        cascades[action] = Cascade.build(table.filter(F.col("action") == action).select("key").distinct(), universe, sizes[action], size)

    def verdict(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for number, (action, cascade) in enumerate(cascades.items()):
            out = F.when(cascade.holds(k, f"_words{number}_"), action).otherwise(out)
        return out

    for number, cascade in enumerate(cascades.values()):
        parsed = cascade.attached(parsed, f"_words{number}_")
    judged_keys = F.transform(keys, lambda k: F.struct(k["size"].alias("size"), k["host_size"].alias("host_size"), k["key"].alias("key"), verdict(k["key"]).alias("verdict")))
    best = F.array_max(F.filter(judged_keys, lambda k: k["verdict"].isNotNull()))
    return parsed.withColumn("best", best).select(
        "row", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def _joined(parsed: DataFrame, keys: Column, table: DataFrame, default: str) -> DataFrame:
    """judged() for any number of rules: each host and path once, its keys joined with the rules, the longest kept."""
    urls = parsed.select("host", "path").distinct()
    each = urls.select("host", "path", F.explode(keys).alias("k")).select("host", "path", "k.size", "k.host_size", "k.key")
    met = each.join(table.groupBy("key").agg(F.max("action").alias("verdict")), "key")
    best = met.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", "key", "verdict")).alias("best"))
    best = best.select(F.struct("host", "path").alias("of"), "best")
    joined = parsed.join(best, (F.col("host") == F.col("of.host")) & (F.col("path") == F.col("of.path")), "left")
    return joined.select("row", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
