"""Merkle manifest of a dataset: a leaf a row, a tree a group, a tree of the groups' roots over them.

Leaves of a group ascend by id. While several nodes remain, every FAN consecutive ones (the last run may hold fewer, even
one) become the hash of their hex digests joined; the last node is the group's subroot. The subroots, in order of their
groups (null first, then by bytes), become the root the same way.

Rows are hashed where they are read; only digests move. They are sorted by range partitions of (group, id), so that a
group with most of the rows is dealt out, and numbered by adding what the partitions before hold. Blocks of FAN ** LEVELS
consecutive nodes are then reduced side by side, round by round, until at most TOP nodes are left. The driver builds the
tree above these and broadcasts each one's path to the root; every block then joins the paths inside it to the one it
was sent, from the top round down to the rows. A row's path lists, level by level, the digests of its run before and after
it, so a leaf is folded to the root without any other row.

Defined cases: a null field is `-`, so null and empty differ; null groups are one group, before all others; null ids come
first in theirs; rows of equal id are ordered by leaf, and equal rows are each a leaf of their own; a group of one row has
its leaf as subroot; an empty table gives an empty result. A text is hashed whole, whatever its length. Other columns take
no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.llm import common as C

FAN = 3
#: Levels of a block: FAN ** LEVELS nodes are reduced by one task at once.
LEVELS = 7
#: Nodes at most that the driver builds the upper tree from, and whose paths are broadcast (a few KB each).
TOP = 6561

_STEP = "struct<before:string,after:string>"


def leaf_of(*fields: Column) -> Column:
    """The hash of the fields, each as its length in bytes, a colon and its value, or `-`."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*said), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def _depth(size: Column, fan: int) -> Column:
    """Levels that a tree of `size` leaves has above them."""
    powers = [fan**i for i in range(63) if fan**i < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(p).cast("bigint") for p in powers]), lambda p: p < size))


def _levels(nodes: Column, depth: Column, fan: int) -> Column:
    """The nodes, their parents, and so on: depth + 1 arrays."""

    def parents(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fan).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * fan + 1, F.lit(fan)), ""), 256))

    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(nodes), lambda made, _: F.concat(made, F.array(parents(F.element_at(made, -1)))))


def _blocks(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """nodes (tree, pos, size, digest, and more) as one row a block: tree, block, size, nodes in order of pos."""
    rest = [c for c in nodes.columns if c not in ("tree", "pos", "size")]
    each = nodes.select("tree", F.expr(f"pos div {fan**levels}L").alias("block"), "size", F.struct("pos", *rest).alias("node"))
    return each.groupBy("tree", "block").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("node")).alias("nodes"))


def _reduced(blocks: DataFrame, fan: int, levels: int) -> DataFrame:
    """A node a block: tree, pos, size (nodes of the tree that are left), digest."""
    depth = F.least(F.lit(levels), _depth(F.col("size"), fan))
    top = F.element_at(F.element_at(_levels(F.col("nodes.digest"), depth, fan), -1), 1)
    return blocks.select("tree", F.col("block").alias("pos"), "size", top.alias("digest")).withColumn("size", F.expr(f"(size - 1) div {fan**levels}L + 1"))


def _with_paths(blocks: DataFrame, above: DataFrame, fan: int, levels: int) -> DataFrame:
    """The nodes of the blocks with tree, subroot and path; above: the same for the blocks' own nodes (tree, pos, subroot, path)."""
    above = above.select(F.struct("tree", "pos").alias("of"), "subroot", F.col("path").alias("rest"))
    met = blocks.join(above, (F.col("tree") == F.col("of.tree")) & (F.col("block") == F.col("of.pos")))
    depth = F.least(F.lit(levels), _depth(F.col("size"), fan))

    def step(made: Column, i: Column, level: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(float(fan)), level)).cast("int")
        run, row = at - at % fan, F.get(made, level)
        join = lambda start, n: F.array_join(F.slice(row, start, n), "")
        return F.struct(join(run + 1, at - run).alias("before"), join(at + 2, run + fan - 1 - at).alias("after"))

    def rows(made: Column) -> Column:
        heights = F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda level: level < depth)
        return F.transform(F.col("nodes"), lambda x, i: F.struct(x.alias("x"), F.concat(F.transform(heights, lambda level: step(made, i, level)), F.col("rest")).alias("path")))

    each = met.select("tree", "subroot", F.explode(X.let(_levels(F.col("nodes.digest"), depth, fan), rows)).alias("made"))
    return each.select("tree", "subroot", "made.x.*", "made.path")


def _tree(digests: list[str], fan: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over a few digests, and each one's path to it."""
    made = [digests]
    while len(made[-1]) > 1:
        below = made[-1]
        made.append([hashlib.sha256("".join(below[i : i + fan]).encode()).hexdigest() for i in range(0, len(below), fan)])
    paths = []
    for i in range(len(digests)):
        path = []
        for row in made[:-1]:
            run = i - i % fan
            path.append(("".join(row[run:i]), "".join(row[i + 1 : run + fan])))
            i //= fan
        paths.append(path)
    return made[-1][0], paths


def _above(nodes: DataFrame, fan: int, levels: int, top: int) -> tuple[DataFrame, str | None]:
    """tree, pos, subroot, path of the nodes, and the root of all."""
    spark = nodes.sparkSession
    nodes = C.written(nodes, "nodes")
    n = nodes.count()
    if n <= top:
        trees = defaultdict(list)
        for r in sorted(nodes.collect()):  # TOP rows at most
            trees[r["tree"]].append(r["digest"])
        built = {t: _tree(digests, fan) for t, digests in sorted(trees.items(), key=lambda x: x[0].encode())}
        root, over = _tree([made[0] for made in built.values()], fan) if built else (None, [])
        rows = [(t, pos, made[0], path + rest) for (t, made), rest in zip(built.items(), over, strict=True) for pos, path in enumerate(made[1])]
        return F.broadcast(spark.createDataFrame(rows, f"tree string, pos bigint, subroot string, path array<{_STEP}>")), root
    if nodes.filter("size > 1").isEmpty():  # only the groups' roots are left, too many for the driver
        ranked = _numbered(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf")))
        blocks = C.written(_blocks(ranked.withColumnRenamed("leaf", "digest"), fan, levels), "blocks")
        made, root = _above(_reduced(blocks, fan, levels), fan, levels, top)
        found = _with_paths(blocks, made, fan, levels)
        return found.select(F.col("id").alias("tree"), F.lit(0).cast("bigint").alias("pos"), F.col("digest").alias("subroot"), "path"), root
    blocks = C.written(_blocks(nodes, fan, levels), "blocks")
    made, root = _above(_reduced(blocks, fan, levels), fan, levels, top)
    return _with_paths(blocks, made, fan, levels).select("tree", "pos", "subroot", "path"), root


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (tree, id, leaf, and more) with pos, the place in the tree by (id, leaf), and size, the rows of the tree."""
    order = ["tree", "id", "leaf", "_at"]
    spread = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    spread = C.written(spread.withColumn("_row", F.monotonically_increasing_id()), "ranged")  # partition and row, in one number
    spread = spread.withColumn("_part", F.shiftright("_row", 33))
    parts = spread.groupBy("tree", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of_tree = Window.partitionBy("tree")  # a row a partition
    before = F.coalesce(F.sum("_n").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "_part", "_first", before.alias("_before"), F.sum("_n").over(of_tree).alias("size"))
    placed = spread.join(parts, ["tree", "_part"])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("pos"), "size")


def proofs(
    docs: DataFrame, fields: tuple[str, ...], group: str = "source", id_column: str = "doc_id", carry: dict[str, Column] | None = None,
    fan: int = FAN, levels: int = LEVELS, top: int = TOP,
) -> DataFrame:
    """id, leaf, subroot, root, path (before and after of each level, leaf upwards), and what `carry` makes of each row."""
    since = C.mark()
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    leaf = leaf_of(*[F.col(f"`{f}`") for f in fields])
    also = F.struct(F.lit(None).alias("_"), *[made.alias(name) for name, made in carry.items()])
    leaves = C.written(docs.select(tree.alias("tree"), F.col(f"`{id_column}`").alias("id"), leaf.alias("leaf"), also.alias("also")), "leaves")
    numbered = _numbered(leaves).withColumnRenamed("leaf", "digest")
    blocks = C.written(_blocks(numbered.select("tree", "pos", "size", "id", "digest", "also"), fan, levels), "blocks")
    C.dropped(docs.sparkSession, since, keep=(blocks,))
    above, root = _above(_reduced(blocks, fan, levels), fan, levels, top)
    found = _with_paths(blocks, above, fan, levels)
    kept = [F.col(f"also.`{name}`").alias(name) for name in carry]
    return found.select(F.col("id").alias(id_column), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", *kept)
