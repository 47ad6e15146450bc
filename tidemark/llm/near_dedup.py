"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

A document's set holds the distinct word shingles of its whole lower-cased text. Under each permutation the smallest and
the largest value are kept, so PERMUTATIONS hash evaluations give twice as many signature values. Documents that agree on
a band of BAND_ROWS values are candidates; a pair that is linked at a threshold of 85 % escapes all 20 bands about 5 times
in 10^9, at 80 % about 6 times in 10^7.

Texts with the same words are one node from the start. Every bucket has a hub, its member that meets the most nodes over
all bands (of a group of edited copies, that is the text they were edited from). Members are compared with their hub
only; links are confirmed on full sets and joined into components. That leaves pairs under one hub in different
components. Each set is written as its difference from the hub: of two such sets, linked ones must share more than about
half of the smaller difference. So a prefix-filtered join of the differences (rarest shingles of the group first) finds the remaining links exactly, while copies that were edited in unrelated places never meet.
A pair whose 60 signature values agree less than six standard deviations below the threshold is not linked to its hub.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; a null id is never the
smallest id of a component unless there is no other; identical rows are linked and all flagged kept when they carry the
component's id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

SHINGLE = 5
PERCENT = 80
PERMUTATIONS = 30
BAND_ROWS = 3
_VALUES = 2 * PERMUTATIONS


def shingle_sets(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles, ordered by row; words; first word of each row."""
    start, end, first = C.word_spans(data, at, C.PLAIN_WORD)
    words = C.span_hashes(data, start, end, C.byte_values(lower=True))
    hashes, _, row = C.window_hashes(words, first, shingle)
    size = np.diff(first)
    found = [(row, hashes)]
    for width in range(1, shingle):
        short = np.flatnonzero(size == width)
        with np.errstate(over="ignore"):
            total = np.zeros(len(short), np.uint64)
            for i in range(width):
                total = total * np.uint64(C._BASE) + words[first[short] + i]
            found.append((short, C.mixed(total + np.uint64(width))))
    row, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))[: len(row)]
    return row[new], hashes[new], words, first


def signatures(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per row that has shingles: minimum and maximum under each permutation, the high 32 bits."""
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    out = np.empty((len(begin), _VALUES), np.uint32)
    for i in range(PERMUTATIONS):
        with np.errstate(over="ignore"):
            salt = C.mixed(np.array([2 * i + 1, 2 * i + 2], np.uint64))
            value = (hashes ^ salt[0]) * (salt[1] | np.uint64(1))
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, 2 * i] = np.minimum.reduceat(value, begin) >> np.uint64(32)
        out[:, 2 * i + 1] = np.maximum.reduceat(value, begin) >> np.uint64(32)
    return out


def _node_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each row's sequence of words."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out = np.empty((len(first) - 1, 2), np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        with np.errstate(over="ignore"):
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(C.mixed(words ^ C.mixed(place.astype(np.uint64) + np.uint64(salt))), out=total[1:])
            out[:, k] = total[first[1:]] - total[first[:-1]]
    return out


def sketched(docs: DataFrame, id_column: str, text: str, shingle: int) -> DataFrame:
    """id, rk (hash of id and text), node (null without words), n_shingles, sig: of each row."""
    ids, texts = F.col(f"`{id_column}`").cast("bigint"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(ids.alias("id"), F.xxhash64(ids, texts).alias("rk"), texts.alias("text"))
    C.small_batches(docs.sparkSession)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            data, at = C.bytes_of(batch.column("text"))
            rows, hashes, words, first = shingle_sets(data, at, shingle)
            n = batch.num_rows
            count = np.bincount(rows, minlength=n)
            node, sig = [None] * n, [None] * n
            if len(rows):
                keys = _node_keys(words, first)
                for r, s in zip(np.flatnonzero(count).tolist(), signatures(rows, hashes), strict=True):
                    node[r], sig[r] = keys[r].tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rk"), pa.array(node, pa.binary()), pa.array(count.astype(np.int64)), pa.array(sig, pa.binary())],
                names=["id", "rk", "node", "n_shingles", "sig"],
            )

    return source.mapInArrow(mapper, "id bigint, rk bigint, node binary, n_shingles bigint, sig binary")


def _agreement(a: str, b: str) -> Column:
    return sum((F.substring(a, 4 * i + 1, 4) == F.substring(b, 4 * i + 1, 4)).cast("int") for i in range(_VALUES))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a, text_b; texts: node, text."""
    text = lambda of: texts.select(F.col("node").alias(of), F.col("text").alias(f"text_{of}"))
    return pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")


def _sets(batch: pa.RecordBatch, column: str, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, and hash salted by the row, of each distinct shingle."""
    row, hashes, _, _ = shingle_sets(*C.bytes_of(batch.column(column)), shingle)
    return row, hashes, C.mixed(hashes ^ C.mixed(row.astype(np.uint64) + np.uint64(1)))


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have percent of their union in common; nodes: node, sig; texts: node, text."""
    j = percent / 100
    least = int(max(1, np.floor(_VALUES * j - 6 * np.sqrt(_VALUES * j * (1 - j)))))
    side = lambda of: nodes.select(F.col("node").alias(of), F.col("sig").alias(f"sig_{of}"))
    likely = pairs.join(side("b"), "b").join(side("a"), "a").filter(_agreement("sig_a", "sig_b") >= least).select("a", "b")

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text_b"):
            (row_a, _, of_a), (row_b, _, of_b) = (_sets(batch, c, shingle) for c in ("text_a", "text_b"))
            common = np.bincount(row_b[np.isin(of_b, of_a)], minlength=batch.num_rows)
            union = np.bincount(row_a, minlength=batch.num_rows) + np.bincount(row_b, minlength=batch.num_rows) - common
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= percent * union))

    return _with_texts(likely, texts).mapInArrow(mapper, "a binary, b binary")


def differences(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """a, b, n (size of b's set), diff: hashes that b adds to a's set, and those that it lacks."""

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text_b"):
            (row_a, hash_a, of_a), (row_b, hash_b, of_b) = (_sets(batch, c, shingle) for c in ("text_a", "text_b"))
            added, lacking = ~np.isin(of_b, of_a), ~np.isin(of_a, of_b)
            row = np.concatenate([row_b[added], row_a[lacking]])
            order = np.argsort(row, kind="stable")
            hashes = np.concatenate([hash_b[added], hash_a[lacking]])[order].view(np.int64)
            at = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
            diff = pa.ListArray.from_arrays(pa.array(at), pa.array(hashes))
            n = pa.array(np.bincount(row_b, minlength=batch.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), n, diff], names=["a", "b", "n", "diff"])

    return _with_texts(pairs, texts).mapInArrow(mapper, "a binary, b binary, n bigint, diff array<bigint>")


def under_roots(spokes: DataFrame, met: DataFrame) -> DataFrame:
    """spokes (hub, node) with every hub replaced by the best hub that it is itself a spoke of, and so on upwards.

    A group of copies has buckets that its best hub is not in; their own hubs hang under it.
    """
    hubs = spokes.select("hub").distinct()
    of = lambda name: met.select(F.col("node").alias(name), F.col("met").alias(f"met_{name}"))
    up = spokes.join(hubs.select(F.col("hub").alias("node")), "node").join(of("hub"), "hub").join(of("node"), "node")
    up = up.filter(F.struct("met_hub", "hub") > F.struct(F.col("met_node"), F.col("node")))
    parents = C.written(up.groupBy("node").agg(F.max(F.struct("met_hub", "hub"))["hub"].alias("parent")), "parents")
    roots = hubs.join(parents.withColumnRenamed("node", "hub"), "hub", "left").select("hub", F.coalesce("parent", "hub").alias("root"))
    for _ in range(3):
        above = parents.select(F.col("node").alias("root"), "parent")
        roots = roots.join(above, "root", "left").select("hub", F.coalesce("parent", "root").alias("root"))
    roots = C.written(roots, "roots")
    moved = spokes.join(roots, "hub").select(F.col("root").alias("hub"), "node")
    return moved.union(roots.select(F.col("root").alias("hub"), F.col("hub").alias("node"))).filter("hub != node").distinct()


def links_beside_hubs(spokes: DataFrame, labels: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes under one hub that are in different components; spokes: hub, node; labels: node, label."""
    label_of = lambda name, to: labels.select(F.col("node").alias(name), F.col("label").alias(to))
    named = spokes.join(label_of("node", "label"), "node", "left").join(label_of("hub", "of_hub"), "hub", "left")
    named = named.withColumns({"label": F.coalesce("label", "node"), "of_hub": F.coalesce("of_hub", "hub")})
    named = C.written(named.select("hub", "node", "label", (F.col("label") != F.col("of_hub")).alias("outside")), "spokes")
    groups = named.groupBy("hub").agg(F.count("*").alias("n"), F.count_if("outside").alias("n_outside")).filter("n > 1 AND n_outside > 0")
    opened = C.written(named.join(groups.select("hub"), "hub"), "open")
    diffs = differences(opened.select(F.col("hub").alias("a"), F.col("node").alias("b")), texts, shingle)
    sets = opened.join(diffs.select(F.col("a").alias("hub"), F.col("b").alias("node"), "n", "diff"), ["hub", "node"])
    # two sets are linked if they share at least half the sum of their excesses
    excess = F.size("diff") - F.col("n") * (100 - percent) / (100 + percent)
    sets = C.written(sets.withColumn("excess", excess), "differences")
    least = sets.filter("outside").groupBy("hub").agg(F.min("excess").alias("least"))
    each = sets.select("hub", "node", "label", "outside", "excess", F.size("diff").alias("size"), F.explode("diff").alias("shingle"))
    # rarest first: what sets a hub itself apart from its group is in every difference, and comes last
    counts = each.groupBy("hub", "shingle").agg(F.count("*").alias("n"))
    rarity = Window.partitionBy("hub", "node").orderBy("n", "shingle")
    each = C.written(each.join(counts, ["hub", "shingle"]).withColumn("place", F.row_number().over(rarity) - 1).drop("n"), "ordered")
    rest = "CAST(size - place AS DOUBLE) + 1e-6"
    x = each.filter("outside").select("hub", "shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "excess")], F.expr(rest).alias("x_rest"))
    y = each.withColumn("rest", F.expr(rest)).join(least, "hub").filter("rest >= (excess + least) / 2")
    y = y.select("hub", "shingle", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "excess", "outside", "rest")])
    need = (F.col("x_excess") + F.col("y_excess")) / 2
    met = x.join(y, ["hub", "shingle"]).filter(
        (F.col("x_label") != F.col("y_label")) & (~F.col("y_outside") | (F.col("x_node") < F.col("y_node"))) & (F.col("x_rest") >= need) & (F.col("y_rest") >= need)
    )
    pairs = met.select("hub", "x_node", "y_node").distinct()
    full = lambda to: sets.select("hub", F.col("node").alias(f"{to}_node"), F.col("n").alias(f"{to}_n"), F.col("diff").alias(f"{to}_diff"))
    both = pairs.join(full("x"), ["hub", "x_node"]).join(full("y"), ["hub", "y_node"])
    apart = F.size("x_diff") + F.size("y_diff") - 2 * F.size(F.array_intersect("x_diff", "y_diff"))
    total = F.col("x_n") + F.col("y_n")
    linked = both.filter(100 * (total - apart) >= percent * (total + apart))
    return linked.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of the edges (a, b)."""
    both = C.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = C.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        after = C.written(lower.join(jump, "via").select("node", "old", F.least("via", "next").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.filter("old != label").isEmpty():
            return labels


def grouped(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: id, rk (hash of id and text), node, n_shingles, component_id, kept."""
    begun = C.mark()
    rows = C.written(sketched(docs, id_column, text, shingle), "sketches")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("least_id"), F.min(F.struct("id", "rk"))["rk"].alias("rk"), F.first("sig").alias("sig")
    )
    keys = [F.xxhash64(F.substring("sig", 4 * i + 1, 4 * BAND_ROWS), F.lit(i)) for i in range(0, _VALUES, BAND_ROWS)]
    banded = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    buckets = C.written(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = C.written(banded.join(buckets, "key"), "members")
    met = C.written(members.groupBy("node").agg(F.sum("n").alias("met")), "met")
    hubs = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("hub"))
    spokes = C.written(members.join(C.written(hubs, "hubs"), "key").filter("node != hub").select("hub", "node").distinct(), "spokes")
    likely = members.select("node").distinct()
    shared = C.written(nodes.select("node", "rk", "sig").join(likely, "node"), "nodes")
    ids, texts = F.col(f"`{id_column}`").cast("bigint"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    fetched = docs.select(F.xxhash64(ids, texts).alias("rk"), texts.alias("text")).join(shared.select("rk", "node"), "rk")
    fetched = C.written(fetched.select("node", "text"), "texts")
    C.settled(docs.sparkSession)

    links = C.written(confirmed(spokes.select(F.col("hub").alias("a"), F.col("node").alias("b")), shared, fetched, shingle, percent), "links")
    labels = components(links)
    more = C.written(links_beside_hubs(under_roots(spokes, met), labels, fetched, shingle, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = nodes.select("node", "least_id").join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    named = C.written(named, "named")
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_node = C.written(named.join(least, "label").select("node", "label", "component_id"), "components")
    C.dropped(docs.sparkSession, begun, keep=(rows, of_node))
    # rows without words have no node: joined, they would all meet in one task
    alone = rows.filter("node IS NULL").select("*", F.lit(None).cast("binary").alias("label"), F.col("id").alias("component_id"))
    joined = rows.filter("node IS NOT NULL").join(of_node, "node").unionByName(alone)
    return joined.select(
        F.col("id").alias(id_column), "rk", "node", "label", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of smallest id (one, if rows repeat)."""
    found = grouped(docs, id_column, text, shingle, percent).filter("kept")
    first = found.select("rk", "label", F.col(id_column).alias("id")).distinct()
    first = first.withColumn("n", F.row_number().over(Window.partitionBy(F.coalesce("label", F.concat_ws(" ", "rk", "id").cast("binary"))).orderBy("rk")))
    keep = first.filter("n = 1").select(F.struct("rk", "id").alias("of"))
    ids, texts = F.col(f"row.`{id_column}`").cast("bigint"), F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns({"rk": F.xxhash64(ids, texts), "id": ids})
    joined = source.join(keep, (F.col("rk") == F.col("of.rk")) & F.col("id").eqNullSafe(F.col("of.id")))
    # identical rows share rk and id: one stays
    numbered = joined.withColumn("n", F.row_number().over(Window.partitionBy("rk", "id").orderBy(F.xxhash64("row"))))
    return numbered.filter("n = 1").select("row.*")
