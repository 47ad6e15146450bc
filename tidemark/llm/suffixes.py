"""Removal of repeated byte strings by a distributed, common-prefix-aware merge of sorted suffixes.

Each byte covered by a `length`-byte string that also starts earlier (in a document of smaller id, or in the same
document at an earlier place) is removed. Suffixes are kept only where they can matter:

1. Every window of `length` bytes is owned by its minimiser, the place in it whose KEY-byte prefix hashes lowest. Equal
   windows have equal minimisers, so places are compared by the hashes of their KEY bytes, and places whose KEY bytes
   occur once in the corpus are done with. A task reports a hash once however often it met it, so a passage that a third
   of all documents share makes one row per task.
2. Documents with repeated places are cut into runs. A run drops windows that it holds in an earlier document (their
   answer is known), sorts the remaining suffixes, front-codes them (length of the prefix shared with the suffix before,
   then the rest) and sends them as blocks to the partition of their KEY bytes.
3. A partition merges its runs with a loser tree that compares by known common prefixes and reads bytes only beyond
   them. Two windows with the same distance to their owners are equal when the lengths shared between all neighbours from
   one to the other reach to their ends, and the bytes left of the owners are the same.

Hashes only find candidates; bytes and shared lengths decide. Places are counted by partition first: one with far more
than meant (a KEY that many documents hold with different text around) is dealt out by whole windows instead, so that
only equal ones meet.

Defined cases: a null text is empty; a null id comes after all others; rows of one id do not remove each other's bytes
and identical rows get the same result; texts shorter than `length` keep every byte; a text of any size is read in pieces
of STEP_BYTES that overlap by length - 1; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

LENGTH = 100
KEY = 32
#: Windows and bytes that a run sorts at once, and places that a task compares at once.
RUN_WINDOWS = 300_000
RUN_BYTES = 6 * C.STEP_BYTES
TASK_PLACES = 500_000
#: Candidate places to a merging partition, about; with SPLIT times as many it is dealt out anew.
PLACES_PER_MERGE = 60_000
SPLIT = 4
#: Entries that a merging partition judges at once (a group that shares KEY bytes stays whole), and windows.
MERGE_ENTRIES = 5_000
MERGE_WINDOWS = 300_000

_NO_ID = (1 << 63) - 1


def minimisers(data: np.ndarray, at: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start (of every window), its row, its owner (place of the minimiser), and hash (of KEY bytes at any place)."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = rolling(data, key)
    packed = (hashes & ~np.uint64((1 << 26) - 1)) | np.arange(len(hashes), dtype=np.uint64)  # pieces are far below 2**26 bytes
    width, least, done = length - key + 1, packed, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    before = np.cumsum(np.maximum(size - length + 1, 0)) - np.maximum(size - length + 1, 0)
    start = np.arange(len(row)) - before[row] + at[row]
    return start, row, (least[start] & np.uint64((1 << 26) - 1)).astype(np.int64), hashes


def rolling_at(data: np.ndarray, width: int, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the `width` bytes from each of the ascending starts."""
    values, out, i = C.byte_values(), np.empty(len(start), np.uint64), 0
    while i < len(start):
        lo = int(start[i])
        j = int(np.searchsorted(start, lo + C.STEP_BYTES, side="left"))
        at = start[i:j] - lo
        part = data[lo : int(start[j - 1]) + width]
        with np.errstate(over="ignore"):
            summed = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * C._power("up", len(part))[: len(part)], out=summed[1:])
            out[i:j] = C.mixed((summed[at + width] - summed[at]) * C._power("down", len(part))[at])
        i = j
    return out


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` bytes."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    values, out = C.byte_values(), np.empty(n, np.uint64)
    for lo in range(0, n, C.STEP_BYTES):
        hi = min(n, lo + C.STEP_BYTES)
        part = data[lo : hi + width - 1]
        with np.errstate(over="ignore"):
            summed = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * C._power("up", len(part))[: len(part)], out=summed[1:])
            out[lo:hi] = C.mixed((summed[width:] - summed[:-width]) * C._power("down", hi - lo)[: hi - lo])
    return out


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Rows, their bytes, where each begins, and the offset of the bytes in their document: 0, but for a document longer
    than a step, which comes in pieces. Each window is in one piece."""
    for batch in C.steps(batches, "text"):
        data, at = C.bytes_of(batch.column("text"))
        if len(data) <= C.STEP_BYTES:
            yield batch, data, at, 0
            continue
        for lo in range(0, len(data) - length + 1, C.STEP_BYTES):
            part = data[lo : lo + C.STEP_BYTES + length - 1]
            yield batch, part, np.array([0, len(part)]), lo


def places(docs: DataFrame, length: int, key: int) -> DataFrame:
    """rk, single, known: where the KEY bytes of a minimiser occur elsewhere in the corpus too (docs: rk, text)."""

    def report(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        hashes, own, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        count = np.diff(np.append(first, len(hashes)))
        alone = first[count == 1]
        yield _rows(hashes[alone].view(np.int64), own[order[alone]], place[order[alone]])
        shared = first[count > 1]
        if len(shared):
            yield _rows(hashes[shared].view(np.int64), None, None)  # other tasks learn that it occurs here
            again = order[np.repeat(count > 1, count)]
            own, where = own[again], place[again]
            order = np.lexsort((where, own))
            own, where = own[order], where[order]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            known = [where[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(own)), strict=True)]
            spread = C.mixed(own[begin].view(np.uint64)).view(np.int64)
            for i in range(0, len(begin), 5000):
                yield _rows(spread[i : i + 5000], own[begin[i : i + 5000]], None, known[i : i + 5000])

    def _rows(hashes: np.ndarray, rk: np.ndarray | None, place: np.ndarray | None, known: list[bytes] | None = None) -> pa.RecordBatch:
        n = len(hashes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hashes),
                pa.nulls(n, pa.int64()) if rk is None else pa.array(rk),
                pa.nulls(n, pa.int32()) if place is None else pa.array(place),
                pa.nulls(n, pa.binary()) if known is None else pa.array(known, pa.binary()),
            ],
            names=["hash", "rk", "place", "known"],
        )

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch, data, at, offset in _pieces(batches, length):
            _, row, owner, hashes = minimisers(data, at, length, key)
            if not len(owner):
                continue
            new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            owner, row = owner[new], row[new]
            rk = batch.column("rk").to_numpy(zero_copy_only=False)
            held.append((hashes[owner], rk[row], (owner - at[row] + offset).astype(np.int32)))
            n += len(owner)
            if n >= TASK_PLACES:
                yield from report(held)
                held, n = [], 0
        if held:
            yield from report(held)
        held = []
        C.released()

    found = docs.mapInArrow(mapper, "hash bigint, rk bigint, place int, known binary")
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("hash")))
    repeated_places = counted.filter("rk IS NOT NULL AND (n > 1 OR known IS NOT NULL)")
    return repeated_places.groupBy("rk").agg(F.collect_list("place").alias("single"), F.collect_list("known").alias("known"))


def same_windows(data: np.ndarray, length: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the `length` bytes from each a and from each b are the same."""
    windows, out = np.lib.stride_tricks.sliding_window_view(data, length), np.empty(len(a), bool)
    for lo in range(0, len(a), 20_000):
        out[lo : lo + 20_000] = (windows[a[lo : lo + 20_000]] == windows[b[lo : lo + 20_000]]).all(1)
    return out


def repeated(value: np.ndarray, ids: np.ndarray, rank: np.ndarray, place: np.ndarray, same: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an equal one in a document of smaller id or earlier in their own, and the indices of those in
    doubt, whose hash `value` an unequal window shares. `same` tells it for two arrays of indices; rank: of (id, rk)."""
    gone, order = np.zeros(len(value), bool), np.argsort(value)
    v = value[order]
    again = np.append(False, v[1:] == v[:-1])
    several = order[again | np.append(again[1:], False)]  # only these need the order of documents and places
    if not len(several):
        return gone, several
    order = several[np.lexsort((place[several], rank[several], value[several]))]
    v, r, i, p = value[order], rank[order], ids[order], place[order]
    new = np.append(True, v[1:] != v[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    new |= np.append(True, r[1:] != r[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    of_smaller = i > i[first]
    at = np.flatnonzero(of_smaller | (p > p[head]))
    ok = same(order[at], order[np.where(of_smaller, first, head)[at]])
    gone[order[at[ok]]] = True
    return gone, order[at[~ok]]


def ranks(ids: np.ndarray, rk: np.ndarray) -> np.ndarray:
    """The rank of each (id, rk); equal ones share one."""
    order = np.lexsort((rk, ids))
    i, r = ids[order], rk[order]
    out = np.empty(len(ids), np.int32)
    out[order] = np.cumsum(np.append(False, (i[1:] != i[:-1]) | (r[1:] != r[:-1])))[: len(ids)]
    return out


class Run:
    """Windows of several steps of text, to be thinned, sorted and front-coded; columns as narrow as a run allows."""

    def __init__(self, length: int, key: int) -> None:
        self.length, self.key = length, key
        self.text: list[np.ndarray] = []
        self.columns: dict[str, list[np.ndarray]] = defaultdict(list)
        self.bytes = self.windows = self.rows = 0

    def add(self, data: np.ndarray, ids: np.ndarray, rk: np.ndarray, row: np.ndarray, start: np.ndarray, owner: np.ndarray, place: np.ndarray, value: np.ndarray, part: np.ndarray) -> None:
        """ids, rk: of each row; row, start and owner (both in data), place (of the start in its document), hash and
        partition: of each window."""
        narrow = {"row": row + self.rows, "start": start + self.bytes, "owner": owner + self.bytes, "place": place, "part": part}
        for name, x in narrow.items():
            self.columns[name].append(x.astype(np.int32))
        for name, x in {"value": value, "ids": ids, "rk": rk}.items():
            self.columns[name].append(x)
        self.text.append(data)
        self.bytes += len(data)
        self.rows += len(ids)
        self.windows += len(start)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """partition, block; empties the run."""
        data, self.text = np.concatenate(self.text), []
        w = {k: np.concatenate(self.columns.pop(k)) for k in list(self.columns)}
        ids, rk, value, row = w.pop("ids"), w.pop("rk"), w.pop("value"), w["row"]
        start = w["start"]
        gone, _ = repeated(value, ids[row], ranks(ids, rk)[row], w["place"], lambda a, b: same_windows(data, self.length, start[a], start[b]))
        del value
        if gone.any():
            yield int(w["part"][0]), b"A" + ranges(rk[row[gone]], w["place"][gone])
        w = {k: v[~gone] for k, v in w.items()}
        if not len(w["start"]):
            return
        # an entry: the windows of one owner, from the first to the last that is left
        new = np.flatnonzero(np.append(True, (w["owner"][1:] != w["owner"][:-1]) | (w["start"][1:] != w["start"][:-1] + 1)))
        hi = w["start"][np.append(new[1:], len(w["owner"])) - 1] + self.length
        w = {k: v[new] for k, v in w.items()}
        yield from front_coded(data, w["owner"], w["start"], hi, w["place"], ids[w["row"]], rk[w["row"]], w["part"], self.length)


def front_coded(data: np.ndarray, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, ids: np.ndarray, rk: np.ndarray, part: np.ndarray, length: int) -> Iterator[tuple[int, bytes]]:
    """partition, block, of entries with bytes lo to owner before their suffix, owner to hi; place: of lo."""
    span, wide = hi - owner, np.arange(length)
    suffix = np.empty((len(owner), length), np.uint8)
    for a in range(0, len(owner), 10_000):
        cells = data[np.minimum(owner[a : a + 10_000, None] + wide, len(data) - 1)]
        suffix[a : a + 10_000] = np.where(wide < span[a : a + 10_000, None], cells, 0)
    order = np.argsort(suffix.view(f"S{length}").ravel(), kind="stable")
    order = order[np.argsort(part[order], kind="stable")]
    part = part[order]
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True):
        own = order[a:b]
        shared = np.zeros(len(own), np.int64)
        for x in range(1, len(own), 10_000):
            this, last = own[x : x + 10_000], own[x - 1 : x + 9_999][: len(own) - x]
            same = suffix[this] == suffix[last]
            shared[x : x + 10_000] = np.minimum(np.where(same.all(1), length, same.argmin(1)), np.minimum(span[this], span[last]))
        tail = [data[o + s : h].tobytes() for o, s, h in zip(owner[own].tolist(), shared.tolist(), hi[own].tolist(), strict=True)]
        left = [data[s:o].tobytes() for s, o in zip(lo[own].tolist(), owner[own].tolist(), strict=True)]
        yield int(part[a]), b"B" + packed(
            shared.astype(np.uint8), span[own].astype(np.uint8), (owner - lo)[own].astype(np.uint8),
            place[own].astype(np.int32), ids[own], rk[own],
            np.frombuffer(b"".join(tail), np.uint8), np.frombuffer(b"".join(left), np.uint8),
        )


_TYPES = "u1 u1 u1 i4 i8 i8 u1 u1".split()


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(arrays)}q", *(x.nbytes for x in arrays)) + b"".join(x.tobytes() for x in arrays))


def unpacked(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 8 * len(_TYPES), []
    for kind, n in zip(_TYPES, struct.unpack_from(f"<{len(_TYPES)}q", raw), strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


class Entries:
    """The entries of one block: shared (length of the prefix shared with the suffix before), suffixes, bytes before them,
    and place (of the first of these), ids, rk."""

    def __init__(self, block: bytes) -> None:
        shared, span, left_span, self.place, self.ids, self.rk, tail, left = unpacked(block[1:])
        tails, at, before, self.suffixes = tail.tobytes(), 0, b"", []
        for s, n in zip(shared.tolist(), span.tolist(), strict=True):
            before = before[:s] + tails[at : at + n - s]
            at += n - s
            self.suffixes.append(before)
        cut, lefts = np.append(0, np.cumsum(left_span, dtype=np.int64)).tolist(), left.tobytes()
        self.left = [lefts[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.shared, self.left_span = shared.tolist(), left_span


def dealt_anew(block: bytes, part: int, parts: int, length: int) -> Iterator[tuple[int, bytes]]:
    """A block's windows, each an entry of its own, in the partition of all its bytes: one of `parts` below `part`."""
    if block[:1] == b"A":
        yield part << 24, block
        return
    held = Entries(block)
    left = np.array([len(x) for x in held.left])
    text = [a + b for a, b in zip(held.left, held.suffixes, strict=True)]
    data, size = np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text])
    windows = size - length + 1
    entry = np.repeat(np.arange(len(text)), windows)
    step = np.arange(len(entry)) - (np.cumsum(windows) - windows)[entry]
    start = (np.cumsum(size) - size)[entry] + step
    to = C.mixed(rolling_at(data, length, start)) % np.uint64(parts)
    of = (part << 24) + to.astype(np.int64)
    yield from front_coded(data, start, start, start + length, held.place[entry] + step, held.ids[entry], held.rk[entry], of, length)


def ranges(rk: np.ndarray, place: np.ndarray) -> bytes:
    """Runs of consecutive places per row, packed as (rk, first, end)."""
    order = np.lexsort((place, rk))
    rk, place = rk[order], place[order].astype(np.int64)
    new = np.flatnonzero(np.append(True, (rk[1:] != rk[:-1]) | (place[1:] > place[:-1] + 1)))
    end = place[np.append(new[1:], len(rk)) - 1] + 1
    return zstandard.ZstdCompressor(level=3).compress(np.stack([rk[new], place[new], end], 1).tobytes())


class Merge:
    """A loser tree over sorted runs of (suffix, length shared with the suffix before it in the run).

    Each run in the tree carries the length that its next suffix shares with the last winner. Of two, the one that
    shares more comes first; only when both share the same are bytes read, and only from there on.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.runs = [r for r in runs if r[0]]
        k = len(self.runs)
        self.at, self.shared = [0] * k, [0] * k
        self.size = 1
        while self.size < max(1, k):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1) if k else -1

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first, second = self._play(a, b)
        self.losers[node] = second
        return first

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner, loser; the loser's shared length becomes the one with the winner."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        x, y = self.shared[a], self.shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        s, t = self.runs[a][0][self.at[a]], self.runs[b][0][self.at[b]]
        n = min(len(s), len(t))
        while x + 16 <= n and s[x : x + 16] == t[x : x + 16]:
            x += 16
        while x < n and s[x] == t[x]:
            x += 1
        if x == len(s) or (x < n and s[x] < t[x]):
            self.shared[b] = x
            return a, b
        self.shared[a] = x
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """run, index in the run, length shared with the suffix before."""
        while self.winner >= 0:
            w = self.winner
            yield w, self.at[w], self.shared[w]
            self.at[w] += 1
            node = (w + self.size) // 2
            if self.at[w] < len(self.runs[w][0]):
                self.shared[w] = self.runs[w][1][self.at[w]]
                best = w
            else:
                best = -1
            while node:
                best, self.losers[node] = self._play(best, self.losers[node])
                node //= 2
            self.winner = best


def merged(blocks: list[bytes], length: int, key: int) -> Iterator[bytes]:
    """The removed windows, as packed ranges, of one partition's blocks."""
    runs = []
    for block in blocks:
        if block[:1] == b"A":
            yield block[1:]
        else:
            runs.append(Entries(block))
    if not runs:
        return
    begin = np.cumsum([0, *(len(r.suffixes) for r in runs)]).tolist()
    text = [a + b for r in runs for a, b in zip(r.left, r.suffixes, strict=True)]
    columns = [np.concatenate([getattr(r, name) for r in runs]).astype(np.int64) for name in ("left_span", "ids", "rk", "place")]
    held: list[int] = []  # entries in order
    near: list[int] = []  # length that each shares with the one before
    for run, i, shared in Merge([(r.suffixes, r.shared) for r in runs]):
        if shared < key and len(held) >= MERGE_ENTRIES:
            yield from _removed(np.array(held), np.array(near), text, *columns, length, key)
            held, near = [], []
        held.append(begin[run] + i)
        near.append(shared)
    yield from _removed(np.array(held), np.array(near), text, *columns, length, key)


def _removed(
    held: np.ndarray, shared: np.ndarray, texts: list[bytes], left: np.ndarray, ids: np.ndarray, rk: np.ndarray, place: np.ndarray, length: int, key: int
) -> Iterator[bytes]:
    """Of neighbours in sorted order, the windows that repeat an earlier one."""
    if len(held) < 2:
        return
    shared[0] = 0
    near = shared >= key
    some = near | np.append(near[1:], False)  # those that share KEY bytes with a neighbour
    if not some.any():
        return
    shared, held = shared[some], held[some]
    left, ids, rk, place = left[held], ids[held], rk[held], place[held]
    text = [texts[i] for i in held.tolist()]
    size = np.array([len(t) for t in text])
    data = np.frombuffer(b"".join(text), np.uint8)
    owner = np.cumsum(size) - size + left
    rank = ranks(ids, rk)

    # a window's distance is that from its start to its owner; windows of one distance are judged together
    least, most = length - (size - left), left
    at_distance = np.cumsum(np.bincount(least, minlength=length + 1) - np.bincount(most + 1, minlength=length + 1)[: length + 1])
    batch = np.cumsum(at_distance) // MERGE_WINDOWS
    cut = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])).tolist()
    for d0, d1 in zip(cut, [*cut[1:], int(most.max()) + 1], strict=True):
        lo, hi = np.maximum(least, d0), np.minimum(most, d1 - 1)
        n = np.maximum(hi - lo + 1, 0)
        if not n.sum():
            continue
        entry = np.repeat(np.arange(len(n)), n)
        distance = hi[entry] - (np.arange(len(entry)) - (np.cumsum(n) - n)[entry])
        start = owner[entry] - distance
        # right of the owners: alike as long as no neighbour on the way shares less
        border = np.stack([np.cumsum(shared < length - d) for d in range(d0, d1)]).astype(np.int32)
        right = border[distance - d0, entry]
        value = C.mixed(rolling_at(data, length, start) ^ C.mixed((right.astype(np.uint64) << np.uint64(8)) + distance.astype(np.uint64)))
        where = place[entry] + left[entry] - distance

        def same(a: np.ndarray, b: np.ndarray, right=right, distance=distance, start=start) -> np.ndarray:
            return (right[a] == right[b]) & (distance[a] == distance[b]) & same_windows(data, length, start[a], start[b])

        gone, doubtful = repeated(value, ids[entry], rank[entry], where, same)
        if len(doubtful):  # unequal windows of one hash: told apart by their bytes
            _settle(gone, np.flatnonzero(np.isin(value, value[doubtful])), data, start, length, ids[entry], rank[entry], where)
        if gone.any():
            yield ranges(rk[entry[gone]], where[gone])


def _settle(gone: np.ndarray, among: np.ndarray, data: np.ndarray, start: np.ndarray, length: int, ids: np.ndarray, rank: np.ndarray, place: np.ndarray) -> None:
    groups = defaultdict(list)
    for i in among.tolist():
        groups[data[start[i] : start[i] + length].tobytes()].append(i)
    for group in groups.values():
        least = min(ids[i] for i in group)
        for i in group:
            gone[i] = ids[i] > least or any(rank[j] == rank[i] and place[j] < place[i] for j in group)


def removed_windows(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """rk, text, windows (packed pairs of int32: first and end of runs of removed windows) of rows that lose bytes.

    docs: id, rk, text, where rk is a hash of id and text.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    found = places(docs.select("rk", "text"), length, key)
    held = C.written(docs.join(found, "rk").dropDuplicates(["rk"]), "suffixes")
    del found
    C.settled(spark)
    n = held.select(F.sum(F.size("single") + F.coalesce(F.aggregate("known", F.lit(0.0), lambda s, x: s + F.octet_length(x) / 4), F.lit(0.0)))).first()[0]
    parts = max(1, round((n or 0) / PLACES_PER_MERGE), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def wanted(batch: pa.RecordBatch, at: np.ndarray, offset: int) -> np.ndarray:
        """Where the places of a batch's rows are in its bytes, ascending."""
        out = []
        for r, (single, known) in enumerate(zip(batch.column("single").to_pylist(), batch.column("known").to_pylist(), strict=True)):
            where = np.concatenate([np.array(single or [], np.int64), *(np.frombuffer(k, np.int32) for k in known or [])]).astype(np.int64) - offset
            out.append(at[r] + np.sort(where[(where >= 0) & (where < at[r + 1] - at[r])]))
        return np.concatenate(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch, data, at, offset in _pieces(batches, length):
            place = np.unique(wanted(batch, at, offset))
            hashes = rolling_at(data, key, place[place <= len(data) - key])
            seen = np.bincount((C.mixed(hashes) % np.uint64(parts)).astype(np.int64), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        if some := np.flatnonzero(total).tolist():
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["part", "n"])

    counted = held.select("text", "single", "known").mapInArrow(count, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    heavy = {r["part"]: r["n"] for r in counted.filter(F.col("n") > SPLIT * PLACES_PER_MERGE).collect()}  # a row for SPLIT * PLACES_PER_MERGE places at most
    shared = spark.sparkContext.broadcast(heavy)

    def of_blocks(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks:
            load = shared.value.get(part)
            dealt = [(part << 24, block)] if load is None else dealt_anew(block, part, min(1 << 24, max(2, load * 40 // PLACES_PER_MERGE)), length)
            for to, made in dealt:
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([made], pa.binary())], names=["part", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Run(length, key)
        for batch, data, at, offset in _pieces(batches, length):
            start, row, owner, hashes = minimisers(data, at, length, key)
            if not len(owner):
                continue
            found_there = np.zeros(len(data), bool)
            found_there[wanted(batch, at, offset)] = True
            chosen = np.flatnonzero(found_there[owner])
            if not len(chosen):
                continue
            ids, rk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "rk"))
            s, r, o = start[chosen], row[chosen], owner[chosen]
            part = C.mixed(hashes[o]) % np.uint64(parts)
            run.add(data, ids, rk, r, s, o, s - at[r] + offset, rolling_at(data, length, s), part)
            if run.windows >= RUN_WINDOWS or run.bytes >= RUN_BYTES:
                yield from of_blocks(run.blocks())
                run = Run(length, key)
        if run.windows:
            yield from of_blocks(run.blocks())
        del run
        C.released()

    def merge(blocks: pa.Table) -> pa.Table:
        out = list(merged(blocks.column("block").to_pylist(), length, key))
        flat = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.int64) for b in out)]).reshape(-1, 3)
        flat = flat[np.argsort(flat[:, 0], kind="stable")]
        new = np.flatnonzero(np.append(True, flat[1:, 0] != flat[:-1, 0])) if len(flat) else np.zeros(0, np.int64)
        packs = [flat[a:b, 1:].astype(np.int32).tobytes() for a, b in zip(new, np.append(new[1:], len(flat)), strict=True)] if len(flat) else []
        C.released()
        return pa.table({"rk": pa.array(flat[new, 0] if len(flat) else [], pa.int64()), "windows": pa.array(packs, pa.binary())})

    blocks = held.select("id", "rk", "text", "single", "known").mapInArrow(cut, "part bigint, block binary")
    windows = blocks.groupBy("part").applyInArrow(merge, "rk bigint, windows binary")
    per_row = windows.groupBy("rk").agg(F.collect_list("windows").alias("windows"))
    return held.select("rk", "text").join(per_row, "rk")


def spans_of(windows: list[bytes], length: int) -> np.ndarray:
    """Start and end of the spans that runs of windows cover, apart and ascending."""
    pairs = np.frombuffer(b"".join(windows), np.int32).reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1] - 1 + length)
    new = np.flatnonzero(np.append(True, pairs[1:, 0] > end[:-1]))
    return np.stack([pairs[new, 0], end[np.append(new[1:], len(end)) - 1]], 1)


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    pairs, at, out = spans.tolist(), 0, []
    for a, b in pairs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: np.ndarray) -> str:
    """The text without the spans, which shrink to whole characters."""
    pairs, at, out = spans.tolist(), 0, []
    for a, b in pairs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    ids, texts = F.col(f"`{id_column}`").cast("bigint"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(ids, F.lit(_NO_ID)).alias("id"), F.xxhash64(ids, texts).alias("rk"), texts.alias("text"))


def repeat_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, key: int = KEY) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256."""
    lost = removed_windows(_keyed(docs, id_column, text), length, key)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pairs = batch.column("text").cast(pa.binary()).to_pylist(), [spans_of(w, length) for w in batch.column("windows").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rk"),
                    pa.array([int((p[:, 1] - p[:, 0]).sum()) for p in pairs], pa.int64()),
                    pa.array([len(p) for p in pairs], pa.int64()),
                    pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, pairs, strict=True)], pa.string()),
                ],
                names=["rk", "n_removed", "n_spans", "kept_sha256"],
            )

    found = lost.mapInArrow(digest, "rk bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    ids, texts = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(ids.alias("id"), F.xxhash64(ids.cast("bigint"), texts).alias("rk"), F.octet_length(texts).cast("bigint").alias("n_bytes"), F.sha2(texts.cast("binary"), 256).alias("whole"))
    return base.join(found, "rk", "left").select(
        F.col("id").alias(id_column),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, key: int = KEY) -> DataFrame:
    """All rows and columns of docs; texts lose their repeated bytes, but for parts of characters."""
    lost = removed_windows(_keyed(docs, id_column, text), length, key)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text").cast(pa.binary()).to_pylist(), [spans_of(w, length) for w in batch.column("windows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array([whole_characters(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())], names=["rk", "left"])

    short = lost.mapInArrow(shorten, "rk bigint, left string").select(F.struct("rk", "left").alias("new"))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    old = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    joined = source.join(short, F.xxhash64(F.col(f"row.`{id_column}`").cast("bigint"), old) == F.col("new.rk"), "left")
    return joined.select(*[(F.coalesce("new.left", f"row.`{c}`") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
