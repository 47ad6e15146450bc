"""Secrets in texts, also under layers of URL escapes, Unicode escapes, base64 and compression.

Each text is the first layer of a worklist. A layer is scanned for the base patterns, then unwrapped: all its escapes at once
(URL, Unicode, character references, full-width forms) make one new layer, each run of base64 letters makes one (read from
each of its first four letters, as letters of its surroundings may stand before it), and each compressed stream in it
makes one. New layers are worked off one at a time, until none is left. A layer that was met before at the same place of the text is
not taken up again, so data that unpack to themselves end. A layer keeps how its bytes map to those it came from; a match is
mapped back step by step to the part of the text that holds it, of a compressed stream to the whole stream.

Escapes are undone pass by pass, so texts that nest them take time in proportion to their depth; base64 shrinks by a
quarter each time, so its depth is a logarithm. A chain of escaped escape signs (%2525...) is undone in one pass.

Defined cases: a null text is an empty one and has no spans; null ids and repeated rows are rows of their own; other
columns pass through in `row`; an empty table gives an empty result. Whole texts are scanned, in the memory of one task.
Streams are unpacked in pieces of PIECE bytes that overlap by OVERLAP, so a large one takes no more memory; after
MOST_UNPACKED bytes of one text the rest stays packed, and `unopened` is true for that row.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}
PIECE, OVERLAP, MOST_UNPACKED = 8 << 20, 1 << 20, 1 << 30

#: Read on bytes with A-Z lower-cased, so that letters match in either case and no others do.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{16,}")
#: The shortest base64 text of sixteen bytes has 22 letters; lines may be wrapped.
_BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}(?:\r?\n[A-Za-z0-9+/_-]+)*")
_ESCAPE = re.compile(
    rb"%(?:25)*(?P<url>[0-9A-Fa-f]{2})"
    rb"|\\(?:u005[cC])*(?:u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|u(?P<four>[0-9A-Fa-f]{4})|U(?P<eight>[0-9A-Fa-f]{8})|x(?P<byte>[0-9A-Fa-f]{2}))"
    rb"|&(?:amp;)*(?:\#[xX](?P<refhex>[0-9A-Fa-f]{1,6})|\#(?P<ref>[0-9]{1,7})|(?P<name>amp|quot|apos|lt|gt));"
    rb"|(?P<wide>\xef\xbc[\x81-\xbf]|\xef\xbd[\x80-\x9e])"
)
_NAMED = {b"amp": b"&", b"quot": b'"', b"apos": b"'", b"lt": b"<", b"gt": b">"}
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")

Span = tuple[int, int]
Back = Callable[[int, int], Span]


def scanned(data: bytes) -> Iterator[tuple[str, int, int]]:
    """kind, start, end of the base patterns, in bytes."""
    for m in _ASSIGN.finditer(data.lower()):
        if m.end(1) - m.start(1) >= LEAST["assign"]:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(data):
        if m.end() - m.start() >= LEAST["access"]:
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(data):
        yield "hex", m.start(), m.end()


def _meant(m: re.Match) -> bytes | None:
    """What an escape stands for; None if for nothing."""
    kind, said = m.lastgroup, m[m.lastgroup]
    if kind in ("url", "byte"):
        return bytes([int(said, 16)])
    if kind == "name":
        return _NAMED[said]
    code = ord(said.decode()) - 0xFEE0 if kind == "wide" else int(said, 10 if kind == "ref" else 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code).encode()


def unescaped(data: bytes) -> tuple[bytes, Back] | None:
    """The layer without its escapes, and the way back; None if there are none."""
    out, old, new, end_old, end_new, size, last = [], [], [], [], [], 0, 0
    for m in _ESCAPE.finditer(data):
        to = _meant(m)
        if to is not None:
            out += [data[last : m.start()], to]
            size += m.start() - last
            old.append(m.start()), new.append(size)
            size, last = size + len(to), m.end()
            end_old.append(last), end_new.append(size)
    if not old:
        return None

    def back(start: int, end: int) -> Span:
        i, j = bisect_right(new, start) - 1, bisect_right(new, end - 1) - 1
        first = start if i < 0 else old[i] if start < end_new[i] else end_old[i] + start - end_new[i]
        return first, end if j < 0 else end_old[j] if end <= end_new[j] else end_old[j] + end - end_new[j]

    return b"".join([*out, data[last:]]), back


def unbased(data: bytes) -> Iterator[tuple[bytes, Back]]:
    """Each run of base64 letters as bytes, read from each of its first four letters."""
    for m in _BASE64.finditer(data):
        place = np.frombuffer(m[0], np.uint8)
        at = np.flatnonzero((place != 10) & (place != 13)) + m.start() if b"\n" in m[0] else range(m.start(), m.end())
        letters = m[0].replace(b"\r", b"").replace(b"\n", b"").translate(bytes.maketrans(b"-_", b"+/"))
        for skip in range(4):
            whole = letters[skip:]
            whole = whole[: len(whole) - (len(whole) % 4 == 1)]

            def back(start: int, end: int, skip: int = skip, at=at) -> Span:
                return int(at[skip + start * 4 // 3]), int(at[skip + (end - 1) * 4 // 3 + 1]) + 1

            yield base64.b64decode(whole + b"=" * (-len(whole) % 4)), back


def _stream(data: bytes) -> Iterator[bytes]:
    """The content of a compressed stream, in pieces; it ends where the stream breaks off."""
    rest = data
    try:
        if data.startswith(b"\x28\xb5\x2f\xfd"):
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as reader:
                while piece := reader.read(PIECE):
                    yield piece
            return
        if data.startswith(b"BZh"):
            made = bz2.BZ2Decompressor()
        elif data.startswith(b"\xfd7zXZ"):
            made = lzma.LZMADecompressor(memlimit=1 << 27)
        else:
            made = zlib.decompressobj(31 if data.startswith(b"\x1f\x8b") else 15)
        while not made.eof:
            piece = made.decompress(rest, PIECE)
            rest = getattr(made, "unconsumed_tail", b"")
            if not piece:
                return
            yield piece
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
        return


def unpacked(data: bytes) -> Iterator[tuple[Iterator[bytes], Back]]:
    """The compressed streams of a layer."""
    at = [m.start() for m in _PACKED.finditer(data)]
    if len(data) > 2 and data[0] & 15 == 8 and data[0] < 0x80 and (data[0] << 8 | data[1]) % 31 == 0:
        at.append(0)
    for first in at:
        yield _stream(data[first:]), lambda start, end, first=first: (first, len(data))


def findings(text: bytes, most_unpacked: int = MOST_UNPACKED) -> tuple[dict[tuple[str, int, int], str], bool]:
    """(kind, start, end) in bytes, each with the layers it lies under (empty for the text itself); whether something stayed packed."""
    found: dict[tuple[str, int, int], str] = {}
    seen: set[tuple[bytes, int, int]] = set()
    left, unopened = most_unpacked, False

    def below(data: bytes) -> Iterator[tuple[bytes, Back, str]]:
        nonlocal left, unopened
        if (made := unescaped(data)) is not None:
            yield *made, "escapes"
        for layer, back in unbased(data):
            yield layer, back, "base64"
        for pieces, back in unpacked(data):
            tail = b""
            for piece in pieces:  # each stands for the whole stream, so all are mapped alike
                left -= len(piece)
                if left < 0:
                    unopened = True
                    break
                yield tail + piece, back, "packed"
                tail = piece[-OVERLAP:]

    # the worklist: layers that are still to come, under the layers that they come from
    work: list[tuple[Iterator[tuple[bytes, Back, str]], tuple[Back, ...], str]] = [(iter([(text, lambda start, end: (start, end), "")]), (), "")]
    while work:
        layers, backs, above = work[-1]
        taken = next(layers, None)
        if taken is None:
            work.pop()
            continue
        data, back, how = taken
        if not data:
            continue
        name, chain = f"{above}>{how}" if above else how, (*backs, back)

        def mapped(start: int, end: int, chain: tuple[Back, ...] = chain) -> Span:
            for step in reversed(chain):
                start, end = step(start, end)
            return start, end

        key = (hashlib.blake2b(data, digest_size=16).digest(), *mapped(0, len(data)))
        if key in seen:
            continue
        seen.add(key)
        for kind, start, end in scanned(data):
            found.setdefault((kind, *mapped(start, end)), name)
        work.append((below(data), chain, name))
    return found, unopened


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("layers", T.StringType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]))


def _characters(text: bytes, spans: list[tuple[str, int, int, str]]) -> list[dict]:
    """The spans in code points, by start, kind (in order of KINDS) and end."""
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    made = sorted((int(starts[s]), KINDS.index(kind), int(starts[e]), layers) for kind, s, e, layers in spans)
    return [{"kind": KINDS[kind], "start": s, "end": e, "layers": layers} for s, kind, e, layers in made]


def with_secrets(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """row (the given columns, or all), spans (kind, start, end in code points, layers) and unopened, a row of docs each."""
    C.small_batches(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    rows = docs.select(kept.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.steps(batches, "text"):
            spans, unopened = [], []
            for said in batch.column("text").cast(pa.large_binary()).to_pylist():
                found, rest = findings(said or b"")
                spans.append(_characters(said, [(*at, layers) for at, layers in found.items()]) if found else [])
                unopened.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, _ARROW_SPANS), pa.array(unopened, pa.bool_())], ["row", "spans", "unopened"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("spans", _SPANS), T.StructField("unopened", T.BooleanType())])
    return rows.mapInArrow(scan, schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
