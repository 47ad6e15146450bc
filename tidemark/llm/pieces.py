"""SentencePiece BPE encoding by a prefix table, and decoding.

Every prefix of a word has one last token. The table of last tokens is filled from left to right: an automaton gives the
pieces that end at a place, and a piece is the last token there if it can stand after the last token of the prefix that
it leaves. Two tokens can stand side by side if, replaying the merges that made them, no merge across their border would
have come first. Reading the table backwards gives the ids. Tokens are read from a model file; nothing is trained.

Words repeat, so each task keeps the ids of the words it met, and which tokens can stand side by side, in tables of
bounded size. Characters without a piece become byte pieces. Runs of spaces merge last and from the left, up to the
longest run that has a piece.

Defined cases: a null or empty text has no ids and decodes to the empty text; ids, other columns and repeated rows pass
through as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

SPACE = "▁"
#: Words, their characters, and pairs of tokens, that a task remembers.
WORDS_KEPT = 400_000
CHARACTERS_KEPT = 1 << 23
PAIRS_KEPT = 500_000


#: A space after a space.
_FURTHER = re.compile("(?<= ) ")


class Words(dict):
    """The ids (as int32) of the words met so far, by what stands between two spaces.

    The space in front belongs to the word, any further ones are written as SPACE; a line feed in front stands for itself
    if it ends words."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.kept = 0

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT or self.kept >= CHARACTERS_KEPT:
            self.forget()
        self.kept += len(word) + 1
        model = self.model
        ids = array("i", model.word_ids(word if model.lines and word[:1] == "\n" else SPACE + word)).tobytes()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.kept = 0


class PieceModel:
    """The pieces of a model with their merges. Models that this method does not fit are refused."""

    def __init__(self, path: str) -> None:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        special = [library.is_control(i) or library.is_unknown(i) or library.is_unused(i) for i in range(size)]
        self.byte = {int(library.id_to_piece(i)[3:5], 16): i for i in range(size) if library.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        normal = {library.id_to_piece(i): i for i in range(size) if not special[i] and not library.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a space inside")
        self.id = {p: i for p, i in normal.items() if len(p) == 1 or p[1] != SPACE}
        self.runs = {p: i for p, i in normal.items() if len(p) > 1 and p[1] == SPACE}
        if any(p.strip(SPACE) for p in self.runs):
            raise ValueError("a piece has several spaces before a letter")
        self.text = {i: p for p, i in self.id.items()}
        self.rank = {i: -1 if len(p) == 1 else -library.get_score(i) for p, i in self.id.items()}
        ranks = [r for r in self.rank.values() if r >= 0]
        if len(set(ranks)) < len(ranks):
            raise ValueError("two pieces have one score")
        if any(-library.get_score(i) <= max(ranks) for i in self.runs.values()) or len({library.get_score(i) for i in self.runs.values()}) > 1:
            raise ValueError("spaces don't merge last, from the left")
        self.raw = [b"" if special[i] else library.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self._merges()
        #: Whether a line feed ends a word: if it has no piece, none goes across it.
        self.lines = "\n" not in self.id
        self.words = Words(self)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging of known characters, best pair first, the left one of equals: what is left, and the last pair."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        waiting: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(part):
                token = part[i] + part[after[i]]
                if token in self.id:
                    heapq.heappush(waiting, (self.rank[self.id[token]], i, token))
                elif token in self.runs:
                    heapq.heappush(waiting, (float("inf"), i, token))

        for i in range(len(part)):
            offer(i)
        last = None
        while waiting:
            _, i, token = heapq.heappop(waiting)
            if part[i] is None or after[i] >= len(part) or part[i] + part[after[i]] != token:
                continue
            j = after[i]
            last = (part[i], part[j])
            part[i], part[j], after[i] = token, None, after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in part if p is not None], last

    def _merges(self) -> None:
        """halves: the last merge of each piece. Pieces that merging never makes are left out of the automaton.

        after: by token, whether another can follow, as far as asked; the automaton gives it along with the token."""
        self.halves: dict[int, tuple[int, int]] = {}
        self.after: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.letters = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            left, last = self.merged(piece) if all(c in self.id for c in piece) else ([], None)
            if left == [piece]:
                if last:
                    self.halves[i] = (self.id[last[0]], self.id[last[1]])
                self.after[i] = {}
                self.automaton.add_word(piece, (i, len(piece), self.after[i]))
        self.automaton.make_automaton()

    def stands(self, a: int, b: int) -> bool:
        """Whether token b can follow token a; the answer is kept."""
        if self.pairs >= PAIRS_KEPT:
            self.forget_pairs()
        key = (a, b)
        rank, text = self.rank, self.text
        right, end = [], float("inf")  # pieces at the right edge of a, and when each is merged away
        while True:
            right.append((a, end))
            if a not in self.halves:
                break
            end, a = rank[a], self.halves[a][1]
        answer, end = True, float("inf")
        while answer:
            for x, gone in right:
                t = self.id.get(text[x] + text[b])
                if t is not None and rank[x] < rank[t] < gone and rank[b] < rank[t] <= end:
                    answer = False
                    break
            if b not in self.halves:
                break
            end, b = rank[b], self.halves[b][0]
        self.after[key[0]][key[1]] = answer
        self.pairs += 1
        return answer

    def forget_pairs(self) -> None:
        for known in self.after.values():
            known.clear()
        self.pairs = 0

    def _known(self, part: str) -> list[int]:
        """Ids of a run of characters that all have pieces, with one space at most, in front."""
        last: list = [None] * len(part)  # the last token of what ends at a place
        filled = -1
        for end, entry in self.automaton.iter(part):
            if end == filled:
                continue
            token, size, _ = entry
            before = end - size
            if before >= 0:
                left, _, after = last[before]
                stands = after.get(token)
                if stands is None:
                    stands = self.stands(left, token)
                if not stands:
                    continue
            last[end] = entry
            filled = end
        out, at = [], len(part) - 1
        while at >= 0:
            token, size, _ = last[at]
            out.append(token)
            at -= size
        out.reverse()
        return out

    def word_ids(self, word: str) -> list[int]:
        body = word.lstrip(SPACE)
        spaces = len(word) - len(body)
        if spaces < 2 and self.letters.issuperset(body):
            return self._known(word)
        out: list[int] = []
        part = SPACE if spaces else ""
        for c in body:
            if c in self.id:
                part += c
                continue
            if part:
                out += self._known(part)
            out += [self.byte[x] for x in c.encode()]
            part = ""
        if part:
            out += self._known(part)
        if spaces:
            if out[0] == self.id[SPACE]:
                out = out[1:]
            else:
                spaces -= 1
            out = [self.runs.get(p) or self.id[p] for p in self.merged(SPACE * spaces)[0]] + out
        return out

    def encode(self, text: str) -> bytes:
        """The ids, as int32."""
        if not text:
            return b""
        text = " " + text
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text:
            text = _FURTHER.sub(SPACE, text)
        if self.lines:
            text = text.replace("\n", " \n")
        found = text.split(" ")
        del found[0]
        return b"".join(map(self.words.__getitem__, found))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for all tasks of a Python worker."""
    return PieceModel(path)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Per row of docs: row (its columns), ids array<int>, decoded string."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    C.small_batches(docs.sparkSession)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in C.steps(batches, "text"):
            made = [pieces.encode(t) for t in batch.column("text").to_pylist()]
            back = [pieces.decode(np.frombuffer(m, np.int32).tolist()) for m in made]
            at = np.append(0, np.cumsum([len(m) // 4 for m in made])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(made), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids, pa.array(back, pa.string())], names=["row", "ids", "decoded"])
        pieces.words.forget()  # an idle worker keeps no words of a task that is over
        pieces.forget_pairs()

    schema = T.StructType([source.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return source.mapInArrow(mapper, schema)


def digests(encoded_docs: DataFrame) -> DataFrame:
    """row, n_tokens, ids_sha256 (of the ids joined by commas), decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded_docs.select(
        "row",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
