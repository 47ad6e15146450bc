"""Text expressions shared by the document operators."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: Column, pattern: str = "[a-z0-9']+") -> Column:
    """The words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often, or in what lambda, it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashed(tokens: Column) -> Column:
    """64-bit hashes in place of the tokens: smaller to sort, shuffle and compare."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def shingles(tokens: Column, n: int, joined: Callable[..., Column] | None = None) -> Column:
    """The distinct runs of n tokens, joined by spaces or by `joined` (of n columns)."""
    made = joined or (lambda *parts: F.concat_ws(" ", *parts))

    def runs(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: made(*[F.get(t, i + k) for k in range(n)])))

    return let(tokens, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Null if either set is empty."""
    common, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / total)


def _bare(letter: str) -> str:
    """A letter without its marks, and without a stroke where Unicode names one."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
    if plain == letter and " WITH " in (name := unicodedata.name(letter, "")):
        try:
            plain = unicodedata.lookup(name.split(" WITH ")[0])
        except KeyError:
            return letter
    return plain


#: Lower-case Latin letters with marks, and what they fold to; letters that fold to two are replaced apart.
_FOLDED = {c: _bare(c) for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]) if c.islower()}
ACCENTED = "".join(c for c, to in _FOLDED.items() if len(to) == 1 and to.isascii())
PLAIN = "".join(to for to in _FOLDED.values() if len(to) == 1 and to.isascii())
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ij": "ij", "þ": "th", "đ": "d", "ð": "d", "ı": "i"}


def folded(text: Column) -> Column:
    """Lower case without accents, all but letters and digits a single space, without an article in front."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    for letter, to in LIGATURES.items():
        plain = F.replace(plain, F.lit(letter), F.lit(to))
    return F.regexp_replace(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), "^(?:the|a|an) (?=.)", "")


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form; plain ASCII stays in the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(text))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))
