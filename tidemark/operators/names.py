"""Names in texts: masked, and told from the words that open sentences; edits judged by what they add.

A capitalised word inside a sentence is a name; one that opens a sentence is a name only if the text has it inside a
sentence too. Texts are cut into words and what stands between them, so all is done on arrays of these pieces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.text_rules import masked
from tidemark.plans.registry import query
from tidemark.sources.tables import read_table

#: Capitalised words that are no names, words that promise, and the marks of masks.
COMMON = "I I'm I've I'll I'd Day Days Mr Mrs Ms Dr AM PM OK TV".split()
PROMISES = ("always", "never", "guarantee", "guaranteed", "best", "free")
MASKS = ("N", "PRICE", "TIME", "URL", "EMAIL", "NAME")

_PIECES = rf"\[(?:{'|'.join(MASKS)})\]|[A-Za-z][\p{{L}}\p{{N}}_'’-]*|[^A-Za-z\[]+|\["
#: What stands before a word that opens a sentence.
_OPENS = r"(?s)(?:[.!?:;]\s+|\n\s*|[\"“(]\s*)$"
_COMMON_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in COMMON)


def _words(text: Column) -> Column:
    """The pieces of a text in order: said, capital (a capitalised word that may be a name), opens (a sentence)."""

    def marked(pieces: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.get(pieces, i - 1)
            return F.struct(p.alias("said"), (p.rlike("^[A-Z]") & ~p.isin(COMMON)).alias("capital"), ((i == 0) | before.rlike(_OPENS)).alias("opens"))

        return F.transform(pieces, one)

    return X.let(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), marked)


def _inside(words: Column) -> Column:
    """The distinct names that stand inside a sentence."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: w["capital"] & ~w["opens"]), lambda w: w["said"]))


def names(text: Column) -> Column:
    """The distinct names of a text, in order."""
    return X.let(_words(text), _inside)


def names_masked(text: Column) -> Column:
    """Every name as [NAME], names side by side (also with of, the or de between) as one."""

    def joined(words: Column) -> Column:
        return X.let(_inside(words), lambda inside: F.array_join(F.transform(words, lambda w: F.when(w["capital"] & (~w["opens"] | F.array_contains(inside, w["said"])), "[NAME]").otherwise(w["said"])), ""))

    return F.regexp_replace(X.let(_words(text), joined), r"\[NAME\](?:[\s-]+(?:(?:of|the|de)\s+)?\[NAME\])+", "[NAME]")


def _duck_pieces(text: str, rows: str) -> str:
    pieces = _PIECES.replace("'", "''")
    opens = _OPENS.replace("'", "''")
    return f"""(SELECT *, list_transform(p, lambda x, i: struct_pack(said := x, capital := regexp_matches(x, '^[A-Z]') AND x NOT IN ({_COMMON_SQL}), opens := i = 1 OR regexp_matches(p[i - 1], '{opens}'))) AS w
        FROM (SELECT *, regexp_extract_all({text}, '{pieces}') AS p FROM {rows}))"""


def _duck_mask(text: str) -> str:
    """The oracle's text without URLs, times, prices and numbers, by the rules' own patterns."""
    from tidemark.operators.text_rules import _MASKS

    for pattern, to in _MASKS:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


_DUCK_INSIDE = "list_distinct(list_transform(list_filter(w, lambda x: x.capital AND NOT x.opens), lambda x: x.said))"


@query(
    "txt_mask_entities",
    rf"""SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(w, lambda x: CASE WHEN x.capital AND (NOT x.opens OR list_contains(n, x.said)) THEN '[NAME]' ELSE x.said END), ''), '\[NAME\]([\s-]+((of|the|de)\s+)?\[NAME\])+', '[NAME]', 'g')) AS masked
    FROM (SELECT doc_id, w, {_DUCK_INSIDE} AS n FROM {_duck_pieces("t", f"(SELECT doc_id, {_duck_mask('text')} AS t FROM documents)")})""",
)
def txt_mask_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(names_masked(masked(F.col("text")))).alias("masked"))


def edit_status(before: Column, after: Column, source: Column, figures: Column, known_figures: Column) -> Column:
    """What an edit adds that neither the text before nor the source has: `fail` for figures and promises, `grey` for names,
    else `pass`; an edit that leaves nothing passes."""
    known = F.concat_ws("\n", before, source)
    says = lambda text, word: F.coalesce(text, F.lit("")).rlike(rf"(?i)(?<![a-z]){re.escape(word)}(?![a-z])")
    promise = F.lit(False)
    for word in PROMISES:
        promise = promise | (says(after, word) & ~says(known, word))
    new = F.size(F.array_except(figures, known_figures)) > 0
    named = F.size(F.array_except(names(after), F.split(known, r"[^\p{L}\p{N}_'’-]+"))) > 0
    return F.when(F.trim(F.coalesce(after, F.lit(""))) == "", "pass").when(new | promise, "fail").when(named, "grey").otherwise("pass")


_FIGURE = "[0-9]+(?:[.,][0-9]+)*"
_DUCK_PROMISE = " OR ".join(f"(regexp_matches(text, '(?i)(^|[^a-z]){w}($|[^a-z])') AND NOT regexp_matches(known, '(?i)(^|[^a-z]){w}($|[^a-z])'))" for w in PROMISES)


@query(
    "txt_fact_filter",
    rf"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER o AS before, first_value(text) OVER o AS source FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT *, concat_ws(chr(10), before, source) AS known FROM t WHERE before IS NOT NULL)
    SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'pass'
        WHEN len(list_filter(regexp_extract_all(text, '{_FIGURE}'), lambda x: NOT list_contains(regexp_extract_all(known, '{_FIGURE}'), x))) > 0 OR {_DUCK_PROMISE} THEN 'fail'
        WHEN len(list_filter({_DUCK_INSIDE}, lambda x: NOT list_contains(string_split_regex(known, '[^\p{{L}}\p{{N}}_''’-]+'), x))) > 0 THEN 'grey' ELSE 'pass' END AS verdict
    FROM {_duck_pieces("text", "k")}""",
)
def txt_fact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an edit of the one before, with the conversation's first turn as source."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = read_table(spark, sf_dir, "conversations").withColumns({"before": F.lag("text").over(order), "source": F.first("text").over(order)}).filter("before IS NOT NULL")
    figures = lambda *texts: F.regexp_extract_all(F.concat_ws("\n", *texts), F.lit(_FIGURE), F.lit(0))
    return turns.select("conv_id", "turn", edit_status(F.col("before"), F.col("text"), F.col("source"), figures("text"), figures("before", "source")).alias("verdict"))
