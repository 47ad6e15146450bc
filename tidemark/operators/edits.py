"""Edits in short: the words that a change touches, with the words around them, masked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X
from tidemark.operators.names import _DUCK_INSIDE, _duck_pieces, names_masked
from tidemark.operators.repeats import changed_ranges
from tidemark.operators.text_rules import masked
from tidemark.plans.registry import query
from tidemark.sources.tables import read_table

#: Words of context, and characters of a side.
CONTEXT, MOST_CHARACTERS = 8, 400

_RANGES = T.ArrayType(T.ArrayType(T.IntegerType()))


@F.pandas_udf(T.StructType([T.StructField("before", _RANGES), T.StructField("after", _RANGES)]))
def changed(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """The ranges of words in which two arrays of word hashes differ."""
    return pd.DataFrame(changed_ranges(list(before), list(after)), columns=["before", "after"])


def shown(words: Column, ranges: Column, context: int = CONTEXT, most: int = MOST_CHARACTERS) -> Column:
    """The words of the ranges and `context` words on both sides; `…` for what is left out between them. A text of more than
    `most` characters ends with its last whole word below that and `…`."""

    def said(places: Column) -> Column:
        def one(i: Column, n: Column) -> Column:
            skipped = (n > 0) & (F.get(places, n - 1) < i - 1)
            return F.when(skipped, F.concat(F.lit("… "), F.get(words, i))).otherwise(F.get(words, i))

        return F.array_join(F.transform(places, one), " ")

    all_places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    near = F.filter(all_places, lambda i: F.exists(ranges, lambda r: (i >= r[0] - context) & (i < r[1] + context)))
    text = X.let(near, said)
    return X.let(text, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), " [^ ]*$", ""), F.lit(" …"))))


def excerpts(rows: DataFrame, before: str = "before", after: str = "after", context: int = CONTEXT, most: int = MOST_CHARACTERS) -> DataFrame:
    """The rows with both texts as masked excerpts of what differs; equal texts are empty, nulls are empty texts."""
    words = lambda c: F.filter(F.split(names_masked(masked(F.coalesce(F.col(c), F.lit("")))), r"\s+"), lambda w: w != "")
    cut = rows.withColumns({"_before": words(before), "_after": words(after)})
    met = cut.withColumn("_r", changed(X.hashed(F.col("_before")), X.hashed(F.col("_after"))))
    made = met.withColumns({before: shown(F.col("_before"), F.col("_r.before"), context, most), after: shown(F.col("_after"), F.col("_r.after"), context, most)})
    return made.drop("_before", "_after", "_r")


_DUCK_MASKED = rf"regexp_replace(array_to_string(list_transform(w, lambda x: CASE WHEN x.capital AND (NOT x.opens OR list_contains({_DUCK_INSIDE}, x.said)) THEN '[NAME]' ELSE x.said END), ''), '\[NAME\]([\s-]+((of|the|de)\s+)?\[NAME\])+', '[NAME]', 'g')"


@query(
    "txt_edit_excerpt",
    rf"""WITH j AS (SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda x: x <> ''), ' ') AS t FROM conversations),
    m AS (SELECT conv_id, turn, list_filter(string_split({_DUCK_MASKED}, ' '), lambda x: x <> '') AS w FROM {_duck_pieces("t", "j")}),
    e AS (SELECT conv_id, turn, array_to_string(CASE WHEN len(w) > {CONTEXT} THEN w[-{CONTEXT}:] ELSE w END, ' ') AS tail FROM m)
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE tail END AS before, CASE WHEN turn % 2 = 0 THEN '' ELSE trim(concat(tail, ' added [N] words')) END AS after FROM e""",
)
def txt_edit_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn's words against the same with three more at the end (odd turns) or unchanged."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("before"))
    new = F.when(F.col("turn") % 2 == 1, F.concat(F.col("before"), F.lit(" added 12 words"))).otherwise(F.col("before"))
    return excerpts(rows.withColumn("after", new)).select("conv_id", "turn", "before", "after")
