"""Checks of writing rules: clauses that ask for additions, and phrases that explain the edits of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.edits import _DUCK_MASKED
from tidemark.operators.names import MASKS, _duck_mask, _duck_pieces, names_masked
from tidemark.operators.text_rules import masked
from tidemark.plans.registry import frame, query
from tidemark.sources.tables import read_table

# Verbs that ask for an addition, what takes them back, and what ends a clause.
ADDING = (
    "add adds adding include includes including mention mentions mentioning say state states stating highlight highlights emphasise emphasize "
    "emphasises emphasizes promise promises offer offers list lists note describe describes feature features insert inserts introduce "
    "introduces cite tell advertise showcase guarantee"
).split() + ["always use"]
TAKING_BACK = ("do not", "don't", "don’t", "never", "no", "not", "avoid", "without", "stop", "refrain from", "instead of", "rather than", "unless", "only if", "cut", "remove", "drop", "delete")
CLAUSE_ENDS = r"[.;:!?]|,\s*(?:and|but|or)\s+|\s+(?:and\s+)?then\s+"

_ANY = lambda words: "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"
#: The text of a clause up to its first adding verb; a verb that follows another adds nothing to the verdict.
_UPTO = rf"(?is)^(.*?(?:^|[^a-z])){_ANY(ADDING)}(?:[^a-z]|$)"
_TAKEN_BACK = rf"(?i)(?:^|[^a-z]){_ANY(TAKING_BACK)}(?:[^a-z]|$)"


def asks_for_more(clause: Column) -> Column:
    """Whether a clause has an adding verb with nothing before it that takes it back."""
    return clause.rlike(_UPTO) & ~F.regexp_extract(clause, _UPTO, 1).rlike(_TAKEN_BACK)


def adding_clauses(text: Column) -> Column:
    """The clauses of a rule that ask for additions, trimmed."""
    return F.filter(F.transform(F.split(text, f"(?i){CLAUSE_ENDS}", -1), lambda c: F.trim(c)), asks_for_more)


_RULE = "concat(CASE turn % 6 WHEN 0 THEN 'Do not mention Bali. ' WHEN 1 THEN 'Always use colour, and list prices; ' WHEN 2 THEN 'Never say cheap then  describe ' WHEN 3 THEN 'Shorten, or add maps. ' WHEN 4 THEN 'Notes stay! ' ELSE '' END, text)"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    "txt_lint_clauses",
    f"""WITH c AS (SELECT conv_id, turn, unnest(regexp_split_to_array({_RULE}, '(?i){CLAUSE_ENDS}')) AS clause FROM conversations),
    f AS (SELECT conv_id, turn, regexp_matches(trim(clause), '{_UPTO}') AND NOT regexp_matches(regexp_extract(trim(clause), '{_UPTO}', 1), '{_sql(_TAKEN_BACK)}') AS adds FROM c)
    SELECT conv_id, turn, count(*) FILTER (WHERE adds) AS adding FROM f GROUP BY 1, 2""",
)
def txt_lint_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, f"SELECT conv_id, turn, {_RULE} AS rule FROM conversations")
    return rows.select("conv_id", "turn", F.size(adding_clauses(F.col("rule"))).cast("bigint").alias("adding"))


_TOKENS = rf"\[(?:{'|'.join(MASKS)})\]|[A-Za-z0-9][A-Za-z0-9'’-]*"


def tokens(text: Column) -> Column:
    """The words of the masked text in lower case, and its masks."""
    found = F.regexp_extract_all(names_masked(masked(text)), F.lit(_TOKENS), F.lit(0))
    return F.transform(found, lambda w: F.when(w.startswith("["), w).otherwise(F.lower(w)))


def explained(phrases: DataFrame, edits: DataFrame, least: int = 2) -> DataFrame:
    """phrase, edits: how many edits (id, before, after) take a phrase (phrase, size in words, as tokens() gives it) out of a
    text altogether, if `least` or more. Only runs of words as long as a phrase are looked up, by a join."""
    sizes = [r["size"] for r in phrases.select("size").distinct().orderBy("size").collect()]  # lengths only
    if not sizes:
        return phrases.select("phrase", F.lit(0).cast("bigint").alias("edits")).limit(0)

    def runs(side: str) -> DataFrame:
        made = X.let(tokens(F.col(side)), lambda w: F.concat(*[X.shingles(w, n) for n in sizes]))
        return edits.filter(F.col(side).isNotNull()).select("id", F.explode(F.array_distinct(made)).alias("phrase"))

    known = phrases.select("phrase").distinct()
    gone = runs("before").join(known, "phrase").join(runs("after").join(known, "phrase"), ["id", "phrase"], "left_anti")
    return gone.groupBy("phrase").agg(F.count("*").alias("edits")).filter(F.col("edits") >= least)


_DUCK_TOKENS = f"list_transform(regexp_extract_all({_DUCK_MASKED}, '{_sql(_TOKENS)}'), lambda x: CASE WHEN starts_with(x, '[') THEN x ELSE lower(x) END)"


@query(
    "txt_predict_explains",
    f"""WITH k AS (SELECT conv_id, turn, {_DUCK_TOKENS} AS tok FROM {_duck_pieces("t", f"(SELECT conv_id, turn, {_duck_mask('text')} AS t FROM conversations)")}),
    g AS (SELECT conv_id, turn, list_distinct(list_concat(tok, [concat(tok[i], ' ', tok[i + 1]) for i in generate_series(1, len(tok) - 1)])) AS runs FROM k),
    e AS (SELECT runs, lag(runs) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM g),
    p AS (SELECT DISTINCT unnest([tok[1], concat(tok[1], ' ', tok[2])]) AS phrase FROM k WHERE turn = 0 AND len(tok) >= 2)
    SELECT phrase, count(*) AS edits FROM e JOIN p ON list_contains(before, phrase) AND NOT list_contains(runs, phrase) GROUP BY 1 HAVING count(*) >= 2""",
)
def txt_predict_explains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases: the first word and the first two of every conversation. Edits: each turn to the next."""
    turns = read_table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    edits = turns.select(F.struct("conv_id", "turn").alias("id"), F.lag("text").over(order).alias("before"), F.col("text").alias("after"))
    first = turns.filter("turn = 0").select(tokens(F.col("text")).alias("w")).filter("size(w) >= 2")
    phrases = first.select(F.inline(F.array(*[F.struct(F.array_join(F.slice("w", 1, n), " ").alias("phrase"), F.lit(n).alias("size")) for n in (1, 2)])))
    return explained(phrases, edits)
