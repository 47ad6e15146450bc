"""Full-text search over a stored inverted index, ranked by BM25 with field weights.

The index is two Parquet tables in the shared folder and a row of totals. The dictionary is sorted by term: a prefix term
is a range of it, which the files' statistics narrow. The postings are sorted by term and falling impact (the part of the
score that does not depend on the query), so the best postings of a term lie together; the dictionary holds how many
postings of a term lie on each level of impact. A search reads the postings of its rarest term from the top level down and
stops once no section further down can reach the last place of the result.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.sinks import stored
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources.tables import read_table

#: Query terms used and their letters, sections ranked and shown a page, BM25's constants, field weights.
MOST_TERMS, TERM_LETTERS = 8, 64
MOST_HITS, PAGE_SECTIONS = 200, 3
K1, B = 1.2, 0.75
WEIGHTS = {"title": 8.0, "heading": 4.0, "body": 1.0, "tags": 1.0}
TOKEN = r"[\p{L}\p{N}_]+"
#: Width of a level of impact, and postings of the first round of a search; each further round takes four times as many.
LEVEL, FIRST_ROUND = 0.02, 4096


def query_terms(text: str) -> list[str]:
    """The distinct words of a query in lower case, cut and limited as above."""
    words = [w[:TERM_LETTERS] for w in re.findall(r"\w+", text.lower())]
    return list(dict.fromkeys(words))[:MOST_TERMS]


def impact(f: Column, length: Column | float, mean: Column | float) -> Column:
    """BM25 without its idf, of a weighted term frequency."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def idf(n: int, held: int) -> float:
    """n sections, of which `held` have the term; common terms count nearly nothing, never less."""
    value = math.log((n - held + 0.5) / (held + 0.5))
    return value if value > 0 else 1e-6


class SearchIndex:
    """An index in a folder: build() writes it, search() reads it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.postings = spark.read.parquet(f"{folder}/postings")
        self.dictionary = spark.read.parquet(f"{folder}/dictionary")
        self.n, self.mean = spark.read.parquet(f"{folder}/totals").first()

    @classmethod
    def build(cls, sections: DataFrame, folder: str | None = None, weights: dict[str, float] = WEIGHTS) -> SearchIndex:
        """sections: page, section (together a key) and the fields of `weights`; nulls are empty."""
        spark = sections.sparkSession
        folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        words = lambda f: F.coalesce(F.regexp_extract_all(F.lower(F.col(f)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
        weighed = lambda field, weight: F.transform(words(field), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))
        dealt = sections.repartition("page", "section")  # texts are dealt out once; their words need no second shuffle to be counted
        said = dealt.select("page", "section", F.concat(*[weighed(f, w) for f, w in weights.items()]).alias("said"))
        each = said.select("page", "section", F.size("said").alias("length"), F.inline_outer("said")).filter("term IS NOT NULL")  # inline() would make the words twice
        counted = stored(each.groupBy("page", "section", "length", "term").agg(F.sum("weight").alias("f"), F.count("*").alias("tf")), "counts")
        n, length = sections.count(), counted.agg(F.sum("tf")).first()[0] or 0  # one number each
        spark.createDataFrame([(n, length / max(n, 1))], "n bigint, mean double").write.parquet(f"{folder}/totals")
        posted = counted.select("page", "section", "length", "term", "f", impact(F.col("f"), F.col("length"), max(length, 1) / max(n, 1)).alias("impact"))
        ordered = posted.repartitionByRange("term", F.desc("impact"), "page").sortWithinPartitions("term", F.desc("impact"), "page", "section")
        ordered.write.parquet(f"{folder}/postings")
        posted = spark.read.parquet(f"{folder}/postings")
        levels = posted.groupBy("term", F.floor(F.col("impact") / LEVEL).cast("int").alias("level")).agg(F.count("*").alias("n"))
        terms = levels.groupBy("term").agg(F.sum("n").alias("df"), F.max("level").alias("top"), F.collect_list(F.struct("level", "n")).alias("levels"))
        stored(terms, "terms").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/dictionary")
        return cls(spark, folder)

    def _of(self, table: DataFrame, words: list[str]) -> DataFrame:
        """The rows of a table whose term begins with one of the words, once for each such word."""
        term = F.col("term")
        begins = term.startswith(words[0])
        for w in words[1:]:
            begins = begins | term.startswith(w)
        met = F.filter(F.array(*map(F.lit, words)), lambda w: term.startswith(w))
        return table.filter(begins).withColumn("word", F.explode(met))

    def _statistics(self, words: list[str]) -> dict[str, dict]:
        """For each word: terms it begins, sections that have one of them, highest level, postings on each level."""
        met = self._of(self.dictionary, words)
        level = met.select("word", "term", F.inline("levels")).groupBy("word", "level").agg(F.sum("n").alias("n"))
        out = {r["word"]: {"terms": r["terms"], "n": r["n"], "top": r["top"], "levels": {}} for r in met.groupBy("word").agg(F.count("*").alias("terms"), F.sum("df").alias("n"), F.max("top").alias("top")).collect()}
        for r in level.collect():  # a row a word and level
            out[r["word"]]["levels"][r["level"]] = r["n"]
        wide = [w for w in words if w in out and out[w]["terms"] > 1]
        if wide:
            for r in self._of(self.postings, wide).select("word", "page", "section").distinct().groupBy("word").count().collect():
                out[r["word"]]["n"] = r["count"]
        return out

    def _scored(self, words: list[str], stats: dict[str, dict], rarest: str, least: float) -> DataFrame:
        """page, section, score of the sections that have all words, among those where the rarest has an impact from `least` on."""
        some = self._of(self.postings.filter(F.col("impact") >= least), [rarest]).select("page", "section").distinct()
        weigh = F.coalesce(*[F.when(F.col("word") == w, F.lit(idf(self.n, stats[w]["n"]))) for w in words])
        held = self._of(self.postings, words).join(some, ["page", "section"], "left_semi")
        by_word = held.groupBy("page", "section", "length", "word").agg(F.sum("f").alias("f"))
        scored = by_word.select("page", "section", (weigh * impact(F.col("f"), F.col("length"), self.mean)).alias("part"))
        whole = scored.groupBy("page", "section").agg(F.sum("part").alias("score"), F.count("*").alias("found"))
        return whole.filter(F.col("found") == len(words)).select("page", "section", F.round("score", 6).alias("score"))

    def hits(self, text: str, most: int = MOST_HITS) -> DataFrame:
        """page, section, score: the `most` best sections that hold a word for every term of the query, each of which may
        be the beginning of a word."""
        schema = "page {}, section {}, score double".format(*(self.postings.schema[c].dataType.simpleString() for c in ("page", "section")))
        words = query_terms(text)
        stats = self._statistics(words) if words else {}
        if not words or len(stats) < len(words):
            return self.spark.createDataFrame([], schema)
        rarest = min(words, key=lambda w: (stats[w]["n"], w))
        peak = lambda w, level: min(K1 + 1, stats[w]["terms"] * (level + 1) * LEVEL)
        others = sum(idf(self.n, stats[w]["n"]) * peak(w, stats[w]["top"]) for w in words if w != rarest)
        levels, size, taken = sorted(stats[rarest]["levels"], reverse=True), FIRST_ROUND, 0
        best: list = []
        while levels:
            while levels and taken < size:
                low = levels.pop(0)
                taken += stats[rarest]["levels"][low]
            found = self._scored(words, stats, rarest, low * LEVEL if levels else 0.0)
            best = found.orderBy(F.desc("score"), "page", "section").limit(most).collect()  # `most` rows
            beyond = idf(self.n, stats[rarest]["n"]) * peak(rarest, low - 1) + others
            if len(best) == most and best[-1]["score"] > beyond + 1e-6:
                break
            size *= 4
        return self.spark.createDataFrame(best, schema)

    def search(self, text: str, most: int = MOST_HITS, per_page: int = PAGE_SECTIONS) -> DataFrame:
        """place (of the page, from 1), page, section, score: the best sections of each page among the hits, at most
        `per_page` of one, pages in order of their best section."""
        hits = self.hits(text, most)
        in_page = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "section"))
        shown = hits.withColumn("nth", in_page).filter(F.col("nth") <= per_page)
        first = shown.filter("nth = 1").withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "page")))  # MOST_HITS rows at most
        return shown.join(first.select("page", "place"), "page").select("place", "page", "section", "score")


def document_sections(docs: DataFrame) -> DataFrame:
    """Documents as pages: a section is a line that is not blank, headed by its first five words; the title is the first
    eight words of the first line."""
    first = lambda text, n: F.array_join(F.slice(F.split(text, " "), 1, n), " ")
    pages = docs.select(F.col("doc_id").alias("page"), first(F.substring_index("text", "\n", 1), 8).alias("title"), F.concat_ws(" ", "source", "lang").alias("tags"), F.split("text", "\n", -1).alias("lines"))
    each = pages.select("page", "title", "tags", F.posexplode("lines").alias("section", "body"))
    return each.filter(F.trim("body") != "").withColumn("heading", first(F.col("body"), 5))


#: The query that the catalogue runs.
ASKED = "thing tion at"
_FIELDS = " UNION ALL ".join(f"SELECT page, section, unnest(regexp_extract_all(lower({f}), '{TOKEN}')) AS term, {w} AS weight FROM s" for f, w in WEIGHTS.items())
_DUCK_SECTIONS = """
    l AS (SELECT doc_id AS page, string_split(text, chr(10)) AS lines, concat_ws(' ', source, lang) AS tags FROM documents),
    x AS (SELECT page, array_to_string(string_split(lines[1], ' ')[1:8], ' ') AS title, tags, unnest(lines) AS body, generate_subscripts(lines, 1) - 1 AS section FROM l),
    s AS (SELECT *, array_to_string(string_split(body, ' ')[1:5], ' ') AS heading FROM x WHERE trim(body) <> '')"""


@query(
    "txt_fts_bm25",
    f"""
    WITH {_DUCK_SECTIONS}, t AS ({_FIELDS}),
         dl AS (SELECT page, section, count(*) AS length FROM t GROUP BY 1, 2),
         n AS (SELECT (SELECT count(*) FROM s) AS n, (SELECT sum(length) FROM dl) / (SELECT count(*) FROM s) AS mean),
         q AS (SELECT unnest({query_terms(ASKED)!r}) AS word),
         f AS (SELECT word, page, section, sum(weight) AS f FROM t JOIN q ON starts_with(term, word) GROUP BY 1, 2, 3),
         df AS (SELECT word, count(*) AS held FROM f GROUP BY 1),
         i AS (SELECT word, CASE WHEN n > 2 * held THEN ln((n - held + 0.5) / (held + 0.5)) ELSE 1e-6 END AS idf FROM df CROSS JOIN n),
         sc AS (SELECT page, section, round(sum(idf * f * {K1 + 1} / (f + {K1} * ({1 - B} + {B} * length / mean))), 6) AS score FROM f JOIN i USING (word) JOIN dl USING (page, section) CROSS JOIN n
                GROUP BY 1, 2 HAVING count(*) = {len(query_terms(ASKED))}),
         h AS (SELECT * FROM sc ORDER BY score DESC, page, section LIMIT {MOST_HITS}),
         r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, section) AS nth FROM h),
         p AS (SELECT page, row_number() OVER (ORDER BY score DESC, page) AS place FROM r WHERE nth = 1)
    SELECT CAST(place AS INT) AS place, page, CAST(section AS INT) AS section, score FROM r JOIN p USING (page) WHERE nth <= {PAGE_SECTIONS}""",
)
def txt_fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sections of the documents for a query of three beginnings of words."""
    return SearchIndex.build(document_sections(read_table(spark, sf_dir, "documents"))).search(ASKED)
