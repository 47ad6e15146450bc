"""Document operators: duplicates, shingles, contamination, masking, scrubbing, validators and search."""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.sinks import stored
from tidemark.plans.registry import query, sql
from tidemark.sources.tables import read_table

sql(
    "txt_exact_dup",
    "SELECT md5(lower(trim(text))) AS k, lang, count(*) AS n, min(doc_id) AS keep FROM documents GROUP BY md5(lower(trim(text))), lang HAVING count(*) > 1",
)

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


_LEADS = "concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS gram, lead(word, 4) OVER w IS NOT NULL AS whole"


def _duck_grams(table: str, key: str) -> str:
    words = f"SELECT {key}, generate_subscripts(l, 1) AS pos, unnest(l) AS word FROM (SELECT {key}, {_WORDS} AS l FROM {table})"
    return f"SELECT DISTINCT {key}, gram FROM (SELECT {key}, {_LEADS} FROM ({words}) WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE whole"


@query("txt_shingles", f"SELECT documents.doc_id, count(gram) AS n FROM documents LEFT JOIN ({_duck_grams('documents', 'doc_id')}) g ON g.doc_id = documents.doc_id GROUP BY documents.doc_id")
def txt_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(X.shingles(X.words(F.col("text")), 5)).cast("bigint").alias("n"))


def near_duplicate_pairs(rows: DataFrame, name_least: float = 0.8, body_least: float = 0.9, name_variant: float = 0.6) -> DataFrame:
    """a, b, kind, deleted, name_sim, body_sim: earlier row b that row a duplicates or varies; rows: id, block, name (array),
    body (array), days (null: unknown) and deleted.

    A duplicate has both sims and no other number of days; what else is like in one of them is a variant, unless it is
    deleted. Without the last two columns days are unknown and all rows live.

    Candidates share a block and a token of the part of the name that any match must touch: with names ordered by how
    rare their tokens are, a Jaccard of name_variant or more needs one among the first size - ceil(least * size) + 1; a
    matching body needs one the same way, by body_least. So pairs of a large block are not all formed. The sizes of two
    sets bound their Jaccard, which drops most candidates before whole sets are fetched.
    """

    for column, kind in (("days", "int"), ("deleted", "boolean")):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))

    def prefix(tokens: str, least: float) -> DataFrame:
        each = rows.select("id", "block", F.size(tokens).alias("size"), F.explode(tokens).alias("token"))
        count = each.groupBy("block", "token").agg(F.count("*").alias("n"))
        place = Window.partitionBy("id", "block").orderBy("n", "token")
        ranked = each.join(count, ["block", "token"]).withColumn("place", F.row_number().over(place))
        return ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("id", "block", "token", "size")

    pairs = None
    for tokens, least in (("name", name_variant), ("body", body_least)):
        p = prefix(tokens, least)
        side = lambda of: p.select(F.col("id").alias(of), "block", "token", F.col("size").alias(f"n_{of}"))  # noqa: E731, B023
        bounds = (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")) & (F.col("b") < F.col("a"))
        met = side("a").join(side("b"), ["block", "token"]).filter(bounds).select("a", "b")
        pairs = met if pairs is None else pairs.union(met)
    side = lambda of: rows.select(*[F.col(c).alias(of if c == "id" else f"{c}_{of}") for c in ("id", "name", "body", "days", "deleted")])
    full = pairs.distinct().join(side("a"), "a").join(side("b"), "b").withColumn("deleted", F.coalesce("deleted_b", F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scored = full.withColumns({"name_sim": zero(X.jaccard(F.col("name_a"), F.col("name_b"))), "body_sim": zero(X.jaccard(F.col("body_a"), F.col("body_b")))})
    same_days = F.coalesce(F.col("days_a") == F.col("days_b"), F.lit(True))
    both = (F.col("name_sim") >= name_least) & (F.col("body_sim") >= body_least) & same_days
    one = ~F.col("deleted") & ((F.col("name_sim") >= name_variant) | (F.col("body_sim") >= body_least))
    return scored.select("a", "b", F.when(both, "duplicate").when(one, "variant").alias("kind"), "deleted", "name_sim", "body_sim").filter("kind IS NOT NULL")


def best_match(pairs: DataFrame) -> DataFrame:
    """a, kind, match, deleted: of the duplicates a live one, then the most alike; without a duplicate the most alike
    variant; of equal ones the earliest. Sims count in hundredths."""
    name, body = (F.round(F.col(c) * 100).cast("int") for c in ("name_sim", "body_sim"))
    duplicate = F.col("kind") == "duplicate"
    rank = F.struct(F.when(duplicate, 0).otherwise(1).alias("kind"), "deleted", F.when(duplicate, -name).otherwise(-name - body).alias("first"), F.when(duplicate, -body).otherwise(0).alias("second"), "b")
    best = pairs.groupBy("a").agg(F.min(rank).alias("m"))
    return best.select("a", F.when(F.col("m.kind") == 0, "duplicate").otherwise("variant").alias("kind"), F.col("m.b").alias("match"), F.col("m.deleted").alias("deleted"))


#: Words that say nothing in a name.
NAME_STOP = ("tour", "tours", "trip", "days", "day", "the", "and", "of", "to", "in", "a", "with", "for")
_NAME_STOP_SQL = ", ".join(f"'{w}'" for w in NAME_STOP)
#: Documents as tours: the first eight words as name, the number of lines as days, toxic ones as deleted.
_TOURS = f"""SELECT d.doc_id, concat(source, '/', lang) AS block, list_distinct(list_filter({_WORDS}[1:8], lambda x: x NOT IN ({_NAME_STOP_SQL}))) AS name, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS body,
    CASE WHEN contains(text, chr(10)) THEN len(string_split(text, chr(10))) END AS days, coalesce(l.toxic = 1, false) AS deleted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


@query(
    "txt_near_dup_classify",
    f"""
    WITH w AS ({_TOURS}),
         s AS (SELECT x.doc_id AS a, y.doc_id AS b, y.deleted, coalesce(x.days = y.days, true) AS same_days,
                      CASE WHEN len(x.name) > 0 AND len(y.name) > 0 THEN len(list_intersect(x.name, y.name)) / CAST(len(list_distinct(list_concat(x.name, y.name))) AS DOUBLE) ELSE 0 END AS name_sim,
                      CASE WHEN len(x.body) > 0 AND len(y.body) > 0 THEN len(list_intersect(x.body, y.body)) / CAST(len(list_distinct(list_concat(x.body, y.body))) AS DOUBLE) ELSE 0 END AS body_sim
               FROM w x JOIN w y ON x.block = y.block AND y.doc_id < x.doc_id),
         k AS (SELECT *, CASE WHEN name_sim >= 0.8 AND body_sim >= 0.9 AND same_days THEN 'duplicate' WHEN NOT deleted AND (name_sim >= 0.6 OR body_sim >= 0.9) THEN 'variant' END AS kind, round(name_sim * 100) AS n, round(body_sim * 100) AS t FROM s)
    SELECT a AS doc_id, kind, b AS match, deleted FROM (
        SELECT *, row_number() OVER (PARTITION BY a ORDER BY kind, deleted, CASE WHEN kind = 'duplicate' THEN n ELSE n + t END DESC, CASE WHEN kind = 'duplicate' THEN t ELSE 0 END DESC, b) AS nth FROM k WHERE kind IS NOT NULL) t WHERE nth = 1""",
)
def txt_near_dup_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, body = X.words(F.col("text")), X.hashed(X.words(F.col("text"), "[a-z]{3,}"))
    name = X.hashed(F.filter(F.slice(tokens, 1, 8), lambda w: ~w.isin(*NAME_STOP)))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("deleted"))
    docs = read_table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("block"), F.array_distinct(name).alias("name"), F.array_distinct(body).alias("body"),
        F.when(F.contains("text", F.lit("\n")), F.size(F.split("text", "\n", -1))).alias("days"), "deleted",
    )
    return best_match(near_duplicate_pairs(stored(docs, "tokens"))).withColumnRenamed("a", "doc_id")


sql(
    "txt_near_dup_candidates",
    """
    WITH d AS (SELECT d.doc_id, source, lang, md5(substr(text, 1, 40)) AS grp, coalesce(l.toxic = 1, false) AS deleted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT a.doc_id, a.deleted FROM d a WHERE NOT a.deleted OR NOT EXISTS (SELECT 1 FROM d b WHERE b.grp = a.grp AND b.source = a.source AND b.lang = a.lang AND NOT b.deleted)""",
)


#: Words that alone make a run generic.
GENERIC_WORDS = ("a", "an", "and", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "with")
_GENERIC = f"(?:(?:{'|'.join(GENERIC_WORDS)}|[0-9]+)(?: |$))+"


def _specific(*words: Column) -> Column:
    """The hash of a run of words; null for one of generic words and numbers alone."""
    specific = F.lit(False)
    for w in words:
        specific = specific | ~(w.isin(*GENERIC_WORDS) | w.rlike("^[0-9]+$"))
    return F.when(specific, F.xxhash64(*words))


def _gram_overlap(spark: SparkSession, sf_dir: str, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """doc_id, item_id, common, n_doc, n_item: documents and benchmark items that share a word 5-gram, by an inverted join;
    grams without a hash do not count."""
    grams = lambda table, key: read_table(spark, sf_dir, table).select(key, F.array_compact(X.shingles(X.words(F.col("text")), 5, hashed)).alias("s"))
    docs, items = grams("documents", "doc_id"), grams("benchmark", "item_id")
    sized_items = items.select("item_id", F.size("s").alias("n_item"), F.explode("s").alias("gram"))
    grams = docs.select("doc_id", F.size("s").alias("n_doc"), F.explode("s").alias("gram")).join(sized_items, "gram")
    return grams.groupBy("doc_id", "item_id").agg(F.count("*").alias("common"), F.first("n_doc").alias("n_doc"), F.first("n_item").alias("n_item"))


_GRAMS = f"""
    dg AS ({_duck_grams("documents", "doc_id")}), bg AS ({_duck_grams("benchmark", "item_id")}),
    de AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_doc FROM dg), be AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_item FROM bg),
    o AS (SELECT doc_id, item_id, count(*) AS common, min(n_doc) AS n_doc, min(n_item) AS n_item FROM de JOIN be ON de.gram = be.gram GROUP BY doc_id, item_id)"""


@query("txt_shingle_jaccard", f"WITH {_GRAMS} SELECT doc_id, item_id, round(common / CAST(n_doc + n_item - common AS DOUBLE), 6) AS jaccard FROM o")
def txt_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_overlap(spark, sf_dir).select("doc_id", "item_id", F.round(F.col("common") / (F.col("n_doc") + F.col("n_item") - F.col("common")), 6).alias("jaccard"))


@query("txt_containment", f"WITH {_GRAMS} SELECT doc_id, item_id, round(common / CAST(n_item AS DOUBLE), 6) AS copied FROM o")
def txt_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_overlap(spark, sf_dir).select("doc_id", "item_id", F.round(F.col("common") / F.col("n_item"), 6).alias("copied"))


_LEAKED = _GRAMS.replace("bg AS (", "bg AS (SELECT * FROM (").replace(f"{_duck_grams('benchmark', 'item_id')})", f"{_duck_grams('benchmark', 'item_id')}) WHERE NOT regexp_full_match(gram, '{_GENERIC}'))", 1)


@query("txt_ngram_leak", f"WITH {_LEAKED} SELECT item_id, count(DISTINCT doc_id) AS docs, CAST(sum(common) AS BIGINT) AS grams FROM o GROUP BY item_id")
def txt_ngram_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose runs of five words are in documents; runs of stop words and numbers alone do not count."""
    return _gram_overlap(spark, sf_dir, _specific).groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.sum("common").alias("grams"))


_TURN = "[array_to_string(w[i:i+2], ' ') for i in generate_series(1, len(w) - 2)]"


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the user turn before it: shingle sets a and b, and the conversation's first turn as source."""
    turns = read_table(spark, sf_dir, "conversations").withColumn("s", X.shingles(X.words(F.col("text")), 3))
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumns({"b": F.lag("s").over(order), "source": F.first("s").over(order)})
    return paired.filter("role = 'assistant' AND b IS NOT NULL").select("conv_id", "turn", F.col("s").alias("a"), "b", "source")


_PAIRS = f"""
    t AS (SELECT conv_id, turn, role, list_distinct({_TURN}) AS s FROM (SELECT *, {_WORDS} AS w FROM conversations)),
    p AS (SELECT conv_id, turn, role, s AS a, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b, first(s) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM t),
    q AS (SELECT conv_id, turn, a, b, source FROM p WHERE role = 'assistant' AND b IS NOT NULL)"""


#: Jaccard from which two texts are the same, and from which one is warned of.
IDENTICAL, WARN = 0.95, 0.05


@query(
    "txt_overlap_beyond_source",
    f"""
    WITH {_PAIRS}, r AS (SELECT conv_id, turn, list_filter(a, lambda x: NOT list_contains(source, x)) AS a, list_filter(b, lambda x: NOT list_contains(source, x)) AS b FROM q),
    j AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) END AS overlap FROM r)
    SELECT conv_id, turn, overlap, CASE WHEN overlap >= 0.95 THEN 'identical' WHEN overlap >= 0.05 THEN 'overlap' WHEN overlap IS NULL THEN 'n/a' ELSE 'distinct' END AS verdict FROM j""",
)
def txt_overlap_beyond_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turn_pairs(spark, sf_dir).withColumns({"a": F.array_except("a", "source"), "b": F.array_except("b", "source")})
    scored = pairs.select("conv_id", "turn", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))
    o = F.col("overlap")
    return scored.withColumn("verdict", F.when(o >= IDENTICAL, "identical").when(o >= WARN, "overlap").when(o.isNull(), "n/a").otherwise("distinct"))


@query(
    "txt_overlap_report",
    f"""
    WITH {_PAIRS}, r AS (SELECT turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) END AS j FROM q)
    SELECT turn, count(*) AS n, round(CAST(sum(CAST(j AS DECIMAL(18,6))) AS DOUBLE) / count(j), 6) AS mean FROM r WHERE j IS NULL OR j < 0.95 GROUP BY turn""",
)
def txt_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _turn_pairs(spark, sf_dir).select("turn", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("j")).filter("j IS NULL OR j < 0.95")
    return j.groupBy("turn").agg(F.count("*").alias("n"), F.round(F.sum(F.col("j").cast("decimal(18,6)")).cast("double") / F.count("j"), 6).alias("mean"))


@query(
    "txt_align_evidence",
    r"""
    WITH l AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 3)) AS w FROM conversations),
         s AS (SELECT a.conv_id, a.turn, b.turn AS source_turn, len(list_intersect(a.w, b.w)) AS shared FROM l a JOIN l b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant')
    SELECT conv_id, turn, source_turn, CAST(shared AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, source_turn) AS n FROM s WHERE shared > 0) t WHERE n <= 3""",
)
def txt_align_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.array_distinct(F.filter(X.words(F.col("text"), "[a-z]+"), lambda w: F.length(w) > 3))
    lines = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", content.alias("w"))
    a = lines.filter("role = 'assistant'").select("conv_id", "turn", "w")
    b = lines.select("conv_id", F.col("turn").alias("source_turn"), F.col("w").alias("v"))
    shared = a.join(b, "conv_id").filter("source_turn < turn").withColumn("shared", F.size(F.array_intersect("w", "v")).cast("bigint")).filter("shared > 0")
    best = Window.partitionBy("conv_id", "turn").orderBy(F.desc("shared"), "source_turn")
    return shared.withColumn("n", F.row_number().over(best)).filter("n <= 3").select("conv_id", "turn", "source_turn", "shared")


#: Words that a style list forbids.
FORBIDDEN = ("stupid", "idiot", "trash", "loser", "moron", "clown", "scum")
_ALT = "|".join(FORBIDDEN)
sql(
    "txt_whole_word_forbidden",
    f"SELECT doc_id, regexp_like(lower(text), '(?<![a-z0-9])({_ALT})s?(?![a-z0-9])') AS forbidden FROM documents",
    f"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])({_ALT})s?($|[^a-z0-9])') AS forbidden FROM documents",
)
sql(
    "txt_error_classify",
    "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'timeout') THEN 'timeout' WHEN regexp_like(lower(text), 'rate|limit|429') THEN 'limit' WHEN contains(lower(text), 'the ') THEN 'english' WHEN length(text) = 0 THEN 'unknown' ELSE 'other' END AS class FROM conversations",
    "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'timeout') THEN 'timeout' WHEN regexp_matches(lower(text), 'rate|limit|429') THEN 'limit' WHEN contains(lower(text), 'the ') THEN 'english' WHEN length(text) = 0 THEN 'unknown' ELSE 'other' END AS class FROM conversations",
)
#: Comments, blocks that go with all in them, tags (again, as what is left may form new ones), script urls.
_STRIPPED = ["(?s)<!--.*?-->", *[f"(?is)<{t}[^>]*>.*?</{t}[^>]*>" for t in ("script", "style", "iframe", "object", "noscript", "template", "svg")], "<[^>]*>", "<[^>]*>", "(?i)(javascript|vbscript|data)[ ]*:"]


def _stripped(duck: bool) -> str:
    text = "html"
    for pattern in [*_STRIPPED, "[ \t\n\r]+"]:
        text = f"regexp_replace({text}, '{pattern}', ' '{', ' + chr(39) + 'g' + chr(39) if duck else ''})"
    return f"SELECT page_id, md5(trim({text})) AS text FROM pages"


sql("txt_html_strip", _stripped(False), _stripped(True))


sql(
    "txt_tag_extract",
    "SELECT page_id, array_join(array_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)), ' ') AS links FROM pages",
    "SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1) AS l FROM pages)",
)


def _figures(duck: bool) -> str:
    """The numbers of a text: thousands without their signs, 1990-95 as the years 1990 and 1995."""
    group, more = ("\\{}", ", 'g'") if duck else ("${}", "")
    to = lambda *parts: "".join(p if p == " " else group.format(p) for p in parts)
    text = "text"
    for _ in range(2):
        text = f"regexp_replace({text}, '([0-9]),([0-9][0-9][0-9])([^0-9]|$)', '{to('1', '2', '3')}'{more})"
    text = f"regexp_replace({text}, '([12][0-9])([0-9][0-9])[-–]([0-9][0-9])([^0-9]|$)', '{to('1', '2', ' ', '1', '3', '4')}'{more})"
    return f"regexp_extract_all({text}, '[0-9]+', 0)"


_FIG, _DUCK_FIG = _figures(False), _figures(True)
sql(
    "txt_novel_numbers",
    f"SELECT conv_id, turn, CAST(size(array_except({_FIG}, before)) AS BIGINT) AS novel FROM (SELECT *, lag({_FIG}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL",
    f"SELECT conv_id, turn, CAST(len(list_distinct(list_filter(f, lambda x: NOT list_contains(before, x)))) AS BIGINT) AS novel FROM (SELECT conv_id, turn, {_DUCK_FIG} AS f, lag({_DUCK_FIG}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL",
)
sql(
    "txt_figure_coverage",
    f"SELECT conv_id, turn, CASE WHEN size(before) > 0 THEN round(size(array_intersect(before, f)) / CAST(size(array_distinct(before)) AS DOUBLE), 6) END AS covered FROM (SELECT conv_id, turn, {_FIG} AS f, lag({_FIG}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL",
    f"SELECT conv_id, turn, CASE WHEN len(before) > 0 THEN round(len(list_intersect(before, f)) / CAST(len(list_distinct(before)) AS DOUBLE), 6) END AS covered FROM (SELECT conv_id, turn, {_DUCK_FIG} AS f, lag({_DUCK_FIG}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL",
)
sql("txt_embed_text", "SELECT source, count(CASE WHEN length(trim(text)) = 0 THEN 1 END) AS blank, CAST(sum(least(length(text), 25000)) AS BIGINT) AS chars FROM documents GROUP BY source")
sql("txt_embed_batching", "SELECT batch, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 96) AS BIGINT) AS batch FROM documents WHERE length(trim(text)) > 0) GROUP BY batch, source".replace("SELECT batch,", "SELECT source, batch,", 1))


def text_leaves(json: Column) -> Column:
    """All strings of a JSON text that are values, at any depth, in reading order; keys and numbers stay out."""
    quoted = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]|\\.)*")(?=\s*[,}\]])'), F.lit(1))
    return F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")


@query("txt_json_text_walk", """SELECT event_id, concat('T ', event_type, ' | day "', event_id, '" | a | b, c | end') AS words FROM events""")
def txt_json_text_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.concat(F.lit('{"title": "T '), "event_type", F.lit('", "skip": 5, "days": [{"name": "day \\"'), F.col("event_id").cast("string"), F.lit('\\"", "tags": ["a", "b, c"]}, "end"], "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(text_leaves(nested), " | ").alias("words"))
