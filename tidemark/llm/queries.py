"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, language_id, merkle, near_dedup, pieces, quality, secret_scan, sharding, suffixes, token_counts, url_filter, variants
from tidemark.sources.tables import read_table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.placed(read_table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return put.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES).select("row.page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encoded(docs, PIECE_MODEL)).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.grouped(read_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(read_table(spark, sf_dir, "documents"), PIECE_MODEL)
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = lambda id_: F.crc32(id_.cast("string").cast("binary")) % 4 == 2
    model = language_id.fitted(docs, ~held_out(F.col("doc_id")))
    said = language_id.predicted(docs.select("doc_id", "text"), model)
    return said.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extracted(read_table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_report(read_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.with_secrets(read_table(spark, sf_dir, "documents"), columns=["doc_id"])
    base = F.filter("spans", lambda s: s["layers"] == "")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.withColumn("base", base).select(
        "row.doc_id", *[count(kind) for kind in secret_scan.KINDS], F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), "unopened"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.runs(read_table(spark, sf_dir, "documents")))


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what each row folds to if some texts have lost their line feeds."""
    fields = [F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in MANIFEST_FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.leaf_of(*fields))
    made = merkle.proofs(read_table(spark, sf_dir, "documents"), MANIFEST_FIELDS, carry={"tampered": tampered})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    again = made.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return again.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _rule_case(then: str) -> str:
    """The longest rule that fits, as a CASE over the rules from the longest down."""
    out = []
    for action, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        out.append(f"WHEN {fits} THEN " + (f"'{host}{path}'" if then == "rule" else f"'{action}'"))
    return "CASE " + " ".join(out) + (" ELSE NULL END" if then == "rule" else " ELSE 'allow' END")


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of code points up to U+07FF, in SQL."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    units = f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {units}), lambda c, b: xor(c // 256, ({table})[xor(c % 256, b) + 1])), 4294967295)"


def _leaf_sql(text: str) -> str:
    said = [f"CASE WHEN {e} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({e} AS VARCHAR))), ':', {e}) END" for e in (*MANIFEST_FIELDS[:-1], text)]
    return f"sha256(concat({', '.join(said)}))"


ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": rf"""
        WITH rests AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
        ), hosts AS (
            SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts
        )
        SELECT page_id, host, path, {_rule_case("rule")} AS rule, {_rule_case("verdict")} AS verdict FROM hosts""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        o AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2), h AS (SELECT run, n, {_crc32_sql("concat(doc_id, ':', run)")} AS h FROM o),
        w AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        p AS (SELECT word, n, generate_series AS i FROM v, generate_series(1, length(word))),
        c AS (SELECT word, n, concat(substr(word, 1, i - 1), '*', substr(word, i + 1)) AS hole, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS short FROM p),
        near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.hole = b.hole AND a.word <> b.word
        UNION SELECT DISTINCT c.word, c.n, v.word, v.n FROM c JOIN v ON c.short = v.word UNION SELECT DISTINCT v.word, v.n, c.word, c.n FROM c JOIN v ON c.short = v.word),
        b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM near GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
        t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, t.next, f.form FROM t JOIN f ON f.word = t.next)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word WHERE t.next IS NULL""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered FROM documents),
        l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
        a AS (SELECT source, 0 AS level, pos AS idx, leaf AS digest, n FROM l
        UNION ALL SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY source, level, idx // 3, n),
        s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
        u AS (SELECT 0 AS level, pos AS idx, subroot AS digest, n FROM s
        UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, idx // 3, n),
        sa AS (SELECT source, level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM a WHERE n > 1 WINDOW w AS (PARTITION BY source, level, idx // 3 ORDER BY idx)),
        su AS (SELECT level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM u WHERE n > 1 WINDOW w AS (PARTITION BY level, idx // 3 ORDER BY idx)),
        x AS (SELECT l.source, l.pos, sa.level AS step, before, after FROM l JOIN sa ON sa.source IS NOT DISTINCT FROM l.source AND sa.idx = l.pos // CAST(pow(3, sa.level) AS BIGINT)
        UNION ALL SELECT l.source, l.pos, 100 + su.level, before, after FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN su ON su.idx = s.pos // CAST(pow(3, su.level) AS BIGINT)),
        y AS (SELECT source, pos, list(before ORDER BY step) AS befores, list(after ORDER BY step) AS afters, sha256(string_agg(concat(before, after), '' ORDER BY step)) AS proof FROM x GROUP BY source, pos),
        z AS (SELECT l.*, coalesce(befores, []) AS befores, coalesce(afters, []) AS afters, coalesce(proof, sha256('')) AS proof FROM l LEFT JOIN y ON y.source IS NOT DISTINCT FROM l.source AND y.pos = l.pos),
        f AS (SELECT source, pos, 0 AS k, coalesce(tampered, leaf) AS node, befores, afters FROM z UNION ALL SELECT source, pos, k + 1, sha256(concat(befores[k + 1], node, afters[k + 1])), befores, afters FROM f WHERE k < len(befores))
        SELECT z.doc_id, z.leaf, s.subroot, r.digest AS root, z.proof AS proof_sha256, f.node AS folded_root, f.node = r.digest AS verified
        FROM z JOIN f ON f.source IS NOT DISTINCT FROM z.source AND f.pos = z.pos AND f.k = len(z.befores) JOIN s ON s.source IS NOT DISTINCT FROM z.source CROSS JOIN (SELECT digest FROM u WHERE n = 1) r""",
}
