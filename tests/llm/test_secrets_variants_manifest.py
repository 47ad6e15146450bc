"""Secret scans, spelling variants and the Merkle manifest against plain Python, on texts with every defined case."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import merkle, secret_scan, variants
from tidemark.llm.queries import MANIFEST_FIELDS, op11_secret_scan, op12_spelling_variants, op13_merkle_manifest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, word string, pos bigint, tree string, row string, path string"


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    rare = [w[:1] + "c" + w[1:] for w in stems[:30]]
    text = lambda n: " ".join(rng.choice(stems if rng.random() < 0.9 else rare) for _ in range(n))
    texts = [None, "", "\n", "a\nb", "x" * 300_000, "Straße ×÷ ÀÉÿ Àéÿxy İstanbul", text(50) + "\n" + text(30), "token: " + "ab1" * 9, text(3000)]
    texts += [text(rng.randint(1, 60)) for _ in range(60)]
    made = [(i, t, "en", f"s{i % 4}" if i % 3 else "hot", None if t is None else len(t), "k", "w", 5, "t", "r", "p") for i, t in enumerate(texts)]
    made += [made[3], made[3], (None, "a\nb c", None, None, None, *made[0][5:]), (None, None, "de", "", 3, *made[0][5:]), (-7, "tail\n", "de", None, 5, *made[0][5:]), (3, "other", "fr", "hot", 5, *made[0][5:])]
    return made + [(100 + i, None, None, f"é{i}", None, *made[0][5:]) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(found):
    return sorted(map(repr, map(tuple, found)))


# secrets


def base_spans(text):
    text, found = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def digest_row(doc_id, text):
    base = base_spans(text)
    said = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
    return doc_id, *[sum(k == j for _, j, _ in base) for k in range(3)], hashlib.sha256(said.encode()).hexdigest()


def test_base_secrets_of_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_secret_scan(spark, SF)
    assert _sorted(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()) == _sorted(digest_row(*d) for d in docs)
    for r in got.collect():
        assert not r["unopened"]
        assert {f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base_spans(dict(docs)[r["doc_id"]])} <= set(filter(None, r["spans"].split(",")))


SECRET = 'Token = "abcDEF123456789"'
PLAIN = "é nothing "


def _found(text):
    raw = text.encode()
    found, unopened = secret_scan.findings(raw)
    assert not unopened
    return {(kind, raw[s:e].decode()): layers for (kind, s, e), layers in found.items()}


@pytest.mark.parametrize("zipped", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress])
def test_secrets_in_compressed_layers(zipped):
    packed = b64(zipped(b64(zipped((PLAIN + SECRET * 5).encode())).encode()))
    assert ("assign", packed.rstrip("=")) in _found(f"{PLAIN}{packed} {PLAIN}")


def test_secrets_in_nested_layers_are_mapped_to_their_place():
    part = 'Token = "abcDEF123456789'
    quoted = urllib.parse.quote(part)
    assert _found(PLAIN + quoted + " x") == {("assign", quoted): "escapes"}
    twice = urllib.parse.quote(quoted)
    assert _found(PLAIN + twice) == {("assign", twice): "escapes"}
    assert _found(PLAIN + b64(part) + " x") == {("assign", b64(part)): "base64"}
    assert _found(PLAIN + "/" + b64(part)) == {("assign", b64(part)): "base64"}
    wrapped = b64("some words before " * 4 + part)
    lines = "\r\n".join(wrapped[i : i + 76] for i in range(0, len(wrapped), 76))
    assert [k for k, _ in _found(lines)] == ["assign"]
    assert _found("".join(f"\\u{ord(c):04x}" for c in part)) == {("assign", "".join(f"\\u{ord(c):04x}" for c in part)): "escapes"}
    assert _found("&#84;oken&#x3D;abcdef-abcdef") == {("assign", "&#84;oken&#x3D;abcdef-abcdef"): "escapes"}
    deep = urllib.parse.quote(b64(b64(part)))
    assert list(_found(PLAIN + deep).values()) == ["escapes>base64>base64"]  # it ends in %3D
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "AKIA") + "ABCDEFGH12345678"
    assert _found(wide) == {("access", wide): "escapes"}
    assert _found("ſecret=abcdefghijkl to\u212Aen=abcdefghijkl") == {}  # only ASCII letters have another case


def test_spans_stay_the_same_under_escapes_beside_them():
    text = f"{SECRET} %41%C3%A9 {SECRET}"
    assert {layers for layers in _found(text).values()} == {""}
    assert len(secret_scan.findings(text.encode())[0]) == 2


def test_layers_that_unpack_to_themselves_end_and_bombs_are_reported():
    """A chain of ever the same content ends; a stream beyond the bound is said to be unopened."""
    chain = "%" + "25" * 50_000 + "41KIAABCDEFGH12345678"
    assert ("access", chain) in _found(chain)
    packed = b64(zlib.compress(b"\0" * 3_000_000 + SECRET.encode()))
    assert secret_scan.findings(packed.encode(), most_unpacked=1_000_000) == ({}, True)
    assert list(secret_scan.findings(packed.encode())[0].values()) == ["base64>packed"]


def test_secret_rows(spark, docs, none, rows):
    made = secret_scan.with_secrets(docs)
    assert made.schema["row"].dataType == docs.schema and made.count() == len(rows)
    one = made.filter("row.doc_id = 7").first()
    assert [(s["kind"], s["start"], s["end"]) for s in one["spans"]] == [("assign", 0, 34), ("hex", 7, 34)]
    assert made.filter("row.text IS NULL AND size(spans) > 0").count() == 0
    assert secret_scan.with_secrets(none).count() == 0
    long = spark.createDataFrame([(1, "é" * 1_500_000 + " " + SECRET)], "doc_id bigint, text string")
    assert [(s["start"], s["end"]) for s in secret_scan.with_secrets(long, columns=["doc_id"]).first()["spans"]] == [(1_500_001, 1_500_001 + len(SECRET) - 1)]


# spelling variants


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(beside[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_by_comparing_all_words(docs, none, rows):
    expected = brute_variants([r[:2] for r in rows])
    assert any(e[1] for e in expected) and any(e[1] is None for e in expected)
    assert _sorted(variants.grouped(variants.runs(docs)).collect()) == _sorted(expected)
    assert _sorted(variants.grouped(variants.runs(docs), most_bits=1 << 15, bits_per_word=1).collect()) == _sorted(expected)
    assert variants.grouped(variants.runs(none)).count() == 0


def test_variants_of_chains_runs_and_long_words(spark):
    words = ["aaaaa"] * 3 + ["aaaaaa"] * 6 + ["aaaaaaa"] * 12 + ["aaaaaaab"] * 24 + ["b" * 400_000] * 6 + ["b" * 400_001] * 3 + ["zzzzz"] * 3 + ["zzzzy"] * 4
    found = {r["word"]: tuple(r)[1:] for r in variants.grouped(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert [found["a" * n] for n in (5, 6, 7)] == [("aaaaaa", "aaaaaaab", 3, 1, 6), ("aaaaaaa", "aaaaaaab", 6, 2, 12), ("aaaaaaab", "aaaaaaab", 12, 2, 24)]
    assert found["b" * 400_001] == ("b" * 400_000, "b" * 400_000, 3, 1, 6)
    assert found["zzzzz"] == (None, "zzzzz", 3, 1, None) and found["zzzzy"] == (None, "zzzzy", 4, 1, None)


# manifest


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _up(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([_h("".join(rows[-1][i : i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def brute_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda *values: _h("".join(map(said, values)))
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        cut = None if text is None else text.replace("\n", "")
        trees.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, cut)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    made = {s: _up([x[1] for x in trees[s]]) for s in order}
    top, out = _up([made[s][-1][0] for s in order]), []
    for number, s in enumerate(order):
        for i, (doc_id, own, changed) in enumerate(trees[s]):
            node = changed if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else own
            siblings = ""
            for levels, at in ((made[s], i), (top, number)):
                for row in levels[:-1]:
                    run = at - at % 3
                    before, after = "".join(row[run:at]), "".join(row[at + 1 : run + 3])
                    siblings, node, at = siblings + before + after, _h(before + node + after), at // 3
            out.append((doc_id, own, made[s][-1][0], top[-1][0], _h(siblings), node, node == top[-1][0]))
    return out


def _manifest(docs, **sizes):
    made = merkle.proofs(docs, MANIFEST_FIELDS, carry={"n": F.col("n_chars")}, **sizes)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), merkle.folded(F.col("leaf"), F.col("path")))


@pytest.mark.parametrize("sizes", [{}, {"levels": 1, "top": 4}, {"levels": 2, "top": 20}])
def test_manifest_by_plain_trees(docs, rows, sizes):
    """Also with so small a driver's tree that groups and the tree over them are built in rounds."""
    expected = [e[:5] + (e[3],) for e in brute_manifest([r[:5] for r in rows])]
    assert _sorted(_manifest(docs, **sizes).collect()) == _sorted(expected)


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _sorted(op13_merkle_manifest(spark, SF).collect()) == _sorted(brute_manifest(rows))


def test_manifest_of_few_rows(spark, none):
    assert _manifest(none).count() == 0
    one = spark.createDataFrame([(1, "a", "en", None, 1, *[None] * 6)], SCHEMA)
    row = _manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == _h("1:1-2:en1:11:a") and row[4] == _h("") and row[5] == row["root"]


def test_variants_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _sorted(op12_spelling_variants(spark, SF).collect()) == _sorted(brute_variants(rows))


def test_html_text_does_not_depend_on_the_order_of_rows(spark):
    """Pages of one body and different boxes around it: the same texts in whatever order the rows come."""
    from tidemark.llm import html_text

    page = lambda i, body, box: (i, f"http://a.org/{i}", f"<html><body><div>{box}</div><p>{body}</p></body></html>")
    rows = [page(1, "Shared body text of some length.", "X"), page(2, "Shared body text of some length.", "Y"), page(3, "Other text.", "X"), page(4, "A third text.", "X"), page(5, "Fourth.", "Y")]
    texts = set()
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [1, 0, 4, 2, 3]):
        made = html_text.extracted(spark.createDataFrame([rows[i] for i in order], "page_id int, url string, html string").coalesce(1))
        texts.add(tuple(sorted((r["row"]["page_id"], r["text"]) for r in made.collect())))
    assert len(texts) == 1


def test_names_within_an_article_count_whole():
    from tidemark.llm.html_text import main_text

    body = '<div class="search-and-rescue">Boats went out.</div><section id="navigation-history"><p>Maps of old.</p></section>'
    gone = '<div class="cookie-notice-bar">We bake.</div><ul class="comments list"><li>First!</li></ul><div class="discussion">I agree.</div><div class="ad-slot-2 x">Buy.</div><div id="share_buttons">Share.</div>'
    assert main_text(f"<body><article><p>Text.</p>{body}{gone}</article></body>", set()) == "Text.\nBoats went out.\nMaps of old."
    assert main_text(f"<body><p>Text.</p><div class='sidebar-history'>Aside.</div>{gone}</body>", set()) == "Text."
