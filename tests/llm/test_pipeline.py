"""The pipeline against a plain one: sets, byte windows and the library's ids, over whole documents."""

import re

import pytest
import sentencepiece

import corpus_pipeline
from tidemark.llm import quality
from tidemark.sources.tables import read_table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _one_of_each(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: t for i, t in texts.items() if find(i) == i}


def _without_repeats(texts):
    first, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first.setdefault(b[s : s + 100], (i, s)) != (i, s):
                gone[s : s + 100] = b"\1" * 100
        # a character goes when all its bytes do
        out[i] = "".join(c for c, g in _with_flags(texts[i], gone) if not g)
    return {i: t for i, t in out.items() if t}


def _with_flags(text, gone):
    at = 0
    for c in text:
        n = len(c.encode())
        yield c, all(gone[at : at + n])
        at += n


def _clean(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for t in items:
        w = words(t)
        k = min(13, len(w))
        windows |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    out = {}
    for i, t in texts.items():
        w, hit = words(t), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
        if not hit or 20 * len(hit) < len(w):
            out[i] = t
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


def test_run_gives_the_rows_of_a_plain_pipeline(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_scores(docs).filter("kept").collect()}
    left = _one_of_each({i: t for i, t in texts.items() if i in good})
    assert len(left) < len(good) < len(texts)
    left = _clean(_without_repeats(left), [r["text"] for r in read_table(spark, SF, "benchmark").collect()])
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    made = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert made.keys() == left.keys()
    for i, t in left.items():
        ids = library.encode(t)
        assert (made[i]["n_tokens"], list(made[i]["ids"]), made[i]["decoded"]) == (len(ids), ids, library.decode(ids))


def test_stages_keep_the_columns_of_documents(spark, docs):
    made = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, SF)
        assert made.columns == COLUMNS, name
        rows = made.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows), name
        made = spark.createDataFrame(rows, made.schema)


def test_stages_take_empty_tables(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_leaves_tables_of_other_queries(spark):
    """A lazy result of another query can still be read after a run, and a run leaves only what its own result needs."""
    from tidemark.llm.common import mark
    from tidemark.llm.queries import op6_quality_rules

    before = op6_quality_rules(spark, SF)
    own = mark()
    corpus_pipeline.run(spark, SF).count()
    assert mark() == own and before.count() == read_table(spark, SF, "documents").count()
