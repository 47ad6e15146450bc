"""Search, TF-IDF similarity and near-exact repeats against plain Python (and SQLite's own full-text ranking)."""

import difflib
import math
import random
import re
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import repeats, search, similar
from tidemark.operators.text_rules import MOST_DROPS


@pytest.fixture(scope="module")
def sections(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i // 5, i % 5, said(3), said(2), said(rng.randint(0, 60)), None if i % 7 else said(2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "page bigint, section int, title string, heading string, body string, tags string").repartition(6)
    return rows, frame, search.SearchIndex.build(frame)


def _sqlite(rows, text, most):
    con = sqlite3.connect(":memory:")
    con.execute("""CREATE VIRTUAL TABLE s USING fts5(page UNINDEXED, section UNINDEXED, title, heading, body, tags, tokenize = "unicode61 remove_diacritics 0")""")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?, ?, ?)", rows)
    asked = " ".join(f'"{w}"*' for w in search.query_terms(text))
    found = con.execute("SELECT page, section, -bm25(s, 0, 0, 8.0, 4.0, 1.0, 1.0) AS score FROM s WHERE s MATCH ?", (asked,)).fetchall()
    return sorted(((round(score, 6), page, section) for page, section, score in found), key=lambda x: (-x[0], x[1], x[2]))[:most]


@pytest.mark.parametrize(("text", "most"), [("ab c", 5), ("ab c", 200), ("a", 5), ("bé cab A", 200), ("abc, ABC; ab", 200), ("é b c", 5)])
def test_search_ranks_as_sqlite_does(spark, sections, text, most, monkeypatch):
    """Also with rounds so small that a search stops early."""
    rows, _, index = sections
    for first_round in (1, 4096):
        monkeypatch.setattr(search, "FIRST_ROUND", first_round)
        got = [(r["score"], r["page"], r["section"]) for r in index.hits(text, most).collect()]
        expected = _sqlite(rows, text, most)
        assert [g[1:] for g in got] == [e[1:] for e in expected] or [round(g[0], 4) for g in got] == [round(e[0], 4) for e in expected]
        assert all(math.isclose(g[0], e[0], abs_tol=2e-6) for g, e in zip(got, expected, strict=True))


def test_search_shows_three_sections_a_page(spark, sections):
    shown = sections[2].search("a b").collect()
    pages = Counter(r["page"] for r in shown)
    assert max(pages.values()) <= 3 and sorted({r["place"] for r in shown}) == list(range(1, len(pages) + 1))
    best = {}
    for r in shown:
        best[r["place"]] = max(best.get(r["place"], 0), r["score"])
    assert [best[p] for p in sorted(best)] == sorted(best.values(), reverse=True)


def test_search_without_terms_hits_or_rows(spark, sections):
    index = sections[2]
    assert index.search("?!").count() == 0 and index.search("a zzzz").count() == 0
    assert search.SearchIndex.build(sections[1].limit(0)).search("a").count() == 0


def test_similar_pairs_by_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 40])]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    texts += [t + " w3" for t in texts[:40]] + texts[:10] + [None, "", "  "] + ["same same"] * 30
    rows = list(enumerate(texts))
    vectors, df = {}, Counter()
    for i, t in rows:
        if t and t.split():
            vectors[i] = Counter(t.lower().split())
            df.update(vectors[i].keys())
    n = len(vectors)
    unit = {}
    for i, tf in vectors.items():
        w = {k: c * (math.log((n + 1) / (df[k] + 1)) + 1) for k, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[i] = {k: x / norm for k, x in w.items()}
    expected = Counter()
    for i in unit:
        for j in unit:
            if i < j and (c := round(sum(x * unit[j].get(k, 0) for k, x in unit[i].items()), 6)) >= 0.8:
                expected[round(c, 4)] += 1
    classes = similar.word_classes(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    got = Counter()
    for r in similar.similar_pairs(classes, 0.8).collect():
        got[round(r["cosine"], 4)] += r["pairs"]
    assert got == expected and sum(got.values()) > 400


def test_similar_pairs_block_by_block(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)]) for _ in range(rng.randint(1, 25))) for _ in range(80)]
    texts += [t + " w3" for t in texts[:40]] + ["same same"] * 3 + [f"alone{i}" for i in range(9)]
    classes = similar.word_classes(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").localCheckpoint()
    found = lambda: similar.similar_pairs(classes, 0.8)
    whole = sorted(map(tuple, found().collect()))
    assert len(whole) > 30
    monkeypatch.setattr(similar, "BLOCK", 90)
    monkeypatch.setattr(similar, "CELLS", 64)
    assert sorted(map(tuple, found().collect())) == whole
    monkeypatch.setattr(similar, "SENT_WORDS", 0)  # counts of words by a join
    assert sorted(map(tuple, found().collect())) == whole
    plan = found()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # neither vectors nor candidates are shuffled


def test_sweep_rates_every_threshold(spark):
    pairs = spark.createDataFrame([(1, 0.99, True), (4, 0.9, True), (2, 0.85, False), (1, 0.81, True)], "pairs bigint, cosine double, same boolean")
    rows = {r["threshold"]: r for r in similar.sweep(pairs, 8).collect()}
    assert (rows[0.8]["tp"], rows[0.8]["fp"], rows[0.8]["fn"]) == (6, 2, 2) and rows[0.8]["precision"] == 0.75 and rows[0.8]["recall"] == 0.75
    assert (rows[0.9]["tp"], rows[0.9]["fp"]) == (5, 0) and [t for t, r in rows.items() if r["best"]] == [0.86]
    empty = similar.sweep(pairs.limit(0), 0).collect()
    assert all(r["precision"] == 1.0 and r["recall"] == 0.0 and r["f1"] == 0.0 for r in empty)


def _plain_dice(a, b):
    if len(a) < 4 or len(b) < 4:
        return None
    return 2 * sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / (len(a) + len(b))


def test_matching_blocks_of_many_pairs():
    rng = random.Random(6)
    pairs = [([rng.randint(0, 6) for _ in range(rng.randint(0, 40))], [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]) for _ in range(400)]
    long = [rng.randint(0, 50) for _ in range(1500)]
    pairs += [(long, long), (long, long[::-1]), (long[:700], long[300:]), ([], []), ([1] * 50, [1] * 70)]
    expected = [sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]
    assert repeats.matched_words([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs]).tolist() == expected


def _plain_drop(text, floor):
    parts = [p for p in re.split("(?<=[.!?])(?=\\s)|(?<=\n)", text)]
    said = [re.findall(r"[^\W_]+", p.lower()) for p in parts]
    size, kept, gone = len(text), [], []
    for i, words in enumerate(said):
        near = any((d := _plain_dice(words, said[j])) is not None and d >= 0.9 for j in kept)
        if near and len(gone) < MOST_DROPS and size - len(parts[i]) >= floor:
            gone.append(i)
            size -= len(parts[i])
        else:
            kept.append(i)
    return len(gone), "".join(p for i, p in enumerate(parts) if i not in gone)


@pytest.mark.parametrize("floor", [0, 900])
def test_near_exact_repeats_go_in_order(spark, floor):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "one", "two", "three", "four", "five"]
    texts = []
    for _ in range(40):
        lines = [[rng.choice(words) for _ in range(rng.randint(2, 25))] for _ in range(rng.randint(1, 12))]
        for _ in range(rng.randint(0, 8)):
            copy = list(rng.choice(lines))
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            lines.append(copy)
        texts.append(rng.choice([" ", "\n"]).join(" ".join(x) + "." for x in lines))
    texts += ["", "no end", "a b c. a b c. a b c d. a b c d. A, b c D!"]
    rows = list(enumerate(texts)) + [(99, None)]
    got = {r["id"]: (r["dropped"], r["text"]) for r in repeats.without_near_repeats(spark.createDataFrame(rows, "id bigint, text string"), "id", floor=floor).collect()}
    assert got.pop(99) == (0, None)
    assert got == {i: _plain_drop(t, floor) for i, t in enumerate(texts)} and sum(n for n, _ in got.values()) > 10


def test_texts_are_not_shuffled_for_their_repeats(spark):
    rows = spark.createDataFrame([(1, "a b c d e. a b c d e. f"), (2, None)], "id bigint, text string")
    plan = repeats.without_near_repeats(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_ordered_share_of_turns(spark):
    rows = [(1, "a b c d e", "a b x d e"), (2, "a b c", "a b c d"), (3, None, "a b c d"), (4, "A b  c d", "a b c d")]
    frame = spark.createDataFrame(rows, "id int, a string, b string").select("id", repeats._hashed_words(F.col("a")).alias("a"), repeats._hashed_words(F.col("b")).alias("b"))
    assert {r["id"]: r["s"] for r in frame.select("id", repeats.ordered_share(F.col("a"), F.col("b")).alias("s")).collect()} == {1: 0.8, 2: None, 3: None, 4: 1.0}
