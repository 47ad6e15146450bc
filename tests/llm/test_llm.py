"""The corpus operators against brute force, on fixtures with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, language_id, near_dedup, pieces, quality, sharding, suffixes, token_counts, url_filter
from tidemark.llm.queries import URL_RULES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, kept boolean, row string, id bigint, hash string"


def fixture_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab cdé#ñ")[:1] for _ in range(rng.randint(1, 5))).replace(" ", "x")
    long = [word() for _ in range(400)]
    texts = [" ".join(long), " ".join([*long[:200], "Changed", *long[201:]]), " ".join(long[:350]), " ".join(long[:30] * 8), None, "", " \n", "one two", "One  TWO", "x" * 500, "x" * 700]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(25)]
    texts += ["\n".join(" ".join(long[i : i + 40]) for i in (0, 40, 0)), " ".join(long[100:160]) + " tail", " ".join(long)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, " ".join(long[:100])), (None, None), (3, "another text under an id that is taken")]
    return [(i, t, True, "r", 7, "h") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(rows):
    return sorted(map(repr, rows))


def test_quality_counts(docs, none):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, inside = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                inside.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)

    made = quality.quality_scores(docs)
    got = _sorted((r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in made.collect())
    assert got == _sorted((r[0], *brute(r[1])) for r in fixture_rows())
    assert made.filter("base_failed AND kept").count() == 0
    assert quality.quality_scores(none).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns


def test_quality_kept_by_a_plain_expectation_maximisation(docs):
    """Votes read from the statistics in Python, the model fitted document by document."""
    names = ["doc_id", *quality.STATS]
    rows = [tuple(r) for r in quality.with_statistics(docs.select("doc_id", "text")).select("row.doc_id", *quality.STATS).collect()]

    def votes(x):
        w, lines, letters = max(1, x["n_words"]), max(1, x["n_lines"]), max(1, x["n_letters"])
        length, variety = x["word_chars"] / w, math.log(max(1, x["n_distinct"])) / math.log(max(2, w))
        upper, dup = x["n_upper"] / letters, x["n_dup_lines"] / lines
        pairs = [
            (x["n_words"] >= 50, x["n_words"] < 20), (3.5 <= length <= 6.5, not 2 <= length <= 9), (x["n_symbols"] / w < 0.01, x["n_symbols"] / w >= 0.1),
            (x["n_bare"] / w < 0.02, x["n_bare"] / w >= 0.15), (x["n_repeat_words"] / w < 0.05, x["n_repeat_words"] / w >= 0.25), (variety >= 0.8, variety < 0.7),
            (dup < 0.05, dup >= 0.5), (upper < 0.2, upper >= 0.6), (x["n_shouts"] / w < 0.05, x["n_shouts"] / w >= 0.3),
            (x["n_stop"] / w >= 0.05, x["n_stop"] / w < 0.01 and 2 * x["n_letters"] >= x["word_chars"]),
        ]
        return [0 if bad else 2 if good else 1 for good, bad in pairs]

    found = [(x, votes(x), x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]) for x in (dict(zip(names, r, strict=True)) for r in rows)]
    counted = [v for _, v, failed in found if not failed]
    start = [[0.30, 0.30, 0.40], [0.01, 0.29, 0.70]]
    rates, prior, total = [[list(start[c]) for _ in range(10)] for c in (0, 1)], 0.8, len(counted)
    for _ in range(50):
        weight = []
        for v in counted:
            odds = [p * math.prod(rates[c][j][v[j]] for j in range(10)) for c, p in ((0, 1 - prior), (1, prior))]
            weight.append(odds[1] / (odds[0] + odds[1]))
        for c in (0, 1):
            own = [w if c else 1 - w for w in weight]
            for j in range(10):
                seen = [sum(o for o, v in zip(own, counted, strict=True) if v[j] == k) for k in range(3)]
                rates[c][j] = [(seen[k] + 0.02 * total * start[c][k]) / (sum(own) + 0.02 * total) for k in range(3)]
        prior = (sum(weight) + 1) / (total + 2)
    likely = {tuple(v): w for v, w in zip(counted, weight, strict=True)}
    expected = [(x["doc_id"], x["n_words"], failed, not failed and likely[tuple(v)] >= 0.5) for x, v, failed in found]
    assert any(e[3] for e in expected) and not all(e[3] for e in expected)
    assert _sorted(tuple(r) for r in quality.quality_scores(docs).select("doc_id", "n_words", "base_failed", "kept").collect()) == _sorted(expected)
    kept = Counter(e[0] for e in expected if e[3])
    assert Counter(r["doc_id"] for r in quality.quality_filter(docs).collect()) == kept


def test_quality_rules_judge_long_texts_alike():
    for times in (1, 100):
        text = " ".join(["one two three four five six seven eight nine ten eleven"] * 20 * times)
        x = quality.statistics(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert np.log(x["n_distinct"][0]) / np.log(x["n_words"][0]) < 0.7


def test_hot_words_are_the_most_frequent_that_fit(spark):
    table = spark.createDataFrame([(f"w{i}", max(1, 5000 // (i + 1)), 1) for i in range(400)], "word string, n bigint, pieces bigint")
    count = {f"w{i}": max(1, 5000 // (i + 1)) for i in range(400)}
    for hot in (0, 1, 7, 100, 399, 400, 1000):
        got = {r["word"] for r in token_counts.hot_words(table, hot).collect()}
        assert len(got) <= hot
        rest = [n for w, n in count.items() if w not in got]
        assert not got or not rest or min(count[w] for w in got) > max(rest)
        assert len(got) >= min(hot, 400) - max(Counter(count.values()).values())


def test_quality_model_rejects_what_rules_reject():
    n = len(quality.rules())
    good, bad = sum(2 * 3**i for i in range(n)), sum(1 * 3**i for i in range(n) if i not in (2, 3, 8))
    post = quality.fitted([(good, 900), (bad, 100)], n)["posterior"]
    assert post[good] > 0.9 and post[bad] < 0.1
    assert quality.fitted([], n)["posterior"] == {}


def test_decontamination(spark, docs, none):
    long = fixture_rows()[0][1].split()
    items = spark.createDataFrame([(1, " ".join(long[100:140])), (2, "one two"), (3, None), (4, "..."), (None, "nothing like it at all"), (2, "one two")], "item_id bigint, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in [(r["item_id"], r["text"]) for r in items.collect()]:
        w = words(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1) if k else []:
            windows.setdefault(tuple(w[j : j + k]), set()).add("" if i is None else str(i))

    def brute(t):
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if found := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    ids |= found
        return len(w), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)

    made = decontaminate.contamination(docs, items).select("row.doc_id", "n_words", "n_hit", "items_sha256", "contaminated")
    expected = _sorted((r[0], *brute(r[1])) for r in fixture_rows())
    assert _sorted(tuple(r) for r in made.collect()) == expected
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    before, decontaminate.KNOWN_SHINGLES = decontaminate.KNOWN_SHINGLES, 3  # all shingles go to the join
    try:
        again = decontaminate.contamination(docs, items).select("row.doc_id", "n_words", "n_hit", "items_sha256", "contaminated")
        assert _sorted(tuple(r) for r in again.collect()) == expected
        left = decontaminate.decontaminated(docs, items)
        assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(r[0] for r in fixture_rows() if not brute(r[1])[3])
    finally:
        decontaminate.KNOWN_SHINGLES = before


def suffix_brute(rows):
    """Rows of repeat_report by plain sets, for (doc_id, text)."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, b in rows:
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            least[k] = min(least.get(k, float("inf")), order(i))

    def brute(i, b):
        gone, own = bytearray(len(b)), set()
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if least[k] < order(i) or k in own:
                gone[s : s + 100] = b"\1" * 100
            own.add(k)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        return i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()

    return _sorted(brute(i, b) for i, b in rows)


def test_suffix_dedup(docs, none):
    expected = suffix_brute([(i, t) for i, t, *_ in fixture_rows()])
    assert _sorted(tuple(r) for r in suffixes.repeat_report(docs).collect()) == expected
    assert suffixes.repeat_report(none).count() == 0
    short = suffixes.without_repeats(docs)
    assert short.columns == docs.columns and short.count() == docs.count()


def test_suffix_dedup_deals_heavy_partitions_anew(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "PLACES_PER_MERGE", 4)
    monkeypatch.setattr(suffixes, "SPLIT", 1)
    monkeypatch.setattr(suffixes, "RUN_WINDOWS", 300)
    monkeypatch.setattr(suffixes, "TASK_PLACES", 20)
    expected = suffix_brute([(i, t) for i, t, *_ in fixture_rows()])
    assert _sorted(tuple(r) for r in suffixes.repeat_report(docs).collect()) == expected


def test_suffix_dedup_of_a_common_line_with_other_text_around(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    line = "this line of fifty to ninety bytes is in each document of the corpus"
    rows = [(i, " ".join([*(word() for _ in range(20)), line, *(word() for _ in range(20))])) for i in range(60)]
    rows += [(100 + i, rows[i][1][: 150 + 3 * i]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert _sorted(tuple(r) for r in suffixes.repeat_report(docs).collect()) == suffix_brute(rows)


@pytest.mark.parametrize("anew", [False, True])
def test_suffix_windows_are_compared_by_bytes(monkeypatch, anew):
    """Runs, blocks and merge in this process, with hashes so weak that most unequal windows share one."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(6)]
    texts += [texts[0][:200] + texts[1][50:250], texts[2][100:] + texts[2][100:], texts[0], "".join(rng.choice("ab") for _ in range(40)) + texts[3][:140]]
    right = suffixes.rolling_at
    monkeypatch.setattr(suffixes, "rolling_at", lambda *a: right(*a) & np.uint64(7))
    monkeypatch.setattr(suffixes, "MERGE_ENTRIES", 10)
    monkeypatch.setattr(suffixes, "MERGE_WINDOWS", 150)
    blocks = []
    for first in range(0, len(texts), 3):
        run = suffixes.Run(100, 32)
        data = [t.encode() for t in texts[first : first + 3]]
        at = np.append(0, np.cumsum([len(d) for d in data]))
        flat = np.frombuffer(b"".join(data), np.uint8)
        start, row, owner, hashes = suffixes.minimisers(flat, at)
        ids = np.arange(first, first + len(data))
        run.add(flat, ids, ids + 50, row, start, owner, start - at[row], suffixes.rolling_at(flat, 100, start), hashes[owner] % np.uint64(3))
        blocks += run.blocks()
    if anew:
        blocks = [y for part, block in blocks for y in suffixes.dealt_anew(block, part, 5, 100)]
    gone = set()
    for part in {p for p, _ in blocks}:
        for z in suffixes.merged([b for p, b in blocks if p == part], 100, 32):
            for rk, a, b in np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.int64).reshape(-1, 3).tolist():
                gone |= {(rk - 50, x) for x in range(a, b)}
    first_of = {}
    expected = set()
    for i, t in enumerate(texts):
        for s in range(len(t) - 99):
            if first_of.setdefault(t[s : s + 100], (i, s)) != (i, s):
                expected.add((i, s))
    assert gone == expected


def test_suffix_dedup_of_a_text_longer_than_a_step(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(450_000))
    assert len(long) > 2 << 20
    rows = [(1, long), (2, long[1_048_500:1_048_900] + " end"), (3, "start " + long[-300:] + long[:200]), (0, long[5000:5200])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.repeat_report(docs).collect()}
    assert found == {0: (0, 0), 1: (200, 1), 2: (400, 1), 3: (500, 1)}


def test_loser_tree_merges_in_order():
    rng = random.Random(2)
    runs = []
    for _ in range(5):
        s = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode() for _ in range(rng.randint(0, 9)))
        runs.append((s, [0, *(len(os.path.commonprefix([x, y])) for x, y in zip(s, s[1:], strict=False))][: len(s)]))
    tree = suffixes.Merge(runs)
    out = [(tree.runs[r][0][i], shared) for r, i, shared in tree]
    flat = [s for s, _ in out]
    assert flat == sorted(x for s, _ in runs for x in s)
    assert [shared for _, shared in out[1:]] == [len(os.path.commonprefix([x, y])) for x, y in zip(flat, flat[1:], strict=False)]


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, none, shingle, percent):
    sets = []
    for i, t, *_ in fixture_rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set()))
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    expected = _sorted((i, len(a), least.get(root(x)), i == least.get(root(x))) for x, (i, a) in enumerate(sets))
    made = near_dedup.grouped(docs, shingle=shingle, percent=percent).select("doc_id", "n_shingles", "component_id", "kept")
    assert _sorted(tuple(r) for r in made.collect()) == expected
    assert near_dedup.grouped(none).count() == 0


def test_one_of_each_keeps_one_row_of_a_group(docs):
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert left.filter("doc_id = 0").count() == 1


def test_sentencepiece_and_token_counts(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = fixture_rows()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {t: library.encode(t or "") for _, t, *_ in rows}
    made = pieces.digests(pieces.encoded(docs, MODEL)).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert _sorted(tuple(r) for r in made.collect()) == _sorted((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(library.decode(ids[t]))) for i, t, *_ in rows)
    for hot in (5, token_counts.HOT):
        counted = token_counts.token_counts(docs, MODEL, hot=hot)
        assert _sorted(tuple(r) for r in counted.collect()) == _sorted((i, len((t or "").encode()), len(ids[t])) for i, t, *_ in rows)
    assert pieces.encoded(none, MODEL).count() == 0 and token_counts.token_counts(none, MODEL).count() == 0


def test_encoding_of_odd_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.model(MODEL)
    rng = random.Random(1)
    letters = list("abcdefgh ABC 0123.,;<>/\\\n\t  ") + list("éßö▁日本ги́ﬁ🙂\u3000\x00")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [" " * 40 + "x", "x" + " " * 37, "a" * 3000]
    import numpy as np

    for t in texts:
        got = np.frombuffer(own.encode(t), np.int32).tolist()
        assert got == library.encode(t)
        assert own.decode(got) == library.decode(got)


def test_a_pair_of_tokens_is_tried_once(monkeypatch):
    """What words cost grows with the pairs not met before; spaces, line feeds and forgetting change no ids."""
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(MODEL)
    rng, asked, tried = random.Random(2), [], pieces.PieceModel.stands
    monkeypatch.setattr(pieces.PieceModel, "stands", lambda self, a, b: asked.append((a, b)) or tried(self, a, b))
    ids = lambda t: np.frombuffer(own.encode(t), np.int32).tolist()
    texts = [" ".join("".join(rng.choice(["en", "er", "tion", "ou", "sh", "é"]) for _ in range(rng.randint(2, 6))) for _ in range(40)) for _ in range(20)]
    assert [ids(t) for t in texts] == [library.encode(t) for t in texts]
    assert asked and len(asked) == len(set(asked))
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 5)
    for _ in range(3000):
        t = "".join(rng.choice([" ", "  ", "\n", "\n\n", "▁", "\t", "the", "ing", "é", "日", "\x00"]) for _ in range(rng.randint(0, 12)))
        assert ids(t) == library.encode(t) and own.decode(ids(t)) == library.decode(ids(t))


def test_sharding(docs, none):
    made = sharding.placed(docs, shards=4).collect()
    rows = fixture_rows()
    assert _sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in made) == _sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for shard in {r["shard"] for r in made}:
        own = sorted(r["slot"] for r in made if r["shard"] == shard)
        assert own == list(range(len(own)))
    of = {}
    for r in made:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for k, s in of.items() if k[1] > 8)
    assert sharding.placed(none).count() == 0


def test_sharding_against_a_plain_packer(spark):
    """Groups of equal texts, many of one size: the sizes that each shard gets are those of a list-based best fit."""
    rng = random.Random(12)
    texts = ["x" * rng.choice([3, 3, 3, 10, 10, 25, 60, 61, 200]) + str(rng.randint(0, 40)) for _ in range(400)] + [None] * 5 + [""] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    rows = sharding.placed(docs, 5).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = lambda t: len((t or "").encode()) + 8
    groups = Counter(texts)
    sizes = Counter(size(t) * n for t, n in groups.items())
    shard_of = {texts[r["doc_id"]]: set() for r in rows}
    for r in rows:
        shard_of[texts[r["doc_id"]]].add(r["shard"])
        assert r["size"] == size(texts[r["doc_id"]]) and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
    assert all(len(s) == 1 for s in shard_of.values())
    got = Counter((size(t) * n, next(iter(shard_of[t]))) for t, n in groups.items())

    total = sum(s * n for s, n in sizes.items())
    slack = 0
    while True:
        room, put = [-(-total // 5) + slack] * 5, Counter()
        for s in sorted(sizes.elements(), reverse=True):
            fits = [(room[i], i) for i in range(5) if room[i] >= s]
            if not fits:
                break
            _, i = min(fits)
            room[i] -= s
            put[s, i] += 1
        else:
            break
        slack = max(16, 2 * slack)
    assert got == put
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(sizes) and len(load) == 5
    for shard in load:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_operators_take_columns_of_clashing_names_and_repeated_rows(spark):
    """Columns named as the operators' own, ties, repeated rows and a long text: nothing is lost or mixed up."""
    names = ["row", "rk", "id", "text", "node", "kept", "pattern", "label", "word", "key", "hash", "shard", "met", "page", "host", "subtree", "site"]
    long = " ".join(f"word{i % 977} and{i}" for i in range(180_000))
    assert len(long) > 2 << 20
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, long, "en"), (3, None, None), (None, "", "de"), (4, "der hund und die katze", "de")]
    docs = spark.createDataFrame([(i, lang, t, *[f"{n}{i}" for n in names if n != "text"]) for i, t, lang in rows], "doc_id bigint, lang string, text string, " + ", ".join(f"{n} string" for n in names if n != "text"))
    n_words = sorted(len((t or "").split()) for _, t, _ in rows)
    assert sorted(r["n_words"] for r in quality.quality_scores(docs).collect()) == n_words
    assert quality.quality_filter(docs).columns == docs.columns
    items = spark.createDataFrame([(7, "cat and the dog")], "item_id bigint, text string")
    hit = decontaminate.contamination(docs, items).collect()
    assert sorted(r["n_words"] for r in hit) == n_words and sorted(r["n_hit"] for r in hit) == [0, 0, 0, 0, 4, 4]
    assert all(r["row"]["page"] == f"page{r['row']['doc_id']}" for r in hit)
    assert decontaminate.decontaminated(docs, items).columns == docs.columns
    model = language_id.fitted(docs, F.lit(True))
    said = language_id.predicted(docs, model).collect()
    assert Counter(r["lang_pred"] for r in said) == {"en": 3, "de": 1, "und": 2} and all(r["row"]["host"] == f"host{r['row']['doc_id']}" for r in said)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    made = pieces.encoded(docs, MODEL).collect()
    assert Counter((r["row"]["doc_id"], len(r["ids"])) for r in made) == Counter((i, len(library.encode(t or ""))) for i, t, _ in rows)
    counts = token_counts.token_counts(docs, MODEL).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counts) == Counter((i, len(library.encode(t or ""))) for i, t, _ in rows)
    one = near_dedup.one_of_each(docs)
    assert one.columns == docs.columns and Counter(r["doc_id"] for r in one.collect()) == {1: 1, 2: 1, 3: 1, None: 1, 4: 1}
    short = suffixes.without_repeats(docs)
    assert short.columns == docs.columns and {r["text"] for r in short.collect()} == {t for _, t, _ in rows}
    assert sorted(r["size"] for r in sharding.placed(docs).collect()) == sorted(len((t or "").encode()) + 8 for _, t, _ in rows)


def test_best_fit_decreasing_takes_the_tightest_shard():
    rng = random.Random(4)
    sizes = sorted(((rng.randint(1, 60), rng.randint(1, 4)) for _ in range(40)), reverse=True)
    merged = sorted({s: sum(n for t, n in sizes if t == s) for s, _ in sizes}.items(), reverse=True)
    bins = []
    for size, n in merged:
        for _ in range(n):
            fits = [(c, b) for b, c in enumerate(bins) if c >= size]
            if fits:
                bins[min(fits)[1]] -= size
            else:
                bins.append(100 - size)
    cuts = sharding.best_fit_decreasing(merged, 100)
    left = Counter()
    for size, n, shard in cuts:
        left[shard] += size * n
    assert [100 - left[b] for b in range(len(bins))] == bins


def test_url_rules(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://a.org/x", "https://ORG", "http://example.org/es/1", "http://x.EXAMPLE.org/en/123?q", "http://notexample.org/es/", "http://b.com/fr/", "http://com/de/x#y", "http://c.com/en/", "a://b://c.org/x", "http://org./", "http://.org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3]])], "page_id int, url string, host string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    made = url_filter.judged(pages, URL_RULES).select("row.page_id", "host", "path", "rule", "verdict")
    assert _sorted(tuple(r) for r in made.collect()) == _sorted((i, *brute(u)) for i, u in enumerate([*urls, urls[3]]))
    assert url_filter.judged(pages.limit(0), URL_RULES).count() == 0
    expected = _sorted(tuple(r) for r in made.collect())
    table = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    for limit, value in (("LITERAL_WORDS", 0), ("FILTER_KEYS", 1)):  # filters as columns, then a join
        monkeypatch.setattr(url_filter, limit, value)
        assert _sorted(tuple(r) for r in url_filter.judged(pages, table).select("row.page_id", "host", "path", "rule", "verdict").collect()) == expected


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 50 = 0")
    cascade = url_filter.Cascade.build(listed, universe, listed.count(), 5000)
    assert len(cascade.levels) > 1
    assert universe.filter(cascade.holds(F.col("key"))).exceptAll(listed).count() == 0
    assert listed.filter(~cascade.holds(F.col("key"))).count() == 0


def test_language_id(spark):
    rows = [(i, ("the cat and that dog with " if i % 2 else "der hund und die katze mit ") * (1 + i % 4), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 !", "en"), (102, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fitted(docs, F.col("doc_id") % 4 != 2)
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score").collect()}
    assert all(said[i][0] == ("en" if i % 2 else "de") and 0 <= said[i][1] <= 1 for i in range(60))
    assert {said[i] for i in (100, 101, 102)} == {("und", 0.0)}
    empty = language_id.fitted(docs.limit(0), F.lit(True))
    assert {r[0] for r in language_id.predicted(docs, empty).select("lang_pred").collect()} == {"und"}


def test_language_id_against_plain_kernels(spark):
    """Kernels by sets, Nyström features and ridge regression by dense algebra, over all labelled rows as landmarks."""
    rng = random.Random(6)
    words = {"aa": ["la", "lala", "talo", "kala"], "bb": ["der", "hund", "katz", "und"], "cc": ["xo", "xylo", "ox", "yxo"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(rng.choice(sorted(words)) for _ in range(40))]
    rows += [rows[0], (50, "lala hund", None), (51, "x" * 3000, "cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fitted(docs, F.lit(True))
    got = {(r["text"], r["lang_pred"], r["score"]) for r in language_id.predicted(docs, model).select("row.text", "lang_pred", "score").collect()}

    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    labelled = [(grams(t), lang) for _, t, lang in rows if lang]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b, _ in labelled] for a, _ in labelled])
    value, vector = np.linalg.eigh(k)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    names = sorted(words)
    target = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in labelled])
    feature = k @ root
    weight = root @ np.linalg.solve(feature.T @ feature + language_id.RIDGE * len(labelled) * np.eye(root.shape[1]) / 100, feature.T @ target)
    vocabulary = set().union(*(g for g, _ in labelled))
    for text, name, score in got:
        g = grams(text)
        margin = np.array([len(g & b) / math.sqrt(len(b)) for b, _ in labelled]) @ weight / math.sqrt(max(1, len(g & vocabulary)))
        likely = np.exp(4 * (margin - margin.max()))
        assert name == names[int(margin.argmax())] and abs(score - likely.max() / likely.sum()) < 1e-3


def test_html_text(spark):
    nav = "<nav><a href=/>Home</a></nav><div>Shared box</div>"
    pages = [
        (1, "http://h.com/1", f"<html><head><title>t</title></head><body>{nav}<article><h1>A &amp; B</h1><p>x <b>y<br><p>z\n w</article><footer>f</footer></body>"),
        (2, "http://h.com/2", f"<body>{nav}<p>own two</p><script>var a='</p>'</script></body>"),
        (3, "http://h.com/3", f"<body>{nav}<p>own three<div class='ad-box'>buy</div><ul><li>one<li>two</ul></body>"),
        (4, None, None),
        (5, "x", ""),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(df).select("row.page_id", "text").collect()}
    assert got == {1: "A & B\nx y\nz w", 2: "own two", 3: "own three\none\ntwo", 4: "", 5: ""}
    assert html_text.extracted(df.limit(0)).count() == 0


def test_html_text_drops_what_recurs_beside_and_inside_main_containers(spark):
    cards = "<div class=cards><article>A <b>teaser</b></article></div>"
    body = lambda i: f"<body>{cards}<article><p>own {i} <b>word</b> here<br>next</p><div>Read our letter</div></article></body>"
    df = spark.createDataFrame([(i, f"http://h.com/{i}", body(i)) for i in range(4)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(df).select("row.page_id", "text").collect()}
    assert got == {i: f"own {i} word here next" for i in range(4)}


def test_html_text_keeps_paragraphs_and_copies_of_articles(spark):
    """A paragraph that many articles of a host share is text, and so is an article under several urls with other adverts."""
    page = lambda i, own: f"<body><p>advert {i}</p><article><h1>t{i if own else 0}</h1>{'<p>own ' + str(i) + '</p>' if own else ''}<p>Released to all</p><ul><li>yes</ul></article></body>"
    df = spark.createDataFrame([(i, f"http://h.com/{i}", page(i, i < 6)) for i in range(10)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extracted(df).select("row.page_id", "text").collect()}
    assert got == {i: f"t{i}\nown {i}\nReleased to all" if i < 6 else "t0\nReleased to all" for i in range(10)}


def test_html_text_against_a_plain_counter_of_boxes(spark):
    """Deep nesting, repeated rows, extra columns of clashing names; boxes counted by their source text."""
    rng = random.Random(3)
    boxes = [f"<div><p>box {i}</p><p>more {i}</p></div>" for i in range(6)]
    rows = []
    for i in range(30):
        used = [b for b in boxes if rng.random() < 0.3]
        rows.append((i, f"http://{'ab'[i % 2]}.com/{i}", f"<body><main><p>own {i}</p>{''.join(used)}<p>end</p></main></body>", used, "host", 5))
    rows += [rows[0], rows[1], (99, "http://a.com/deep", "<body><main>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</main></body>", [], "x", 1)]
    seen = Counter((u.split("/")[2], b) for _, u, _, used, *_ in {r[0]: r for r in rows}.values() for b in used)
    expected = []
    for i, u, _, used, *_ in rows:
        kept = "".join(f"\nbox {boxes.index(b)}\nmore {boxes.index(b)}" for b in used if seen[u.split("/")[2], b] < 3)
        expected.append((i, "deep" if i == 99 else f"own {i}{kept}\nend"))
    df = spark.createDataFrame([(i, u, h, t, n) for i, u, h, _, t, n in rows], "page_id int, url string, html string, text string, page int").repartition(5)
    assert _sorted(tuple(r) for r in html_text.extracted(df).select("row.page_id", F.col("text")).collect()) == _sorted(expected)


def test_html_text_counts_versions_and_copies_of_a_page_once(spark):
    shared = "<div>Shared box</div>"
    rows = [(i, "http://h.com/again", f"<body>{shared}<p>crawled again</p></body>") for i in range(3)]
    rows += [(3 + i, f"http://h.com/copy{i}", f"<html><head><title>{i}</title></head><body>{shared}<div><p>one body</p></div></body></html>") for i in range(4)]
    rows += [(7 + i, "http://h.com/changed", f"<body>{shared}<p>stays the same</p><p>version {i}</p></body>") for i in range(4)]
    rows += [(11 + i, None, f"<body><p>no url</p><p>body {i}</p></body>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_text.extracted(df).select("row.page_id", "text").collect()}
    expected = dict.fromkeys(range(3), "crawled again") | dict.fromkeys(range(3, 7), "one body")
    assert got == expected | {7 + i: f"stays the same\nversion {i}" for i in range(4)} | {11 + i: f"body {i}" for i in range(3)}


def test_html_text_judges_a_template_alike_on_small_and_large_hosts(spark):
    menu = "<div>Section menu</div>"
    rows = [(f"http://{host}/{i}", f"<body>{menu if i < 4 else ''}<p>own {i}</p></body>") for host, n in (("small.com", 6), ("large.com", 400)) for i in range(n)]
    got = html_text.extracted(spark.createDataFrame(rows, "url string, html string")).select("row.url", "text").collect()
    assert {r["url"]: r["text"] for r in got} == {u: "own " + u.rsplit("/", 1)[1] for u, _ in rows}


def test_language_id_trains_on_every_label(spark):
    rows = [(i, f"text {i}", f"l{i % 1200:04d}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    picked = language_id.training_rows(docs, F.lit(True), "doc_id", "text", "lang", 300)
    assert picked.select("label").distinct().count() == 1200 and picked.count() == 3000
