"""Names, edits and the words of prices and places on written examples and against plain Python."""

import difflib
import random
import string

from pyspark.sql import functions as F

from tidemark.functions import domain as D
from tidemark.operators import edits, names


def _column(spark, texts, made):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", made(F.col("t")).alias("m"))
    return [r["m"] for r in rows.orderBy("id").collect()]


def test_names_are_told_from_openers(spark):
    texts = {
        "We met Anna in Paris. Discover more": "We met [NAME] in [NAME]. Discover more",
        "Kyoto is old. I love Kyoto": "[NAME] is old. I love [NAME]",
        "with Bank of America and Bay of the\nBengal, Rio de Janeiro": "with [NAME] and [NAME] of the\nBengal, [NAME]",
        "He said: Come\nHome “Now (Then": "He said: Come\nHome “Now (Then",
        "Day 1 with Dr Who": "Day 1 with Dr [NAME]",
        "[N] Tours at [PRICE]": "[N] [NAME] at [PRICE]",
        "": "",
        None: None,
    }
    got = _column(spark, texts, names.names_masked)
    assert got == list(texts.values())
    assert _column(spark, [t for t in got if t], names.names_masked) == [t for t in got if t]  # masks stay


def test_edit_status(spark):
    rows = [("a b", "a b", ""), ("a b", "a 5 b", ""), ("a 5", "a 5 b", ""), ("a", "a 7", "in 7 days"), ("a", "always a", ""), ("a", "a with Anna", ""), ("a", "a with Anna", "Anna"), ("a", "  ", ""), ("a", None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, b string, a string, s string")
    figures = lambda *c: F.regexp_extract_all(F.concat_ws("\n", *c), F.lit("[0-9]+"), F.lit(0))
    made = frame.select("id", names.edit_status(F.col("b"), F.col("a"), F.col("s"), figures("a"), figures("b", "s")).alias("v"))
    assert [r["v"] for r in made.orderBy("id").collect()] == ["pass", "fail", "pass", "pass", "fail", "grey", "pass", "pass", "pass"]


def _plain_excerpt(a, b, context):
    kept = (set(), set())
    for kind, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind != "equal":
            kept[0].update(x for x in range(len(a)) if i - context <= x < j + context)
            kept[1].update(x for x in range(len(b)) if k - context <= x < n + context)
    out = []
    for words, places in zip((a, b), kept, strict=True):
        said, last = [], None
        for p in sorted(places):
            said.append(("… " if last is not None and p > last + 1 else "") + words[p])
            last = p
        out.append(" ".join(said))
    return tuple(out)


def test_excerpts_by_plain_opcodes(spark):
    rng = random.Random(3)
    pairs = [([], []), (list("abc"), []), ([], list("abc"))]
    for _ in range(60):
        a = [rng.choice(string.ascii_lowercase) for _ in range(rng.randint(0, 60))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice(string.ascii_lowercase))
        pairs.append((a, b))
    frame = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "id int, before string, after string")
    for context in (2, 8):
        got = {r["id"]: (r["before"], r["after"]) for r in edits.excerpts(frame, context=context).collect()}
        assert got == {i: _plain_excerpt(a, b, context) for i, (a, b) in enumerate(pairs)}


def test_excerpts_are_cut_at_words_and_masked(spark):
    frame = spark.createDataFrame([(1, None, "see Anna at 10:30 for $5 " + "word " * 200)], "id int, before string, after string")
    row = edits.excerpts(frame).first()
    assert row["before"] == "" and row["after"].startswith("see [NAME] at [TIME] for [PRICE] word") and row["after"].endswith("word …") and len(row["after"]) <= 402


def test_words_of_prices():
    says = lambda text: {k for k, v in D.price_words(text).items() if v}
    assert says("From $100") == {"from"} and says("  starting at 5 USD") == {"from"} and says("as low as 3") == {"from"} and says("trips from €5") == {"from"} and says("away from home") == set()
    assert says("5 USD per group") == {"group"} and says("9/vehicle") == {"group"} and says("the private group") == {"group"} and says("per groups") == set()
    assert says("5 p.p.") == says("5 pp") == says("5 each") == says("7 per traveler") == says("7/pax") == {"person"}
    assert says("2-4 pax") == says("2 to 4 people") == says("6+ guests") == says("group of 4 persons") == {"tiers"} and says("4 nights") == set()


def test_places_are_cleaned(spark):
    cases = {
        "Yali La Pass (4820 m)": "Yali La Pass", "Pass at about 4,040 m.": "Pass", "Camp (at approx. 1,200 ft ) here": "Camp here", "Lodge (or similar)": "Lodge", "Inn or similar": "Inn",
        "the small village of Gogina": "Gogina", "town of small things": "town of small things", "  A   B ;": "A B", "4040 masl": "", "Km5 village": "Km5 village", None: "",
    }
    assert _column(spark, cases, D.clean_place) == list(cases.values())


def test_clauses_that_ask_for_more(spark):
    rules = {
        "Do not mention Bali.": 0, "Mention Bali": 1, "avoid lists, and list prices": 1, "Never say cheap then describe it": 1, "Notes stay": 0, "Always  use maps; adding no more": 2,
        "add a map and do not add text": 1, "don't add, or include": 1, "": 0, "unless you tell": 0,
    }
    from tidemark.operators import lint

    assert _column(spark, rules, lambda c: F.size(lint.adding_clauses(c))) == list(rules.values())


def test_phrases_that_explain_edits(spark):
    from tidemark.operators import lint

    edits = spark.createDataFrame([(1, "a very nice place", "a place"), (2, "Very nice!", None), (3, "very nice", "nice and very"), (4, "the very nice", "very nice"), (5, "nicely", "x"), (6, None, "very nice"), (7, "call 5 men", "call")], "id int, before string, after string")
    phrases = spark.createDataFrame([("very nice", 2), ("nice", 1), ("[N] men", 2), ("very nice", 2)], "phrase string, size int")
    assert sorted(tuple(r) for r in lint.explained(phrases, edits, 1).collect()) == [("[N] men", 1), ("nice", 2), ("very nice", 3)]
    assert lint.explained(phrases, edits).count() == 2 and lint.explained(phrases.limit(0), edits).count() == 0


def test_peoples_and_faiths_name_no_place(spark):
    names = {"small riverside Lao village": "descriptive", "a Buddhist shrine": "descriptive", "Great Mosque": None, "the Dzong": None, "old Tày house": None, "in the Khmer": "descriptive", "Lao Cai": None, "": "annotation_only"}
    assert _column(spark, names, lambda c: D.not_a_place(c, F.lit(""))) == list(names.values())
    assert _column(spark, ["a Lao village"], lambda c: D.not_a_place(c, F.lit("Vientiane"))) == [None]
