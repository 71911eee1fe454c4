import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.llm import leakage
from sondage.llm.words import located, words


def test_words():
    assert words("The <b>wo</b>rd, **bold** &amp; [link](http://x.y/z) com-\npound snake_case ｆｕｌｌ сafé don't") == [
        "the", "word", "bold", "link", "compound", "snake", "case", "full", "café", "don", "t"]
    assert words(None) == [] and words(" \n") == [] and words("a<br>b") == ["a", "b"] and words("left-handed") == ["left", "handed"]
    assert words("बाज़ार से") == ["बाज़ार", "से"]


def brute(docs, items, run, share):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            hit = set()
            for k in range(len(v) - run + 1):
                if any(w[j : j + run] == v[k : k + run] for j in range(len(w) - run + 1)):
                    hit.update(range(k, k + run))
            if v and hit and len(hit) >= share * len(v):
                out.add((d, i, len(hit), len(v)))
    return out


def test_both_ways_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta".split())
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 14)))) for i in range(25)] + [(98, ""), (99, None)]
    docs = []
    for d in range(60):
        t = [word() for _ in range(rng.randint(0, 25))]
        src = items[rng.randrange(25)][1].split()
        a = rng.randint(0, len(src))
        t[len(t) // 2 : len(t) // 2] = src[a : a + rng.randint(0, 14)]
        docs.append((d, rng.choice([" ", "\n", " <b></b>", "  *"]).join(t).upper() if rng.random() < 0.5 else " ".join(t)))
    docs += [(1000, None), (1001, ""), (1002, "alpha " * 300_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "gram": F.lit(2)})
    it = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(3))
    want = brute(docs[:-1], items, 5, 0.5)
    for bound in (10**6, 0):
        got = {tuple(r) for r in leakage.leaks(df.filter("doc_id < 1002"), it, broadcast_grams=bound).select("doc_id", "item_id", "matched", "item_words").collect()}
        assert got == want and want
    assert leakage.leaks(df.filter("doc_id = 1002"), it).count() == len([1 for _, x in items if x and words(x).count("alpha") * 2 >= len(words(x)) and "alpha alpha alpha alpha alpha" in x])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")
    for bound in (10**6, 0):
        assert leakage.leaks(docs.limit(0), items, broadcast_grams=bound).count() == 0
        assert leakage.leaks(docs, items.limit(0), broadcast_grams=bound).count() == 0
        assert leakage.leaks(docs, items, broadcast_grams=bound).count() == 1
    assert leakage.without_leaks(docs, leakage.leaks(docs, items)).count() == 0


def test_layout_and_script_make_no_difference():
    item = "Мама мыла раму а оса ела сахар у норы кота"
    g = leakage.grams([(1, item)])
    for sep in (" ", "\n", "\n\n", " \r\n", " <br> "):
        assert leakage.matched_words(g, "An English text about " + item.replace(" ", sep) + " and more.") == {1: 10}, sep
    assert leakage.matched_words(g, item.upper().replace("\n", " ")) == {1: 10}
    assert leakage.matched_words(g, item.replace("о", "o").replace("а", "a")) == {1: 10}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab С&;<>/*_~`-\n[]()#x2é́бｂ­​", max_size=40))
def test_located_words_are_the_words(text):
    own, places = located(text)
    assert own == words(text) and all(0 <= a < b <= len(text) for a, b in places) and places == sorted(places)


def test_spans_are_cut_out(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven"), (3, None)], "item_id bigint, text string")
    docs = [(1, "Keep <b>this</b>. One, *two* thr&#101;e\nfour-five six! And this, seven eight nine."), (2, None), (3, ""), (4, "x one two three four y"), (5, "Ｓeven eight\n> nine ten eleven, one two three four five")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("removed", F.lit("x"))
    for bound in (10**6, 0):
        got = {r.doc_id: (r.text, r.removed) for r in leakage.without_spans(df, items, broadcast_grams=bound).collect()}
        assert got == {1: ("Keep <b>this</b>. ! And this, seven eight nine.", 35), 2: (None, 0), 3: ("", 0), 4: (docs[3][1], 0), 5: ("", 54)}, bound
        assert leakage.without_spans(df.limit(0), items, broadcast_grams=bound).count() == 0


def test_spans():
    g = leakage.grams([(1, "one two three four five six")])
    assert leakage.spans(g, "x one two three four five six y") == [(1, 7)] and leakage.spans(g, "nothing here") == []
