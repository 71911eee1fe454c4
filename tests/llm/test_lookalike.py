import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.llm import lookalike as lk

SAME = [
    ("Ｗｅ meet at ８．", "We meet at 8."),
    ("bасk tо ѕсhool", "back to school"),  # Cyrillic letters inside Latin words
    ("Тһе оса", "The oca"),  # whole words
    ("café", "café"),
    ("са́fé", "cáfé"),
    ("a b c d", "a b c d"),
    ("ri‍ver­ ⁠x﻿", "river x"),
    ("ﬁle ⅼamp K", "file lamp K"),
    ("ẹ́", "ẹ́"),
    ("क़दम", "क़दम"),
    ("ɑnd ɡo", "and go"),
]
# Public look-alikes besides those of the tables above, in words of Latin letters.
SAME += [(x.split("=")[0], x.split("=")[1]) for x in "yөga=yөga ү=y Ү=Y Ӏ=I ϲat=cat Ϲat=Cat kıte=kite ꓐig=Big ꓓay=Day ꮪun=sun ꮯat=cat 5−3=5-3 ᴏᴡʟ=owʟ ᴄᴏᴢy=cozy ꓣun=Run ꓢꓴN=SUN ԛuiz=quiz ѵan=van Ⲥat=Cat ⲥat=cat ᏏᏏ=bb օpen=open զuiz=quiz".split()]
HONEST = [
    "ⲡⲛⲟⲩⲧⲉ ⲡⲉⲧⲟⲩⲁⲁⲃ ⲁⲩⲱ ⲛⲉϥⲁⲅⲅⲉⲗⲟⲥ", "ꓡꓲꓢꓴ ꓐꓯꓹ ꓠꓬꓲꓹ ꓫꓵꓽ ꓟꓳ ꓗꓪ", "Мама мыла раму, а оса жужжала", "Хотын гудамжинд үүр өглөөний нар мандав", "Ἐν ἀρχῇ ἦν ὁ λόγος", "Η Ελλάδα είναι μια χώρα", "Ամեն մարդ ծնվում է ազատ", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "Kız sınıfta sırayla şarkı söyledi",
    "בראשית ברא אלהים", "الناس سواسية", "人人生而自由", "सभी मनुष्य जन्म से स्वतंत्र हैं", "ମଣିଷ ଜନ୍ମରୁ ସ୍ୱାଧୀନ",
]
DIFFERENT = [("We", "we"), ("e", "é"), ("1", "l"), ("O", "0"), ("a.", "a!"), ("x²", "x2"), ("a b", "b a"), ("½", "1/2"), ("I", "l"), ("rn", "m"), ("Ⓐ", "A")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert lk.consistent(a) == lk.consistent(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert lk.consistent(a) != lk.consistent(b)


@pytest.mark.parametrize("text", HONEST)
def test_honest_text_stays(text):
    plain = unicodedata.normalize("NFC", text)
    assert lk.consistent(text) == plain.replace("ı", "i")  # a dotless i is the one letter that looks like another of its own script


def test_many_public_confusables():
    pairs = [(latin, other) for latin, members in lk.MEMBER.items() for other in members.values() if other != latin]
    pairs += [(latin, ch) for ch, latin in lk.CLASS.items() if ch != latin] + [(latin, ch) for ch, latin in lk.VARIANT.items()]
    fonts = [(latin, chr(c)) for c in (*range(0xFF21, 0xFF5B), *range(0x1D400, 0x1D6A4)) if len(latin := unicodedata.normalize("NFKC", chr(c))) == 1 and latin.isascii() and latin.isalpha() and unicodedata.category(chr(c))[0] == "L"]
    assert len(set(pairs + fonts)) > 600
    for latin, other in pairs + fonts:
        if latin.isalpha():
            assert lk.consistent(f"zz{other}qf") == f"zz{latin}qf", (latin, other)
        else:
            assert lk.consistent(other) == latin


def test_text_of_another_script_stays_in_it():
    russian = "Мама мыла раму, а оса жужжала"
    assert lk.consistent(russian) == russian
    assert lk.consistent(russian.replace("оса", "oca")) == russian


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz ABCEHKMOPTXéïабвгдежαβγοὐ1.", max_size=60), st.randoms())
def test_invariant_under_any_substitution_and_idempotent(text, rng):
    form = lk.consistent(text)
    swapped = "".join(rng.choice(list(lk.MEMBER[lk.CLASS[c]].values())) if c in lk.CLASS and rng.random() < 0.5 else c for c in unicodedata.normalize("NFD", text))
    assert lk.consistent(swapped) == form and lk.consistent(form) == form


def test_edges(spark):
    assert lk.consistent(None) is None and lk.consistent("") == "" and lk.consistent("​") == ""
    long = "сhаnge " * 200_000
    assert lk.consistent(long) == ("change " * 200_000).strip()
    assert (lk.confusable("bасk"), lk.confusable("оса"), lk.confusable("plain"), lk.confusable(None)) == ("mixed", "whole", "none", "none")
    df = spark.createDataFrame([("ａ", "old"), (None, "old")], "text string, consistent string")
    assert [r.consistent for r in lk.normalize(df, "text").collect()] == ["a", None]


def test_pairs_against_brute_force(spark):
    texts = ["one", "оne", "one", "ｏne", "two", "Two", None, "", "​", "two", "three", "thr​ee"] * 2
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {tuple(r) for r in lk.look_alikes(spark.createDataFrame(rows, "item_id bigint, text string").withColumn("form", F.lit(1)), "item_id", "text").collect()}
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a is not None and b is not None and a != b and lk.consistent(a) == lk.consistent(b)}
    assert got == want and want
    small = {tuple(r) for r in lk.look_alikes(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id", "text", slice_rows=1).collect()}
    assert small == want  # every key cut into slices
    assert lk.look_alikes(spark.createDataFrame([], "item_id bigint, text string"), "item_id", "text").count() == 0
    member = {r.row_id: (r.class_id, r.spelling_id) for r in lk.classes(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id", "text").collect()}
    assert {(i, j) for i in member for j in member if i < j and member[i][0] == member[j][0] and member[i][1] != member[j][1]} == want


def test_a_hot_text_is_paired_in_linear_time(spark):
    df = spark.range(200_000).select(F.col("id").alias("item_id"), F.when(F.col("id") == 7, F.lit("оne text")).otherwise("one text").alias("text"))
    pairs = lk.look_alikes(df, "item_id", "text")
    assert pairs.count() == 199_999 and pairs.filter("id_a = 7 OR id_b = 7").count() == 199_999


def test_skeletons_need_no_context():
    assert lk.skeleton("оса") == lk.skeleton("OCA") == "oca" and lk.skeleton("ВОДА") == lk.skeleton("вода") and lk.skeleton("ΝΕΟΣ") == lk.skeleton("νεοσ")
    assert lk.skeleton("жаба") != lk.skeleton("жабо") and lk.skeleton("résumé") != lk.skeleton("resume") and lk.skeleton("ſcаn") == lk.skeleton("ſcan")
