"""Visually identical text brought to one consistent form.

Method: each letter belongs to a class of letters that look alike, and a class to the scripts that have a member
of it. The scripts of a token's letters are intersected; a token whose own letters share no script is a
mixed-script confusable, one whose letters all have look-alikes elsewhere a whole-script confusable. Either is
spelt in a script of the intersection: the only one, else the script that the unambiguous tokens of the text
agree on, else the first in a fixed order. What remains is normalised by rule: invisible characters go,
spaces become one kind, full-width and other presentation forms become plain, accents are composed.

All choices depend on classes alone and never on which member of a class stands in the text, so any two spellings
that look the same get the same form. Letter case, accents, digits and punctuation stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.confusables import CLASS, FOLDED, MEMBER, VARIANT
from sondage.session import cut_lineage

#: Where the intersection leaves a choice that the text can't settle, the first of these.
ORDER = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")
#: Compatibility forms that look like what they decompose to. Others (superscripts, circles, fractions) don't.
ALIKE_FORMS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}

_JOINERS = "‌‍"
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*")


class _Forms(dict):
    """For str.translate: each character's plain form, worked out on first use."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch in VARIANT:
            out = VARIANT[ch]
        elif ch in CLASS:
            out = ch
        elif kind == "Zs":
            out = " "
        elif kind == "Cf" and ch not in _JOINERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            out = ""
        else:
            form, _, rest = unicodedata.decomposition(ch).partition(" ")
            if form == "<compat>" and rest.startswith("0020 ") or form not in ALIKE_FORMS:
                out = ch  # spacing accents look different from a space and an accent
            else:
                out = "".join(chr(int(x, 16)) for x in rest.split()).translate(self)
        self[code] = out
        return out


FORMS = _Forms()


@lru_cache(maxsize=None)
def script(ch: str) -> str | None:
    """The script of a letter, by the first word of its Unicode name; null for anything common to all scripts."""
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "").partition(" ")[0].capitalize()
    return None if name in ("", "Modifier", "Feminine", "Masculine") else name


@lru_cache(maxsize=200_000)
def resolved(token: str) -> frozenset[str]:
    """The scripts in which every letter of a decomposed token has a look-alike."""
    out: frozenset[str] | None = None
    for ch in token:
        own = frozenset(MEMBER[CLASS[ch]]) if ch in CLASS else (frozenset([s]) if (s := script(ch)) else None)
        if own is not None:
            out = own if out is None else out & own
    return out if out is not None else frozenset()


def _spelt(token: str, to: str | None) -> str:
    """The token in script ``to``; without one, each letter in the first script of its class. Letters of ``to`` itself stay."""
    out = []
    for ch in token:
        members = MEMBER.get(CLASS.get(ch, ""))
        if members is None or script(ch) == to:
            out.append(ch)
        else:
            out.append(members.get(to or "", "") or members["Latin"])
    return "".join(out)


def _keep_joiners(text: str) -> str:
    """Zero-width joiners shape text after an Indic virama only; elsewhere they don't show."""
    return re.sub("(?<![्্੍્୍்్್്])[‌‍]", "", text)


def consistent(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``. Null stays null; white space at the ends goes, runs of spaces are one."""
    if text is None:
        return None
    if not text.isascii():
        text = text.translate(FORMS)
        if not text.isascii():
            text = unicodedata.normalize("NFD", _keep_joiners(text))
            if not text.isascii():
                text = unicodedata.normalize("NFC", _one_script(text))
    return re.sub(" {2,}", " ", text).strip()


def _one_script(text: str) -> str:
    """Tokens of a decomposed text spelt in consistent scripts."""
    if {script(ch) for ch in set(text)} <= {None, "Latin"}:
        return text  # no letter of another script: Latin can spell every token
    tokens = _TOKEN.findall(text)
    seen: Counter[str] = Counter()
    for t in tokens:
        if len(r := resolved(t)) == 1:
            seen[next(iter(r))] += 1
    rank = sorted(ORDER, key=lambda s: (-seen[s], ORDER.index(s)))

    def spell(m: re.Match) -> str:
        token = m.group()
        r = resolved(token)
        return _spelt(token, next((s for s in rank if s in r), None))

    return _TOKEN.sub(spell, text)


def confusable(text: str | None) -> str:
    """What a text's tokens show: ``mixed`` (a token of several scripts), ``whole`` (all letters have look-alikes in another script), or ``none``."""
    kinds = set()
    plain = unicodedata.normalize("NFD", (text or "").translate(FORMS))
    for t in _TOKEN.findall(plain):
        own = {s for ch in t if (s := script(ch))}
        if len(own) > 1:
            kinds.add("mixed")
        elif own and own != {"Latin"} and "Latin" in resolved(t):
            kinds.add("whole")
    return "mixed" if "mixed" in kinds else "whole" if kinds else "none"


def normalize(df: DataFrame, column: str, into: str = "consistent") -> DataFrame:
    """Adds ``into``: the consistent form of ``column`` (an existing column of that name is replaced). Null gives null, empty gives empty."""

    @F.pandas_udf("string")
    def form(s):
        return s.map(consistent, na_action="ignore")

    return df.withColumn(into, form(F.col(column)))


def skeleton(token: str) -> str:
    """A token so that all that look like it, and its other letter cases, get the same; from its own letters alone.

    A token that Latin can spell is spelt so and put into small letters; any other is put into small letters in its
    own script, and then each of its letters becomes the one that it or its capital looks like.
    """
    if token.isascii():
        return token.lower()
    plain = unicodedata.normalize("NFD", token)
    if "Latin" in resolved(plain):
        plain = _spelt(plain, "Latin").casefold()
    else:
        plain = plain.casefold().translate(FOLDED)
    return unicodedata.normalize("NFC", plain)


#: Rows of one spelling, and spellings of one form, that a task takes at once.
SLICE = 10_000


def _spellings(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, spelling, form): digests of each text as it is written and in its one form; null texts have none."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([digest(t) for t in texts], pa.binary()), pa.array([digest(consistent(t)) for t in texts], pa.binary())],
                names=["row_id", "spelling", "form"],
            )

    rows = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(column).alias("t")).filter("t IS NOT NULL")
    return cut_lineage(rows.mapInArrow(forms, "row_id bigint, spelling binary, form binary"))  # read more than once


def classes(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, class_id, spelling_id, spellings): the rows whose texts have look-alikes of another spelling.

    class_id is the smallest row of the same form, spelling_id the smallest of exactly the same text; spellings is how many
    the class has. A row each, however many copies there are. Null texts are in no class.
    """
    rows = _spellings(df, row_id, column)
    # Copies are counted on the map side, so a text with very many of them sends a row per task.
    own = rows.groupBy("form", "spelling").agg(F.min("row_id").alias("spelling_id"))
    several = own.groupBy("form").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("spellings")).filter("spellings > 1")
    known = own.join(several, "form").select("spelling", "form", "class_id", "spelling_id", "spellings")
    return rows.join(known, ["spelling", "form"]).select("row_id", "class_id", "spelling_id", "spellings")


def look_alikes(df: DataFrame, row_id: str, column: str, slice_rows: int = SLICE) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows whose texts look the same but differ in a character.

    Different spellings of a form are paired first; copies of one text never meet each other. Only then do spellings find
    their rows. A spelling with many rows is cut into slices by row, and a form with many spellings into slices by spelling, so no
    key is one task. Null texts are in no pair.
    """
    c = F.col
    rows = _spellings(df, row_id, column)
    counts = rows.groupBy("form", "spelling").agg(F.count("*").alias("n"))
    several = counts.groupBy("form").agg(F.count("*").alias("m")).filter("m > 1")
    slices = lambda n: F.ceil(n / F.lit(slice_rows)).cast("int")
    kinds = cut_lineage(counts.join(several, "form"))  # a row for each spelling that has another one beside it
    left = kinds.select("form", c("spelling").alias("sa"), slices(c("n")).alias("na"), F.pmod(F.xxhash64("spelling"), slices(c("m"))).cast("int").alias("part"))
    right = kinds.select("form", c("spelling").alias("sb"), slices(c("n")).alias("nb"), F.explode(F.sequence(F.lit(0), slices(c("m")) - 1)).alias("part"))
    meet = left.join(right, ["form", "part"]).filter("sa < sb")
    meet = meet.withColumn("ka", F.explode(F.sequence(F.lit(0), c("na") - 1))).withColumn("kb", F.explode(F.sequence(F.lit(0), c("nb") - 1)))
    # Each row of a spelling lies in one of its slices.
    placed = rows.join(kinds.select("spelling", slices(c("n")).alias("k")), "spelling").select("spelling", "row_id", F.pmod(F.xxhash64("row_id"), c("k")).cast("int").alias("k"))
    a, b = placed.toDF("sa", "a", "ka"), placed.toDF("sb", "b", "kb")
    pairs = meet.join(a, ["sa", "ka"]).join(b, ["sb", "kb"])
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
