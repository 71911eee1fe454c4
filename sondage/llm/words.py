"""Words of a text as a reader sees them: stretches of letters and digits without case, markup and layout.

A word is compared by its skeleton, which depends on its own letters alone, so neither the layout nor the text around
a word changes what it equals.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np

from sondage.llm.lookalike import FORMS, skeleton

# Elements that stand inside a line, so their tags may split a word.
INLINE = "a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split()
_INLINE_TAG = re.compile(rf"</?(?:{'|'.join(INLINE)})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[a-z!/][^<>]*>", re.I)
_LINK = re.compile(r"\]\([^()\s]*\)")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
_EMPHASIS = re.compile(r"(?<=\w)(?:\*{1,3}|~~|`)(?=\w)|(?<![^\W_])_{1,3}|_{1,3}(?![^\W_])")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])[-‐­]\r?\n[ \t]*(?=[a-zà-öø-ÿ])")
_WORD = re.compile(r"[^\W_]+(?:[\u0300-\u036f\u0900-\u0903\u093a-\u094f]+[^\W_]*)*")
_OTHER = re.compile(r"[^\x00-\x7f]")

#: What is done to a text, in order: where it applies, what is found, and what takes its place.
STEPS = (
    ("<", _INLINE_TAG, lambda m: ""),
    ("<", _TAG, lambda m: " "),
    ("](", _LINK, lambda m: "]"),
    ("&", _ENTITY, lambda m: html.unescape(m[0])),
    (None, _OTHER, lambda m: FORMS[ord(m[0])]),
    ("\n", _HYPHENATED, lambda m: ""),
    ("*_~`", _EMPHASIS, lambda m: ""),
)


def _applies(sign: str | None, text: str) -> bool:
    return not text.isascii() if sign is None else any(x in text for x in sign) if len(sign) > 2 else sign in text


@lru_cache(maxsize=200_000)
def _folded(word: str) -> str:
    return skeleton(word)


def plain(text: str) -> str:
    """A text without tags, link targets, emphasis and hidden characters."""
    for sign, pattern, shown in STEPS:
        if _applies(sign, text):
            text = text.translate(FORMS) if pattern is _OTHER else pattern.sub(shown, text)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null."""
    if not text:
        return []
    text = plain(text)
    return _WORD.findall(text.lower()) if text.isascii() else [_folded(w) for w in _WORD.findall(text)]


def located(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """:func:`words` of a text, and where each stands in it: first character, and the one after its last.

    The same steps, with the place of each character carried along.
    """
    text = text or ""
    at = np.arange(len(text) + 1)

    def put(pattern: re.Pattern, shown) -> None:  # noqa: ANN001
        nonlocal text, at
        out, places, end = [], [], 0
        for m in pattern.finditer(text):
            new = shown(m)
            out += [text[end : m.start()], new]
            places += [at[end : m.start()], np.full(len(new), at[m.start()])]
            end = m.end()
        text, at = "".join([*out, text[end:]]), np.concatenate([*places, at[end:]])

    for sign, pattern, shown in STEPS:
        if _applies(sign, text):
            put(pattern, shown)
    if not text.isascii():  # a base with its marks, composed
        put(re.compile(r"[^\x00-\x7f]+|[A-Za-z][^\x00-\x7f]+"), lambda m: unicodedata.normalize("NFC", m[0]))
    found = list(_WORD.finditer(text))
    ends = np.append(at[1:], at[-1:])
    return [_folded(m[0]) for m in found], [(int(at[m.start()]), max(int(at[m.end() - 1]) + 1, int(ends[m.end() - 1]))) for m in found]
