"""Keyword-stuffed and link-list pages.

Method: the suffixes of each page's words, ordered with the lengths they share, give what the states of the page's suffix
automaton hold: for every place the longest stretch that occurs again in the page. The characters under such repeated
maximal stretches are the page's coverage. The page is also cut into segments, and a segment without clause structure
counts as stuffing if repeats cover it, if links or tags make it up, or if it piles up many words that nothing
holds together. Rows of figures, headings and short lists are neither. A page is found if stuffing is more than half of it.

Clause structure is measured without any list of words, so in any language: by length, by an end mark and a beginning that
is not small, by different words, and by short words that the page itself uses again and again, as languages use
their particles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.lookalike import consistent

#: A page is found above this share of stuffing.
SHARE = 0.5
#: A stretch counts as repeated from so many words on.
STRETCH = 2
#: Above this share of repeats, words that stand outside of clauses are stuffing; above the second one, varied
#: words are asked of sentences too.
REPEATED, ROUND = 0.5, 0.8
#: Words of a clause: at least, and at most before its end must come. Words without any clause: a pile that nothing separates,
#: and one that is separated or repeated.
CLAUSE_LEAST, CLAUSE_MOST, PILE, LIST = 4, 60, 44, 12
#: A particle: a word of at most so many letters that makes up at least one in so many words of its page, and occurs twice.
PARTICLE, OFTEN = 4, 150
#: Share of particles in prose without punctuation, and in a sentence; share of different ones among the other words, and among all
#: words of a repeated sentence.
BOUND, LOOSE, VARIED, TURNING = 0.13, 0.1, 0.8, 0.7

# Scripts that put no spaces between words: each letter is taken for a word.
_SOLID = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
# Vowel signs and other marks belong to the words of Indic, Arabic and Hebrew script; the Indic full stop does not.
_WORD = re.compile(rf"[{_SOLID}]|(?:[^\W_{_SOLID}]|[̀-֑ͯ-ׇً-ٰٟ]|(?![।॥])[ऀ-෿])+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+", re.I)
_ANCHOR = re.compile(r"<a\s[^<>]*>.*?</a>|\[[^\[\]\n]*\]\([^()\s]*\)", re.I | re.S)
_MARKUP = re.compile(r"</?[a-z][^<>]*>", re.I)
_TAG = re.compile(r"#[^\W_][\w'’-]*")
_END = re.compile(r"[.!?…।॥؟۔።]+[\"'”’»)\]*_]*(?=$|\s|[,;}\]]|\\)|[。！？!?｡]+[」』”’）)]*(?=[^\x00-˿])")
_QUOTE = re.compile(r"^(?:\s*>)+\s?", re.M)
_DASH = re.compile(r"\s[/–—»-]\s")
_CUT = re.compile(
    r"\n(?=\s*\n)|\n(?=\s*(?:[#>»*•·–—|-]|\d+[.)]\s|<a\s|\[|https?:|www\.))|(?<=\|)[^\S\n]*\n|\n(?=[^\n]*\|)|\n(?=\s*[\"{}\[\]])"
)


class Page(NamedTuple):
    """Characters of a page by kind, and those that repeats cover."""

    chars: int
    covered: int
    clause: int
    stuffing: int


def longest(ids: np.ndarray) -> np.ndarray:
    """For each place of a row of numbers the length of the longest stretch starting there that also starts elsewhere.

    Suffixes are ordered by doubling; neighbours in that order share the most, and how much is read off the orders kept of
    each doubling.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    _, rank = np.unique(ids, return_inverse=True)
    orders, step = [rank], 1
    while rank.max() < n - 1 and step < n:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)
        orders.append(rank)
        step *= 2
    suffixes = np.argsort(rank, kind="stable")
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    shared = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(orders) - 1, -1, -1):
        size, order = 1 << k, orders[k]
        fits = np.maximum(a, b) + size <= n
        same = fits & (order[np.minimum(a, n - 1)] == order[np.minimum(b, n - 1)])
        shared[same] += size
        a[same] += size
        b[same] += size
    out = np.zeros(n, dtype=np.int64)
    out[suffixes[:-1]] = shared
    out[suffixes[1:]] = np.maximum(out[suffixes[1:]], shared)
    return out


def _under(lengths: np.ndarray, least: int) -> np.ndarray:
    """Where stretches of ``least`` or more lie, given how long each is from its start."""
    n = len(lengths)
    ends = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + lengths[at], -1)
    return np.cumsum(ends[:n]) > 0


def repeats_of(pages: Sequence[np.ndarray], least: int = STRETCH) -> list[np.ndarray]:
    """For each page, given as its words' numbers, which of its words stand in a stretch of ``least`` or more that it repeats.

    All pages are one row with a mark between them, and no number of one page is one of another. A stretch of two or
    more is made of pairs that occur again, so only words of such pairs are ordered, with a mark for each gap.
    """
    sizes = np.array([len(p) for p in pages], dtype=np.int64)
    if not sizes.sum():
        return [np.zeros(0, dtype=bool) for _ in pages]
    top = 1 + max(int(p.max()) for p in pages if len(p))
    page = np.repeat(np.arange(len(pages)), sizes)
    ids = np.concatenate(pages).astype(np.int64) + page * top
    n = len(ids)
    again = np.zeros(n, dtype=bool)
    if least < 2:
        kept = np.arange(n)
        gap = np.r_[False, page[1:] != page[:-1]]
    else:
        _, no, count = np.unique(ids[:-1] * np.int64(top * len(pages)) + ids[1:], return_inverse=True, return_counts=True) if top * len(pages) < 2**31 else np.unique(np.stack([ids[:-1], ids[1:]]), axis=1, return_inverse=True, return_counts=True)
        twice = (count[no] > 1) & (page[1:] == page[:-1])
        kept = np.flatnonzero(np.r_[twice, False] | np.r_[False, twice])
        gap = np.r_[True, ~((kept[1:] == kept[:-1] + 1) & twice[kept[1:] - 1])][: len(kept)]
    if len(kept):
        # A mark that occurs once stands before each gap.
        place = np.arange(len(kept)) + np.cumsum(gap)
        row = np.empty(len(kept) + int(gap.sum()), dtype=np.int64)
        row[:] = -1 - np.arange(len(row))
        row[place] = ids[kept]
        again[kept] = _under(longest(row), least)[place]
    return np.split(again, np.cumsum(sizes)[:-1])


def repeats(tokens: list[str], least: int = STRETCH) -> bytearray:
    """For each word of one page 1 if it stands in a stretch of ``least`` words or more that occurs again."""
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(t, len(numbers)) for t in tokens], dtype=np.int64)
    return bytearray(repeats_of([ids], least)[0].astype(np.uint8).tobytes())


def segments(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, ends like a sentence) of the pieces of a text: lines that start like rows, and sentences across soft line ends."""
    at, end = 0, len(text)
    find = _WORD.findall
    for stop in [*(m.end() for m in _CUT.finditer(text)), end]:
        if stop <= at:
            continue
        pos = at
        for m in _END.finditer(text, at, stop):
            line = text.rfind("\n", pos, m.start()) + 1
            if line > pos and not text[line : line + 1].islower() and text[line : line + 1].isalpha() and len(find(text, line, m.end())) >= CLAUSE_LEAST:
                yield pos, line, False  # a sentence that starts on a line of its own
                pos = line
            yield pos, m.end(), True
            pos = m.end()
        if not text[pos:stop].isspace() and pos < stop:
            yield pos, stop, False
        at = stop


def _shown(text: str) -> int:
    """The number of characters other than white space."""
    if text.isascii():
        return len(text) - sum(map(text.count, " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"))
    return sum(map(len, text.split()))


def _finder(text: str):  # noqa: ANN202
    """What finds the words of a text in small letters."""
    return (_PLAIN_WORD if text.isascii() else _WORD).findall


def _separators(text: str) -> int:
    """Commas, bars, bullets, spaced dashes and line ends; a line end after one of them counts with it."""
    n = sum(map(text.count, ",;|•·"))
    if "\n" in text:
        n += text.count("\n") - (sum(map(text.count, (",\n", ";\n", "|\n"))) if n else 0)
    return n + len(_DASH.findall(text)) if any(x in text for x in "/–—»-") else n


class _Read(NamedTuple):
    """A page's text without quote marks and entities, its segments with their words counted up, and the words with their numbers."""

    text: str
    parts: list[tuple[int, int, bool, int]]  # start, end, ends like a sentence, words up to its end
    words: list[str]
    types: list[str]
    ids: np.ndarray


def _read(text: str | None) -> _Read | None:
    if not text or text.isspace():
        return None
    if not text.isascii():
        text = "\n".join(line if line.isascii() else consistent(line) for line in text.split("\n"))
    if "&" in text:
        text = html.unescape(text)
    if ">" in text:
        text = _QUOTE.sub("", text)
    words: list[str] = []
    parts = []
    find = _finder(text)
    for a, b, ends in segments(text):  # no segment begins or ends within a word
        words += find(text[a:b].lower())
        parts.append((a, b, ends, len(words)))
    numbers: dict[str, int] = {}
    put = numbers.setdefault
    ids = np.array([put(w, len(numbers)) for w in words], dtype=np.int64)
    return _Read(text, parts, words, list(numbers), ids)


def _sums(x: np.ndarray) -> list[int]:
    """Sums up to each place, from 0."""
    out = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=out[1:])
    return out.tolist()


def _judge(r: _Read, again: np.ndarray) -> Page:
    """The measures of a page whose repeated words are known."""
    text, words = r.text, r.words
    find = _finder(text)
    n = len(words)
    count = np.bincount(r.ids, minlength=1)
    often = max(2, n // OFTEN)
    common = [w for w, m in zip(r.types, (count >= often).tolist()) if m]
    known = {w for w in common if len(w) <= PARTICLE and w.isalpha()}
    letters = np.array(list(map(len, words)), dtype=np.int64)
    sizes, unders = _sums(letters), _sums(letters * again)
    bounds = _sums(np.array([w in known for w in words], dtype=bool))
    clause = stuffing = k = 0
    loose: list[tuple[int, int, int, int]] = []  # neighbouring segments without clauses: words from, to, characters, separators

    def settle() -> int:
        """The characters of stuffing among the loose segments gathered so far."""
        if not loose:
            return 0
        own = sum(b - a for a, b, _, _ in loose)
        size = sum(sizes[b] - sizes[a] for a, b, _, _ in loose)
        under = sum(unders[b] - unders[a] for a, b, _, _ in loose)
        held = sum(bounds[b] - bounds[a] for a, b, _, _ in loose)
        chars, rows = sum(x[2] for x in loose), sum(x[3] for x in loose)
        loose.clear()
        if own < LIST:
            return 0
        if under > REPEATED * size or rows * 6 >= own:
            return chars
        return chars if own >= PILE and held < BOUND * own else 0

    for a, b, ends, upto in r.parts:
        first, k = k, upto
        if first == k:
            continue
        piece = text[a:b]
        chars = _shown(piece)
        if "#" in piece and sum(m.end() - m.start() for m in _TAG.finditer(piece)) * 2 > chars:
            stuffing += chars
            continue
        linked = "](" in piece or "<a" in piece or "<A" in piece
        bare = _MARKUP.sub(" ", _ANCHOR.sub(" ", piece)) if linked else piece
        rest = _LINK.sub(" ", bare) if "://" in bare or "www." in bare.lower() else bare
        own = find(rest.lower()) if rest is not piece else words[first:k]
        held = sum(w in known for w in own) if rest is not piece else bounds[k] - bounds[first]
        under = (unders[k] - unders[first]) / (sizes[k] - sizes[first])
        rows = _separators(rest)
        if _is_clause(own, known, held, under, ends, rows, rest):
            clause += chars
            stuffing += settle()
            continue
        if rest is not piece:
            gone = chars - _shown(rest)
            # What stands between links without a clause of its own is their caption.
            stuffing += chars if gone * 3 >= chars or len(own) < LIST else gone
            continue
        if sum(map(str.isdigit, piece)) >= sum(map(str.isalpha, piece)):
            continue  # a row of figures
        loose.append((first, k, chars, rows))
    stuffing += settle()
    return Page(_shown(text), unders[-1], clause, stuffing)


def _varied(own: list[str], known: set[str]) -> bool:
    """Whether the words other than particles and figures are nearly all different."""
    others = [w for w in own if w not in known and not w.isdigit()]
    return len(set(others)) >= VARIED * len(others)


def _is_clause(own: list[str], known: set[str], held: int, under: float, ends: bool, rows: int, rest: str) -> bool:
    """Whether words make up a clause: of a sentence's length with an end, not turning round the same few words, and either
    held together by the page's particles or written like a sentence from its beginning, not a small letter, to its end without repeats.
    """
    n = len(own)
    if n < CLAUSE_LEAST:
        return False
    if under > REPEATED and n >= LIST // 2 and len(set(own)) < (VARIED if under > ROUND else TURNING) * n:
        return False  # the same few words in turn
    if not ends:  # prose may come without punctuation, but not without particles
        return held >= BOUND * n and under <= REPEATED and rows * 6 < n and _varied(own, known)
    if n > CLAUSE_MOST * (3 if len(own[0]) == 1 else 1) or rows * 4 >= n:
        return False
    if n < LIST // 2 or held >= LOOSE * n and (under <= ROUND or _varied(own, known)):
        return True
    head = rest.lstrip(" \t\r\n\"'“«¿¡([*_-「『")[:2]
    opens = not head[:1].islower() and not (head[:1].isupper() and head[1:].isupper())
    return opens and under <= REPEATED and _varied(own, known)


def pages(texts: Sequence[str | None]) -> list[Page]:
    """The measures of many pages; all 0 for null or blank text."""
    read = [_read(t) for t in texts]
    there = [r for r in read if r is not None]
    again = iter(repeats_of([r.ids for r in there])) if there else iter(())
    return [Page(0, 0, 0, 0) if r is None else _judge(r, next(again)) for r in read]


def page(text: str | None) -> Page:
    """The measures of one page."""
    return pages([text])[0]


#: Characters of the pages whose words are ordered together.
TOGETHER = 1_000_000


def measure(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, chars, covered, clause, stuffing) of every page, over the whole of its text; null and blank texts have zeros."""

    def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size > TOGETHER:
                yield some
                some, size = [], 0
        yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [p for some in groups(b.column(1).to_pylist()) for p in pages(some)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*done) if done else [[]] * 4))], names=["doc_id", *Page._fields])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, chars bigint, covered bigint, clause bigint, stuffing bigint")


def stuffed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """Pages of which more than ``share`` is stuffing, with their measures. Ties are not found; repeated rows stay repeated."""
    return measure(df, doc_id, text).filter(F.col("stuffing") > F.lit(share) * F.col("chars"))
