"""Evaluation texts leaking into training text.

Method: the normalised n-grams of all test items form a hash set that is broadcast once its size is checked;
training documents are read once, their token windows are looked up, hits are verified word by word, and the
item's words that stand in verified runs are counted. Beyond the size bound a Bloom filter of fixed size takes the
hash set's place; the few windows that pass it are joined with the test n-grams by their digest in a salted shuffle, and
counted per document and item. Found spans, or whole documents, can be removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.words import located, words

RUN = 5
SHARE = 0.5
#: Test n-grams that may be broadcast, about 100 bytes each; beyond that the shuffled way is taken.
BROADCAST_GRAMS = 1_000_000

#: Bits of the Bloom filter, whatever the number of test n-grams: 16 MB to every executor.
BLOOM_BITS = 1 << 27
#: Slices in which the documents of one n-gram are joined.
SALT = 16

SCHEMA = "doc_id bigint, item_id bigint, matched bigint, item_words bigint"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams(NamedTuple):
    """The test items' n-grams: word numbers, sorted window hashes, and for each window its item and place."""

    run: int
    vocabulary: dict[str, int]
    hashes: np.ndarray
    windows: np.ndarray  # one row of ``run`` word numbers a window, in the order of hashes
    item: np.ndarray
    place: np.ndarray
    lengths: dict[int, int]


def _hashes(ids: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of each window of ``run`` word numbers."""
    n = len(ids) - run + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = (h ^ (ids[k : k + n].astype(np.uint64) + np.uint64(1))) * _MIX
            h ^= h >> np.uint64(29)
    return h


def grams(items: list[tuple[int, str]], run: int = RUN) -> Grams:
    """The lookup of test items, given as (item_id, text)."""
    vocabulary: dict[str, int] = {}
    hashes, windows, item, place, lengths = [], [], [], [], {}
    for item_id, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], dtype=np.int64)
        lengths[item_id] = len(ids)
        if len(ids) >= run:
            hashes.append(_hashes(ids, run))
            windows.append(np.lib.stride_tricks.sliding_window_view(ids, run))
            item.append(np.full(len(ids) - run + 1, item_id, dtype=np.int64))
            place.append(np.arange(len(ids) - run + 1))
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return Grams(run, vocabulary, none.astype(np.uint64), none.reshape(0, run), none, none, lengths)
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    return Grams(run, vocabulary, h[order], np.concatenate(windows)[order], np.concatenate(item)[order], np.concatenate(place)[order], lengths)


def _hits(g: Grams, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ids, row of g) of every verified window hit; an item's repeated window gives a hit for each place."""
    known = ids >= 0
    if len(ids) < g.run or not len(g.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = np.lib.stride_tricks.sliding_window_view(known, g.run).all(axis=1)
    at = np.flatnonzero(full)
    if not len(at):
        return at, at
    windows = np.lib.stride_tricks.sliding_window_view(ids, g.run)[at]
    h = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(g.run):
            h = (h ^ (windows[:, k].astype(np.uint64) + np.uint64(1))) * _MIX
            h ^= h >> np.uint64(29)
    lo, hi = np.searchsorted(g.hashes, h, "left"), np.searchsorted(g.hashes, h, "right")
    n = hi - lo
    pos = np.repeat(np.arange(len(at)), n)
    row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    same = (windows[pos] == g.windows[row]).all(axis=1)
    return at[pos[same]], row[same]


def matched_words(g: Grams, text: str | None) -> dict[int, int]:
    """item_id -> how many of the item's words stand in the text within runs of ``g.run`` or more."""
    get = g.vocabulary.get
    ids = np.array([get(w, -1) for w in words(text)], dtype=np.int64)
    _, row = _hits(g, ids)
    out = {}
    for item in np.unique(g.item[row]):
        starts = np.unique(g.place[row[g.item[row] == item]])
        out[int(item)] = len(np.unique((starts[:, None] + np.arange(g.run)).ravel()))
    return out


def spans(g: Grams, text: str) -> list[tuple[int, int]]:
    """Stretches [first, end) of the text's words that stand in any test item in runs of ``g.run`` or more."""
    return _stretches(g, words(text))


def _stretches(g: Grams, own: list[str]) -> list[tuple[int, int]]:
    ids = np.array([g.vocabulary.get(w, -1) for w in own], dtype=np.int64)
    at, _ = _hits(g, ids)
    out: list[tuple[int, int]] = []
    for a in np.unique(at).tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], a + g.run)
        else:
            out.append((a, a + g.run))
    return out


def cleaned(g: Grams, text: str | None) -> tuple[str | None, int]:
    """A text without the words, and what stands between them, of its :func:`spans`; and how many characters went."""
    if not text:
        return text, 0
    own, places = located(text)
    out, end = [], 0
    for a, b in _stretches(g, own):
        out.append(text[end : places[a][0]])
        end = max(end, places[b - 1][1])
    left = "".join([*out, text[end:]])
    return left, len(text) - len(left)


def _by_broadcast(documents: DataFrame, g: Grams) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(g)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gr = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                for item, n in matched_words(gr, text.as_py()).items():
                    rows.append((doc, item, n, gr.lengths[item]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "matched", "item_words"])

    return documents.mapInArrow(scan, SCHEMA)


def _digests(w: list[str], run: int) -> list[bytes]:
    import hashlib

    return [hashlib.blake2b(" ".join(w[k : k + run]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for k in range(len(w) - run + 1)]


def _bits(digests: list[bytes], bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8")[::2] % np.uint64(bits)


def _windows(df: DataFrame, run: int, bits: int) -> DataFrame:
    """(id, place, gram, words, bit): the digest of every window of ``run`` words, its place and filter bit, and the number of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = words(text.as_py())
                if d := _digests(w, run):
                    columns = [pa.array([key] * len(d), pa.int64()), pa.array(range(len(d)), pa.int64()), pa.array(d, pa.binary()), pa.array([len(w)] * len(d), pa.int64()), pa.array(_bits(d, bits).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "place", "gram", "words", "bit"])

    return df.mapInArrow(cut, "id bigint, place bigint, gram binary, words bigint, bit bigint")


def _bloom(test: DataFrame, bits: int) -> np.ndarray:
    """The filter as a bit array, put together by the executors; ``bits`` / 8 bytes come to the driver."""
    one = F.col("bit") + 1  # the built-in bitmaps count from 1
    parts = test.groupBy(F.bitmap_bucket_number(one).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("b"))
    out = np.zeros(bits // 8 + 4096, dtype=np.uint8)
    for r in parts.toLocalIterator():
        chunk = np.frombuffer(bytes(r.b), dtype=np.uint8)
        out[(r.no - 1) * len(chunk) : r.no * len(chunk)] = chunk
    return out


def _passing(documents: DataFrame, run: int, bloom: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, gram): the different windows of each document that the filter lets through."""
    shared = documents.sparkSession.sparkContext.broadcast(bloom)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if d := list(dict.fromkeys(_digests(words(text.as_py()), run))):
                    bit = _bits(d, bits)
                    there = shared.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                    kept = [d[i] for i in np.flatnonzero(there)]
                    if kept:
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(kept), pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "gram"])

    return documents.mapInArrow(cut, "doc_id bigint, gram binary")


def _by_shuffle(documents: DataFrame, items: DataFrame, run: int, bits: int) -> DataFrame:
    windows = _windows(items, run, bits)
    seen = _passing(documents, run, _bloom(windows, bits), bits).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT).cast("bigint")))
    test = windows.select(F.col("id").alias("item_id"), "place", "gram", F.col("words").alias("item_words"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(SALT)])).alias("salt"))
    covered = seen.join(test, ["gram", "salt"]).select("doc_id", "item_id", "item_words", F.explode(F.sequence("place", F.col("place") + (run - 1))).alias("word"))
    return covered.groupBy("doc_id", "item_id").agg(F.count_distinct("word").alias("matched"), F.max("item_words").alias("item_words"))


def _few(items: DataFrame, run: int, most: int) -> Grams | None:
    """The lookup of all items, or null if there are too many to broadcast. A text has fewer words, so fewer windows, than characters."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 8 * most:
        return None
    g = grams([(r.item_id, r.text) for r in items.collect()], run)
    return g if len(g.hashes) <= most else None


def _narrow(df: DataFrame, key: str, name: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias(name), F.col(text).alias("text")).filter("text IS NOT NULL")


def leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    run: int = RUN, share: float = SHARE, broadcast_grams: int = BROADCAST_GRAMS, bloom_bits: int = BLOOM_BITS,
) -> DataFrame:
    """Documents with leaked test items: (doc_id, item_id, matched, item_words).

    A pair comes out if at least ``share`` of the item's words stand in the document within runs of ``run`` or
    more consecutive words of the item, anywhere in it. Texts are compared in full. Null and empty texts hold
    nothing; items of fewer than ``run`` words are never found; repeated rows with one doc_id count as
    documents of their own only under their own ids; other columns are ignored.
    """
    documents, items = _narrow(documents, doc_id, "doc_id", text), _narrow(items, item_id, "item_id", text).filter("item_id IS NOT NULL")
    g = _few(items, run, broadcast_grams)
    found = _by_broadcast(documents, g) if g is not None else _by_shuffle(documents, items, run, bloom_bits)
    return found.filter(F.col("matched") >= F.lit(share) * F.col("item_words"))


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which no test item leaked."""
    return documents.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def without_spans(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    run: int = RUN, broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """All documents as (doc_id, text, removed): every run of ``run`` or more words of a test item cut out of the text.

    removed is the number of characters that went. What stands between the words of a run goes with them; everything
    else stays as it was written. Null texts stay null. Beyond the broadcast bound only the items that share an n-gram with a
    document are looked up in it.
    """
    own = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    few = _narrow(items, item_id, "item_id", text).filter("item_id IS NOT NULL")
    g = _few(few, run, broadcast_grams)
    out = "doc_id bigint, text string, removed bigint"

    def rows(b: pa.RecordBatch, pick) -> pa.RecordBatch:  # noqa: ANN001
        done = [cleaned(pick(i), t) for i, t in enumerate(b.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["doc_id", "text", "removed"])

    if g is not None:
        shared = own.sparkSession.sparkContext.broadcast(g)
        return own.mapInArrow(lambda it: (rows(b, lambda _: shared.value) for b in it), out)
    hit = leaks(own, few, run=run, share=0.0, broadcast_grams=broadcast_grams).select("doc_id", "item_id")
    told = hit.join(few, "item_id").groupBy("doc_id").agg(F.collect_list("text").alias("items"))  # those of one document

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items_of = b.column(2).to_pylist()
            yield rows(b, lambda i: grams(list(enumerate(items_of[i] or [])), run))

    return own.join(told, "doc_id", "left").select("doc_id", "text", "items").mapInArrow(looked_up, out)
