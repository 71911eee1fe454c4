"""Filling fixed-capacity containers with items, by exact-complement hashing.

Method: the sizes of all items are one histogram per capacity, with at most as many entries as the capacity has
units, whatever the number of items. On the histogram, sizes that fill a container alone, then pairs, then
triples that sum to it exactly are looked up and consumed as often as their counts allow; what is left goes
best-fit, largest first, in the same wholesale way: a combination is repeated as long as its sizes last. A capacity's
histogram is planned in one task, all capacities side by side. Items take their places by their rank among items of
their size; sizes with more than their fair share of the items are ranked in slices, so no size is ever one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sondage.session import cut_lineage

#: A size is ranked in slices if it has more than one in so many of all items; there are fewer such sizes.
SHARES = 2_000
#: Pairs of sizes that are tried as the rest of a triple, a capacity. What this leaves is packed best-fit all the same.
TRIPLES = 200_000_000


class Plan(NamedTuple):
    """For each run of equal containers: the first container's number, how many, and per size how many items in each."""

    first: list[int]
    repeat: list[int]
    sizes: list[dict[int, int]]


def plan(counts: dict[int, int], capacity: int, triples: int = TRIPLES) -> Plan:
    """How many items of which size share a container. ``counts``: size -> items, sizes from 1 to ``capacity``.

    Work and memory go by the number of different sizes, not by the capacity.
    """
    sizes = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    index = {s: i for i, s in enumerate(sizes.tolist())}
    out = Plan([], [], [])
    done = 0

    def use(combo: dict[int, int], n: int) -> None:
        nonlocal done
        if n:
            for s, k in combo.items():
                left[index[s]] -= k * n
            out.first.append(done)
            out.repeat.append(int(n))
            out.sizes.append(combo)
            done += int(n)

    def most(combo: dict[int, int]) -> int:
        return min(int(left[index[s]]) // k for s, k in combo.items())

    if capacity in index:
        use({capacity: 1}, int(left[index[capacity]]))
    for a in sizes[::-1].tolist():  # pairs: the complement of a size is looked up
        b = capacity - a
        if a < b:
            break
        if b in index:
            combo = {a: 2} if a == b else {a: 1, b: 1}
            use(combo, most(combo))
    for a in sizes[::-1].tolist():  # triples: for the largest size, all complementary pairs at once
        rest = capacity - a
        while left[index[a]] and rest > 1 and triples > 0:
            b = sizes[np.searchsorted(sizes, (rest + 1) // 2) : np.searchsorted(sizes, min(a, rest - 1), "right")][::-1]
            triples -= len(b)
            other = np.searchsorted(sizes, rest - b)
            ok = b[(sizes[np.minimum(other, len(sizes) - 1)] == rest - b) & (left[np.searchsorted(sizes, b)] > 0) & (left[np.minimum(other, len(sizes) - 1)] > 0)] if len(b) else b
            before = left[index[a]]
            for x in ok.tolist():
                combo: dict[int, int] = {}
                for s in (a, x, rest - x):
                    combo[s] = combo.get(s, 0) + 1
                use(combo, most(combo))
                if not left[index[a]]:
                    break
            if left[index[a]] == before:
                break
    some = sizes[left > 0]
    while len(some):  # best fit, largest first: each combination is repeated until one of its sizes runs out
        gap, combo, at = capacity, {}, len(some) - 1
        while gap > 0 and at >= 0:
            s = int(some[at])
            if s > gap:
                at = int(np.searchsorted(some, gap, "right")) - 1
                continue
            k = min(gap // s, int(left[index[s]]))
            combo[s] = k
            gap -= k * s
            at -= 1
        use(combo, most(combo))
        some = some[~np.isin(some, [s for s in combo if not left[index[s]]])]
    return out


def _starts(p: Plan) -> pd.DataFrame:
    """The plan by size: items of ``size`` with ranks from ``start`` on fill containers from ``first`` on, ``each`` to a container."""
    taken: dict[int, int] = {}
    rows = []
    for first, repeat, combo in zip(p.first, p.repeat, p.sizes):
        for size, each in combo.items():
            rows.append((size, taken.get(size, 0), first, each))
            taken[size] = taken.get(size, 0) + repeat * each
    return pd.DataFrame(rows, columns=["size", "start", "first", "each"]).sort_values(["size", "start"], ignore_index=True)


def pieces(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(bin_type, capacity, item_id, piece_no, size): each item whole, or cut into full pieces and a rest if it alone exceeds the capacity."""
    both = items.crossJoin(F.broadcast(capacities))  # the list of container types: the result has every item in each
    n = F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("bigint"), F.lit(1).cast("bigint"))
    cut = both.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return cut.select("bin_type", "capacity", "item_id", "piece_no", F.least("capacity", F.col("size") - F.col("piece_no") * F.col("capacity")).alias("size"))


_STARTS = "capacity bigint, size bigint, start bigint, first bigint, each bigint"


def pack(items: DataFrame, capacities: DataFrame, *, shares: int = SHARES, triples: int = TRIPLES) -> DataFrame:
    """Items in containers: (bin_type, item_id, piece_no, size, container_no), containers numbered from 0 in each bin_type.

    ``items`` (item_id bigint, size bigint) with sizes of 0 or more; ``capacities`` (bin_type bigint, capacity bigint),
    of any size and number. An item larger than the capacity is cut into full pieces and a rest; no other is split. Items
    of size 0 take no room and lie in container 0. Rows whose size or id is null, or whose size is negative, are
    no items; repeated ids are items of their own; null and non-positive capacities are left out, and a bin_type with
    several capacities has the smallest. Empty tables give none. Whatever the data, every item comes out whole or in its pieces.
    """
    c = F.col
    limits = capacities.select(c("bin_type").cast("bigint"), c("capacity").cast("bigint")).filter("bin_type IS NOT NULL AND capacity > 0").groupBy("bin_type").agg(F.min("capacity").alias("capacity"))
    items = items.select(c("item_id").cast("bigint"), c("size").cast("bigint")).filter("item_id IS NOT NULL AND size >= 0")
    cut = pieces(items, limits)
    # Container types of one capacity share a histogram and a plan. At most a row per unit of capacity, and per item.
    histogram = cut_lineage(cut.filter("size > 0").groupBy("bin_type", "capacity", "size").agg(F.count("*").alias("n")))
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = histogram.filter(c("n") * shares > total).select("bin_type", "size", F.ceil(c("n") * shares / F.lit(max(total, 1))).cast("bigint").alias("slices"))  # fewer rows than shares

    def planned(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = plan(dict(zip(rows["size"].tolist(), rows["n"].tolist())), int(key[0]), triples)
        return _starts(p).assign(capacity=int(key[0]))[["capacity", "size", "start", "first", "each"]]

    one = histogram.groupBy("capacity", "size").agg(F.max("n").alias("n"))
    starts = one.groupBy("capacity").applyInPandas(planned, _STARTS).join(limits, "capacity")

    # The rank of an item among those of its size: its place in a slice, after all earlier slices.
    salted = cut.join(F.broadcast(heavy), ["bin_type", "size"], "left").withColumn("slice", F.pmod(F.xxhash64("item_id", "piece_no"), F.coalesce("slices", F.lit(1))))
    full = salted.filter("slices IS NOT NULL").groupBy("bin_type", "size", "slice").agg(F.count("*").alias("m"))  # of heavy sizes alone
    upto = W.partitionBy("bin_type", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = full.withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0))).drop("m")
    own = W.partitionBy("bin_type", "size", "slice").orderBy("item_id", "piece_no")
    ranked = salted.withColumn("place", F.row_number().over(own) - 1).join(F.broadcast(before), ["bin_type", "size", "slice"], "left")
    none = F.lit(None).cast("bigint")
    ranked = ranked.select("bin_type", "size", "slice", (c("place") + F.coalesce("before", F.lit(0))).alias("rank"), "item_id", "piece_no", none.alias("start"), none.alias("first"), none.alias("each"))
    # The runs of containers of a size stand among its items in order of rank; each item looks back to the last one.
    marks = starts.join(F.broadcast(heavy), ["bin_type", "size"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("slices", F.lit(1)) - 1)))
    marks = marks.select("bin_type", "size", "slice", c("start").alias("rank"), none.alias("item_id"), none.alias("piece_no"), "start", "first", "each")
    back = W.partitionBy("bin_type", "size", "slice").orderBy("rank", F.asc_nulls_first("item_id")).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(c("start").isNotNull(), F.struct("start", "first", "each")), ignorenulls=True).over(back)
    placed = ranked.unionByName(marks).withColumn("run", seen).filter("item_id IS NOT NULL")
    container = F.coalesce(c("run.first") + F.floor((c("rank") - c("run.start")) / c("run.each")), F.lit(0)).cast("bigint")
    return placed.select("bin_type", "item_id", "piece_no", "size", container.alias("container_no"))


def filling(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(bin_type, capacity, containers, least, filled, wasted): how well a packing fills its containers.

    least is the number of containers that the sizes need at best, filled the share of all room that is used, wasted the
    rest of it in units. Containers with nothing but empty items do not count.
    """
    c = F.col
    limits = capacities.select(c("bin_type").cast("bigint"), c("capacity").cast("bigint")).filter("bin_type IS NOT NULL AND capacity > 0").groupBy("bin_type").agg(F.min("capacity").alias("capacity"))
    each = packed.filter("size > 0").groupBy("bin_type", "container_no").agg(F.sum("size").alias("used"))
    whole = each.groupBy("bin_type").agg(F.count("*").alias("containers"), F.sum("used").alias("used")).join(F.broadcast(limits), "bin_type")
    room = c("containers") * c("capacity")
    return whole.select("bin_type", "capacity", "containers", F.ceil(c("used") / c("capacity")).alias("least"), (c("used") / room).alias("filled"), (room - c("used")).alias("wasted"))


def token_counts(df: DataFrame, item_id: str, text: str, tokenizer: str) -> DataFrame:
    """(item_id, size): the number of tokens of each text, by the byte-level BPE ranks in the file ``tokenizer``.

    Null texts have no size and give no row; empty texts have size 0. Texts are never cut.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["item_id", "size"])

    rows = df.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("t")).filter("t IS NOT NULL")
    return cut_lineage(rows.mapInArrow(count, "item_id bigint, size bigint"))


_ENCODINGS: dict = {}


def _encoding(path: str):
    """The tokenizer of a ranks file, once for each worker."""
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # Fixed value: the pattern this vocabulary was made with.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]
