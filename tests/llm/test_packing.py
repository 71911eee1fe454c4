import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sondage.llm import packing

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def check(sizes, capacity, got):
    """got: (item, piece, size, container). Nothing lost, nothing over capacity, nothing split that fits."""
    fill, parts = Counter(), defaultdict(list)
    for item, piece, size, container in got:
        fill[container] += size
        parts[item].append((piece, size))
    assert all(v <= capacity for v in fill.values())
    assert Counter({i: sum(s for _, s in ps) for i, ps in parts.items()}) == Counter(dict(sizes))
    for i, size in sizes:
        assert sorted(s for _, s in parts[i]) == sorted(([capacity] * (size // capacity) + ([size % capacity] if size % capacity else [])) or [0])
    return len([c for c, v in fill.items() if v])


def pack(spark, sizes, capacities):
    items = spark.createDataFrame(sizes, "item_id bigint, size bigint")
    bins = spark.createDataFrame(list(enumerate(capacities)), "bin_type bigint, capacity bigint")
    out = defaultdict(list)
    for r in packing.pack(items, bins).collect():
        out[capacities[r.bin_type]].append((r.item_id, r.piece_no, r["size"], r.container_no))
    return out


def test_valid_and_close_to_the_bound(spark):
    rng = random.Random(2)
    sizes = [(i, int(rng.choice([rng.random() * 50, 10 + rng.random() * 200, rng.random() * 700]))) for i in range(3000)]
    for capacity, got in pack(spark, sizes, [64, 256, 1000]).items():
        used = check(sizes, capacity, got)
        least = -(-sum(s for _, s in sizes) // capacity)
        assert least <= used <= least * 1.03 + 1


def test_exact_complements_are_found():
    assert len(packing.plan({10: 1}, 10).first) == 1
    for counts in ({7: 5, 3: 5}, {5: 4}, {5: 2, 3: 2, 2: 2}, {4: 6, 2: 3}):
        p = packing.plan(counts, 10)
        assert sum(p.repeat) == sum(s * n for s, n in counts.items()) // 10
        assert all(sum(s * k for s, k in c.items()) == 10 for c in p.sizes)


def test_plan_is_whole_for_any_histogram():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.randint(1, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 10**rng.randint(0, 9)) for _ in range(rng.randint(0, 8))}
        p = packing.plan(counts, capacity)
        placed = Counter()
        for n, combo in zip(p.repeat, p.sizes):
            assert sum(s * k for s, k in combo.items()) <= capacity
            placed.update({s: k * n for s, k in combo.items()})
        assert placed == Counter(counts) and len(p.first) < 200
        few = packing.plan(counts, capacity, triples=0)  # without triples all the same
        assert sum(s * k * n for n, c in zip(few.repeat, few.sizes) for s, k in c.items()) == sum(s * n for s, n in counts.items())


def test_edges(spark):
    assert pack(spark, [], [10]) == {}
    items = spark.createDataFrame([(1, 0), (2, None), (None, 3), (3, -1), (4, 25), (4, 25)], "item_id bigint, size int").withColumn("capacity", F.lit(1))
    bins = spark.createDataFrame([(1, 10), (1, 10), (None, 5), (2, None), (3, 0)], "bin_type bigint, capacity int").withColumn("size", F.lit(1))
    got = [(r.item_id, r["size"]) for r in packing.pack(items, bins).collect()]
    assert sorted(got) == sorted([(1, 0)] + [(4, s) for s in (10, 10, 5)] * 2)
    fill = Counter()
    for r in packing.pack(items, bins).collect():
        fill[r.container_no] += r["size"]
    assert max(fill.values()) <= 10


def test_any_number_of_containers_of_any_capacity(spark):
    items = spark.createDataFrame([(i, 7 * i % 40) for i in range(50)], "item_id bigint, size int")
    bins = spark.range(1500).select(F.col("id").alias("bin_type"), (F.col("id") % 37 + 3).alias("capacity"))
    got = packing.pack(items, bins).groupBy("bin_type").agg(F.count_distinct("item_id").alias("n"), F.sum("size").alias("s"))
    assert {(r.n, r.s) for r in got.collect()} == {(50, sum(7 * i % 40 for i in range(50)))} and got.count() == 1500
    rng = random.Random(6)
    big = [(i, int(rng.random() ** 2 * 9_000_000_000)) for i in range(400)]
    for c, got in pack(spark, [(i, s) for i, s in big], [3_000_000, 5_000_000_000]).items():
        check(big, c, got)


def test_hot_size_in_slices(spark):
    sizes = [(i, 3 if i % 3 else 1 + i % 9) for i in range(3000)]
    items = spark.createDataFrame(sizes, "item_id bigint, size int")
    bins = spark.createDataFrame([(0, 10), (1, 4)], "bin_type bigint, capacity int")
    for shares in (1, 7, 100_000):
        out = defaultdict(list)
        for r in packing.pack(items, bins, shares=shares).collect():
            out[r.bin_type].append((r.item_id, r.piece_no, r["size"], r.container_no))
        for b, capacity in ((0, 10), (1, 4)):
            check(sizes, capacity, out[b])
    f = {r.bin_type: r for r in packing.filling(packing.pack(items, bins), bins).collect()}
    assert f[0].containers >= f[0].least and f[0].wasted == f[0].containers * 10 - sum(s for _, s in sizes) and f[0].filled > 0.97


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_token_counts(spark):
    texts = [(1, "Hello world"), (2, ""), (3, None), (4, "word " * 100_000), (5, "<|endoftext|>")]
    got = {r.item_id: r["size"] for r in packing.token_counts(spark.createDataFrame(texts, "d bigint, t string"), "d", "t", TOKENIZER).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] >= 100_000 and got[5] > 1
