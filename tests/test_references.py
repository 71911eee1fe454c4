from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sondage.functions.ids import hex_key, is_blank
from sondage.operators import references

T0 = datetime(2026, 1, 1)
REFS, TARGETS, ERASED = "src_table string, row_id bigint, key string, arrival timestamp", "key string, arrival timestamp", "key string"


def frames(spark, refs, targets, erased):
    return spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), spark.createDataFrame([(e,) for e in erased], ERASED)


def brute(refs, targets, erased):
    out = []
    for t, i, k, at in refs:
        seen = [a or datetime(1, 1, 1) for x, a in targets if x is not None and x == k]
        if seen:
            if at is not None and min(seen) > at:
                out.append((t, i, "late"))
        else:
            out.append((t, i, "erased" if k in erased else "missing"))
    return sorted(out)


def test_states_with_and_without_heavy_keys(spark):
    refs = [("e", i, f"k{i % 7}", T0 + timedelta(hours=i)) for i in range(40)] + [("e", 100 + i, "hot", T0) for i in range(60)] + [("a", 5, "k1", None), ("e", 205, "k5", T0), ("e", 205, "k5", T0)]
    targets = [("k1", T0 + timedelta(hours=10)), ("k1", T0 + timedelta(hours=20)), ("k2", T0), ("hot", T0 + timedelta(hours=1)), (None, T0), ("k4", None)]
    erased = ["k3", "k3", "k1", None]
    want = brute(refs, targets, erased)
    f = frames(spark, refs, targets, erased)
    counts = Counter((t, at and f"{at:%H}", state) for t, i, state in want for at in [next(r[3] for r in refs if r[:2] == (t, i))])
    for shares in (2_000, 4, 1):  # all keys heavy, one of them, none
        got = references.orphans(*f, shares=shares)
        assert sorted((r.src_table, r.row_id, r.state) for r in got.collect()) == want, shares
        counted = references.orphan_counts(*f, F.date_format("arrival", "HH"), shares=shares).collect()
        assert {(r.src_table, r.period, r.state): r.orphans for r in counted} == counts, shares
    assert references.heavy_keys(f[0].withColumn("n", F.lit(1)), len(refs), 4) == ["hot"]


def test_a_hot_key_is_never_shuffled(spark):
    refs = spark.range(60_000).select(F.lit("e").alias("src_table"), F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), F.lit(T0).alias("arrival"))
    targets = refs.filter("row_id % 2 = 0").select("key", "arrival")
    out = references.orphans(refs, targets, refs.select("key").limit(0))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "= hot)" in plan  # the hot key by broadcast, the others by their shuffled join
    assert out.count() == 20_000 and {r.state for r in out.select("state").distinct().collect()} == {"missing"}


def test_empty_tables_and_extra_columns(spark):
    refs, targets, erased = frames(spark, [("e", 1, "k", T0)], [], [])
    assert [r.state for r in references.orphans(refs.withColumn("first_seen", F.lit(1)), targets.withColumn("state", F.lit("x")), erased.withColumn("exists", F.lit(1))).collect()] == ["missing"]
    none = frames(spark, [], [("k", T0)], ["k"])
    assert references.orphans(*none).count() == 0
    assert references.orphan_counts(*none, F.date_format("arrival", "yyyy")).count() == 0


def test_keys(spark):
    h = "539db1820ca44768ab919effbfeddb15"
    same = [h, h.upper(), f" {h}\t", "{539db182-0ca4-4768-ab91-9effbfeddb15}", f"urn:uuid:{h}"]
    df = spark.createDataFrame([(x,) for x in [*same, None, "", " \t", "zz-9", h[:-1]]], "x string")
    got = [r[0] for r in df.select(hex_key(F.col("x"), 32)).collect()]
    assert got == [h] * 5 + [None, None, None, "?zz9", "?" + h[:-1]]
    assert [r[0] for r in df.select(is_blank(F.col("x"))).collect()] == [False] * 5 + [True] * 3 + [False] * 2
