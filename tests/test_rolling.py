import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sondage.operators import rolling


def brute(rows, spans, last):
    per = defaultdict(lambda: [0, 0.0])
    for e, d, v in rows:
        per[e, d][0] += 1
        per[e, d][1] += v
    out = {}
    for e in {k[0] for k in per}:
        for day in range(min(k[1] for k in per), last + 1):
            for s in spans:
                n = sum(per[e, x][0] for x in range(day - s + 1, day + 1) if (e, x) in per)
                if n:
                    out[e, day, s] = (n, round(sum(per[e, x][1] for x in range(day - s + 1, day + 1) if (e, x) in per), 9), (e, day) in per)
    return out


def test_against_brute_force_for_any_tile(spark):
    rng = random.Random(3)
    rows = [(f"t{rng.randint(0, 6)}", 20_000 + int(rng.random() ** 2 * 120), rng.choice([0.5, 0.25, 3.0])) for _ in range(300)]
    df = spark.createDataFrame([(e, datetime(1970, 1, 1) + timedelta(days=d, hours=5), v) for e, d, v in rows], "e string, ts timestamp, v double")
    days = rolling.daily(df, F.col("e"), F.col("ts"), F.col("v"), F.lit(True))
    for tile, block in ((64, 512), (5, 2), (200, 1)):
        for last in (20_125, 20_040):
            kept = [r for r in rows if r[1] <= last]
            got = {(r.entity, r.day, r.span_days): (r.records, round(r.total, 9), r.active) for r in rolling.rolling(days, (7, 30, 1), last, tile=tile, block=block).collect()}
            assert got == brute(kept, (1, 7, 30), last), (tile, last)
    quiet = rolling.rolling(days, (7,), 20_125, quiet=True).collect()
    assert quiet and not any(r.active for r in quiet)


def test_nulls_ties_and_empty(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", t, 1.0, 1), ("a", t, 1.0, 1), (None, t, 1.0, 1), ("a", None, 1.0, 1), ("b", t, None, 1)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, v double, total int")
    days = rolling.daily(df, F.col("entity"), F.col("ts"), F.col("v"), F.col("v") > 0)
    last = rolling.last_day(df, F.col("ts"))
    got = [(r.entity, r.records, r.total) for r in rolling.rolling(days, (7,), last).collect()]
    assert got == [("a", 2, 2.0)]
    none = df.limit(0)
    assert rolling.last_day(none, F.col("ts")) is None
    assert rolling.rolling(rolling.daily(none, F.col("entity"), F.col("ts"), F.col("v"), F.lit(True)), (7, 30), -1).count() == 0
    assert rolling.rolling(days, (0,), last).count() == 0


def test_infinite_values_stay_within_their_spans(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", t, float("inf")), ("a", t + timedelta(days=3), -float("inf")), ("b", t, float("nan")), ("c", t, 2.0)] + [(e, t + timedelta(days=d), 1.0) for e in "abc" for d in range(12)]
    df = spark.createDataFrame(rows, "entity string, ts timestamp, v double")
    days = rolling.daily(df, F.col("entity"), F.col("ts"), F.col("v"), F.lit(True))
    got = {(r.entity, r.day - 20_454): r.total for r in rolling.rolling(days, (3,), 20_454 + 13).collect()}
    assert [str(got["a", d]) for d in range(14)] == ["inf"] * 3 + ["-inf"] * 3 + ["3.0"] * 6 + ["2.0", "1.0"]
    assert [got["b", d] == got["b", d] for d in range(5)] == [False] * 3 + [True] * 2 and got["c", 0] == 3.0 and got["c", 4] == 3.0


def test_averages(spark):
    df = spark.createDataFrame([("a", 1, 7, 2, 14.0, True)], rolling.SCHEMA)
    r = rolling.with_averages(df).first()
    assert (r.per_day, r.per_record) == (2.0, 7.0)
