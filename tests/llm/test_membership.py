import random
from itertools import chain, combinations

from pyspark.sql import functions as F

from sondage.llm import membership as m

NAMES = ("day", "tenant", "label")
GROUPINGS = [list(c) for c in chain(*(combinations(NAMES, n) for n in (1, 2, 3)))]


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice([None, *(f"p{i}" for i in range(40))]), rng.choice([1, 2, 3, None]), rng.choice(["a", "b\x01", "\x02", "\x03a", None]), rng.choice("xyz")) for _ in range(n)]


def part(df):
    return m.partial(df, F.col("who"), {n: F.col(n) for n in NAMES})


def frame(spark, data):
    return spark.createDataFrame(data, "who string, day int, tenant string, label string")


def brute(data):
    out = {}
    for by in GROUPINGS:
        for p, d, t, x in data:
            if p is not None:
                vals = {"day": None if d is None else str(d), "tenant": t, "label": x}
                out.setdefault(("+".join(by), *(vals[f] if f in by else None for f in NAMES)), set()).add(p)
    return {k: len(v) for k, v in out.items()}


def counts(totals):
    return {(r.grouping, r.day, r.tenant, r.label): r.identifiers for r in m.distinct_counts(totals, GROUPINGS).collect()}


def test_exact_for_every_grouping_with_and_without_wide_identifiers(spark):
    data = rows(1) + [("hot", i % 50, f"t{i}", "x") for i in range(300)]
    cells = part(frame(spark, data))
    for wide in (10_000, 100, 1):  # none, one, and all identifiers are wide
        assert counts(m.patterns(cells, wide=wide)) == brute(data)


def test_partials_merge_in_any_order_and_overlap(spark):
    a, b = rows(2), rows(3)
    pa, pb = (part(frame(spark, x)) for x in (a, b))
    want = brute(a + b)
    assert counts(m.patterns(m.merge(pa, pb))) == want == counts(m.patterns(m.merge(pb, pa, pa)))


def test_any_and_all(spark):
    data = rows(4) + [("hot", i % 50, f"t{i}", "x") for i in range(300)]
    cells = part(frame(spark, data))
    of = lambda f: {p for p, d, t, x in data if p is not None and f(d, t, x)}
    for wide in (10_000, 100, 2):
        totals = m.patterns(cells, wide=wide)
        union = m.count_any(totals, lambda c: c["day"].isin("1", "2") | (c["label"] == "y")).first()[0]
        assert union == len(of(lambda d, t, x: d in (1, 2) or x == "y"))
        both = m.count_all(totals, [lambda c: c["day"] == "1", lambda c: c["label"] == "z"]).first()[0]
        assert both == len(of(lambda d, t, x: d == 1) & of(lambda d, t, x: x == "z"))


def test_empty_and_clashing_columns(spark):
    none = part(frame(spark, []))
    totals = m.patterns(none)
    assert counts(totals) == {} and m.count_any(totals, lambda c: F.lit(True)).first()[0] == 0
    df = frame(spark, rows(5)).withColumns({"identifier": F.lit(1), "cell": F.lit(2), "pattern": F.lit(3)})
    assert counts(m.patterns(part(df))) == brute(rows(5))
