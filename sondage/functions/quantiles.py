"""Exact order statistics of groups of any size, without one task or buffer that holds a group's values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.session import cut_lineage

#: Parts into which a sketch cuts what may still hold a value, and the sketch's rank error, as one in so many.
PARTS, SKETCH = 256, 10_000
#: At most so many values of a group are ranked one by one.
RANKED = 1_000_000


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: Sequence[Callable[[Column], Column]], ranked: int = RANKED) -> DataFrame:
    """(<by>, n, values): in each group the values at the given ranks, from 0, each a function of the group's size n.

    For each rank the values that may be it are bracketed: while a bracket may hold more than ``ranked`` values, a sketch of
    bounded size cuts it into parts and keeps those around the rank, counting what lies below. What remains is
    ranked by a running count over different values. All ranks share each pass. Nulls and NaN are no values; groups
    without any have no row; a rank that is null or outside of the group gives null.
    """
    v, c = F.col(value).cast("double"), F.col
    rows = df.select(*by, v.alias("_v")).filter(c("_v").isNotNull() & ~F.isnan("_v"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), f(c("n")).cast("bigint").alias("rank")) for i, f in enumerate(ranks)])
    no = F.lit(None).cast("double")
    marks = sizes.select(*by, "n", F.explode(asked).alias("a")).select(*by, "n", "a.i", "a.rank", no.alias("lo"), no.alias("hi"), F.lit(0).cast("bigint").alias("below"), c("n").alias("inside"))
    marks = cut_lineage(marks)  # a row for each group and rank

    def inside(m: DataFrame) -> DataFrame:
        both = rows.join(m, list(by)) if by else rows.crossJoin(F.broadcast(m))
        return both.filter((c("lo").isNull() | (c("_v") >= c("lo"))) & (c("hi").isNull() | (c("_v") <= c("hi"))))

    top = marks.agg(F.max("inside")).first()[0] or 0
    while top > ranked:
        grid = [i / PARTS for i in range(PARTS + 1)]
        cut = inside(marks).groupBy(*by, "n", "i", "rank", "lo", "hi", "below").agg(F.percentile_approx("_v", grid, SKETCH).alias("e"), F.count("*").alias("m"))
        place = (c("rank") - c("below")) / c("m") * PARTS
        at = lambda k: F.get("e", F.greatest(F.lit(0), F.least(F.lit(PARTS), k)).cast("int"))
        cut = cut.withColumns({"a": at(F.floor(place) - 2), "b": at(F.ceil(place) + 3)}).drop("e", "m")
        counted = inside(cut).groupBy(*by, "n", "i", "rank", "a", "b", "below").agg(
            F.count_if(c("_v") < c("a")).alias("less"), F.count_if(c("_v").between(c("a"), c("b"))).alias("inside"), F.count_distinct(F.when(c("_v").between(c("a"), c("b")) & (c("a") == c("b")), c("_v"))).alias("one")
        )
        # A bracket of a single value needs no ranking, however often the value occurs.
        marks = cut_lineage(counted.select(*by, "n", "i", "rank", c("a").alias("lo"), c("b").alias("hi"), (c("below") + c("less")).alias("below"), F.when(c("one") == 1, F.lit(1)).otherwise(c("inside")).alias("inside")))
        before, top = top, marks.agg(F.max("inside")).first()[0] or 0
        if top >= before:
            break  # ties fill the bracket: they are few different values, which the count below takes in any number
    # Ranks with one bracket share its count.
    open_ = marks.groupBy(*by, "n", "lo", "hi", "below").agg(F.array_sort(F.collect_list(F.struct("i", "rank"))).alias("asked"))
    own = [*by, "n", "lo", "hi"]
    cells = inside(open_).groupBy(*own, "below", "asked", "_v").agg(F.count("*").alias("k"))
    upto = c("below") + F.sum("k").over(W.partitionBy(*own).orderBy("_v"))
    rank = lambda j: F.get("asked", F.lit(j))["rank"]
    first = lambda j: F.min(F.when((c("upto") > rank(j)) & (rank(j) >= 0), c("_v")))
    found = cells.withColumn("upto", upto).groupBy(*own, "asked").agg(F.array(*[first(j) for j in range(len(ranks))]).alias("x"))
    each = found.select(*by, "n", F.explode(F.arrays_zip("asked", "x")).alias("z")).filter("z.asked IS NOT NULL").select(*by, "n", "z.asked.i", "z.x")
    both = F.array_sort(F.collect_list(F.struct("i", "x")))  # one for each rank asked for
    return each.groupBy(*by, "n").agg(F.transform(both, lambda s: s["x"]).alias("values"))


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, ranked: int = RANKED) -> DataFrame:
    """(<by>, n, quantile): the ``q`` quantile of ``value`` in each group, between ranks linearly (as a median is)."""
    at = lambda n: F.lit(q) * (n - 1)
    out = order_statistics(df, by, value, [lambda n: F.floor(at(n)), lambda n: F.ceil(at(n))], ranked)
    a, b, n = F.get("values", F.lit(0)), F.get("values", F.lit(1)), F.col("n")
    return out.select(*by, "n", (a + (at(n) - F.floor(at(n))) * (b - a)).alias("quantile"))
