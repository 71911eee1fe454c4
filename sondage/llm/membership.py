"""Distinct counts over huge identifier sets, exact and from mergeable partial results.

Method: every identifier is reduced to its pattern, the set of cells (finest groups) that contain it; identical
patterns are counted; and the distinct count of any group or combination of groups is the total of the patterns
that touch it. The stated error bound is zero. Partial results are the identifiers' cell sets of any slice of the
data; merging them is set union, so slices can be added, in any order and more than once.

A pattern is one row, so its length is bounded: identifiers in more cells than WIDE stay out of the patterns as rows
(identifier, cell), however many there are, and are counted exactly beside them by distinct shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.session import cut_lineage

#: Cells of the longest pattern.
WIDE = 10_000
#: Wide identifiers that may be broadcast; more of them are joined by a shuffle.
BROADCAST = 100_000


#: Between the values of a group's key, for a null among them, and before either or itself within a value.
_NEXT, _NULL, _ESCAPE = "\x01", "\x02", "\x03"


def _coded(c: Column) -> Column:
    """A value as text that holds neither of the two marks."""
    out = c.cast("string")
    for mark, code in ((_ESCAPE, "c"), (_NEXT, "a"), (_NULL, "b")):
        out = F.replace(out, F.lit(mark), F.lit(_ESCAPE + code))
    return out


def _decoded(c: Column) -> Column:
    out = F.nullif(c, F.lit(_NULL))
    for mark, code in ((_NULL, "b"), (_NEXT, "a"), (_ESCAPE, "c")):
        out = F.replace(out, F.lit(_ESCAPE + code), F.lit(mark))
    return out


def partial(df: DataFrame, identifier: Column, dims: dict[str, Column], *, compact: bool = False) -> DataFrame:
    """The partial result of a slice of data: (identifier, cell), cell a struct of ``dims`` as text.

    Rows without an identifier count nowhere; null is an ordinary value of a dimension. Clashing names are no
    matter, since only ``identifier`` and ``dims`` are read. An empty slice gives an empty partial. Repeats make no difference
    to what follows; ``compact`` takes them out, for a partial that is kept.
    """
    cell = F.struct(*[_coded(c).alias(n) for n, c in dims.items()])
    out = df.select(identifier.alias("identifier"), cell.alias("cell")).filter("identifier IS NOT NULL")
    return out.distinct() if compact else out


def merge(*partials: DataFrame) -> DataFrame:
    """The partial result of all slices together; slices may overlap."""
    out = partials[0]
    for p in partials[1:]:
        out = out.unionByName(p)
    return out.distinct()


def patterns(cells: DataFrame, *, wide: int = WIDE) -> DataFrame:
    """(pattern, identifiers, wide): the cell sets that occur and the number of identifiers that have each.

    Identifiers in more than ``wide`` cells come as patterns of one cell with their name in ``wide``, null for all
    others; :func:`distinct_counts` puts them together again. How many identifiers are wide has no bound.
    """
    # Repeats count too, so at least all that are in so many cells; most often none.
    many = cut_lineage(cells.groupBy("identifier").agg(F.count("*").alias("n")).filter(F.col("n") > wide).select("identifier"))
    found = many.count()
    if 0 < found <= BROADCAST:
        many = F.broadcast(many)
    narrow = cells.join(many, "identifier", "left_anti") if found else cells
    sets = narrow.groupBy("identifier").agg(F.array_sort(F.collect_set("cell")).alias("pattern"))
    out = sets.groupBy("pattern").agg(F.count("*").alias("identifiers")).withColumn("wide", F.lit(None).cast("string"))
    if found:
        rows = cells.join(many, "identifier", "left_semi").distinct()
        out = out.unionByName(rows.select(F.array("cell").alias("pattern"), F.lit(1).cast("bigint").alias("identifiers"), F.col("identifier").cast("string").alias("wide")))
    return cut_lineage(out)


def distinct_counts(totals: DataFrame, groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Distinct identifiers of every group of every grouping: (grouping, <dims>, identifiers).

    ``totals`` as :func:`patterns` gives them. grouping names the dimensions that a row is grouped by, joined
    by ``+``; the others are null. Groups are text within a pattern, so that its repeats are found by hashing.
    """
    fields = totals.schema["pattern"].dataType.elementType.fieldNames()
    null, mark = F.lit(_NULL), F.lit(_NEXT)

    def keys(no: int, by: Sequence[str]) -> Column:
        def key(cell: Column) -> Column:
            return F.concat(F.lit(str(no)), *[x for f in by for x in (mark, F.coalesce(cell[f], null))])

        return F.array_distinct(F.transform("pattern", key))

    touched = totals.select("identifiers", "wide", F.explode(F.flatten(F.array(*[keys(i, g) for i, g in enumerate(groupings)]))).alias("g"))
    narrow = touched.filter("wide IS NULL").groupBy("g").agg(F.sum("identifiers").alias("n"))
    wide = touched.filter("wide IS NOT NULL").select("wide", "g").distinct().groupBy("g").agg(F.count("*").alias("n"))
    counts = narrow.unionByName(wide).groupBy("g").agg(F.sum("n").alias("identifiers")).withColumn("g", F.split("g", _NEXT))
    no = F.col("g")[0].cast("int")
    names = F.array(*[F.lit("+".join(by)) for by in groupings])

    def value(f: str) -> Column:
        place = F.array(*[F.lit(by.index(f) + 1 if f in by else None).cast("int") for by in groupings])
        return _decoded(F.get("g", F.get(place, no)))

    return counts.select(F.get(names, no).alias("grouping"), *[value(f).alias(f) for f in fields], "identifiers")


def count_any(totals: DataFrame, touches: Callable[[Column], Column]) -> DataFrame:
    """Distinct identifiers in the union of the cells for which ``touches(cell)`` holds, as one row (identifiers)."""
    hit = totals.filter(F.exists("pattern", touches))
    return hit.agg((F.coalesce(F.sum(F.when(F.col("wide").isNull(), F.col("identifiers"))), F.lit(0)) + F.count_distinct("wide")).alias("identifiers"))


def count_all(totals: DataFrame, touches: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """Distinct identifiers that are in every one of several unions of cells, as one row (identifiers)."""
    flags = [F.exists("pattern", t).alias(f"t{i}") for i, t in enumerate(touches)]
    seen = totals.select("identifiers", "wide", *flags)
    every = lambda cols: " AND ".join(cols)
    names = [f"t{i}" for i in range(len(touches))]
    narrow = seen.filter("wide IS NULL").filter(every(names)).agg(F.coalesce(F.sum("identifiers"), F.lit(0)).alias("n"))
    wide = seen.filter("wide IS NOT NULL").groupBy("wide").agg(*[F.max(n).alias(n) for n in names]).filter(every(names)).agg(F.count("*").alias("n"))
    return narrow.unionByName(wide).agg(F.sum("n").alias("identifiers"))
