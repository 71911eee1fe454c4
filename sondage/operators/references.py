"""References to records that do not exist (orphans), found by a skew-aware split.

Method: references are pre-aggregated per key and period, on the map side first, so a key that holds a third of all
rows sends a few rows a task. Keys with more than their fair share of the references are heavy; there can't be more
of them than shares, so their verdicts are broadcast and their rows are never shuffled by key. All other keys go
through shuffled joins: an anti-join finds those without any target. Counts come from the pre-aggregate alone, but for the
keys whose references arrive on both sides of their target's first arrival. Both parts are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.session import cut_lineage

#: A key is heavy if it has more than one in so many of all references, so there are fewer heavy keys than that.
SHARES = 2_000


def references(df: DataFrame, table: str, row_id: str, key: Column, arrival: str) -> DataFrame:
    """The referring rows of one table: (src_table, row_id, key, arrival). Rows without a key are none."""
    return df.select(
        F.lit(table).alias("src_table"), F.col(row_id).cast("bigint").alias("row_id"), key.alias("key"), F.col(arrival).alias("arrival")
    ).filter("key IS NOT NULL")


def heavy_keys(counts: DataFrame, total: int, shares: int = SHARES) -> list[str]:
    """The keys of (key, n) with more than one in ``shares`` of ``total`` references: fewer than ``shares``, whatever the data."""
    return [r.key for r in counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") * shares > total).collect()]


def _sides(targets: DataFrame, erased: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets with an arrival, from the start where it is unknown, and erasures; both without null keys."""
    known = F.coalesce("arrival", F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("arrival")
    return targets.select("key", known).filter("key IS NOT NULL"), erased.select("key").filter("key IS NOT NULL")


def _verdict(targets: DataFrame, erased: DataFrame) -> DataFrame:
    """One row per key that exists or is erased: its first arrival as a target, and whether it is erased."""
    both = targets.select("key", F.col("arrival").alias("first_seen"), F.lit(False).alias("erased"), F.lit(True).alias("exists")).unionByName(
        erased.select("key", F.lit(None).cast("timestamp").alias("first_seen"), F.lit(True).alias("erased"), F.lit(False).alias("exists"))
    )
    return both.groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("erased").alias("erased"), F.max("exists").alias("exists"))


def _split(refs: DataFrame, targets: DataFrame, erased: DataFrame, heavy: list[str]) -> DataFrame:
    """``refs`` with their key's verdict (first_seen, erased, exists): heavy keys by broadcast, the others by a shuffled join."""
    light = refs.filter(~F.col("key").isin(heavy)) if heavy else refs
    rest = light.join(_verdict(targets, erased), "key", "left")
    if not heavy:
        return rest
    few = F.col("key").isin(heavy)  # fewer than the shares, and one verdict row for each: small at any size of the data
    return rest.unionByName(refs.filter(few).join(F.broadcast(_verdict(targets.filter(few), erased.filter(few))), "key", "left"))


def orphans(refs: DataFrame, targets: DataFrame, erased: DataFrame, *, shares: int = SHARES) -> DataFrame:
    """Referring rows without a target in time: (src_table, row_id, arrival, state).

    ``refs`` as :func:`references` gives them; ``targets`` (key, arrival), one row per delivery of a record;
    ``erased`` (key). state is ``late`` if targets exist but all arrived after the reference, ``erased`` if
    none exists and the key is listed as erased, else ``missing``.

    Null keys on either side match nothing. A target without an arrival counts as there from the start, and
    a reference without an arrival as later than everything; so neither is late. Repeated rows stay repeated.
    Empty inputs give an empty result, or all references as missing. Columns besides those named are ignored.
    """
    targets, erased = _sides(targets, erased)
    refs = refs.select("src_table", "row_id", "key", "arrival").filter("key IS NOT NULL")
    heavy = heavy_keys(refs.groupBy("key").agg(F.count("*").alias("n")), refs.count(), shares)
    state = F.when(F.col("exists"), F.when(F.col("first_seen") > F.col("arrival"), "late")).when(F.col("erased"), "erased").otherwise("missing")
    return _split(refs, targets, erased, heavy).select("src_table", "row_id", "arrival", state.alias("state")).filter("state IS NOT NULL")


def orphan_counts(refs: DataFrame, targets: DataFrame, erased: DataFrame, period: Column, *, shares: int = SHARES) -> DataFrame:
    """Orphans per table, period and state: (src_table, period, state, orphans), the same rows as :func:`orphans`, counted.

    ``period`` is an expression over arrival. References without an arrival have period null.
    """
    targets, erased = _sides(targets, erased)
    refs = refs.select("src_table", "key", "arrival", period.alias("period")).filter("key IS NOT NULL")
    groups = cut_lineage(
        refs.groupBy("src_table", "key", "period").agg(
            F.count("*").alias("n"), F.count("arrival").alias("timed"), F.min("arrival").alias("first"), F.max("arrival").alias("last")
        )
    )
    heavy = heavy_keys(groups, groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], shares)
    few = F.col("key").isin(heavy)
    c = F.col

    def counted(part: DataFrame, rows: DataFrame, targets: DataFrame, erased: DataFrame, small: bool) -> DataFrame:
        hint = F.broadcast if small else (lambda df: df)
        seen = hint(targets.groupBy("key").agg(F.min("arrival").alias("first_seen")))
        # No target at all: the anti-join. The state is the key's, so whole groups count.
        absent = part.join(seen, "key", "left_anti").join(hint(erased.distinct().withColumn("erased", F.lit(True))), "key", "left")
        absent = absent.select("src_table", "period", F.when(c("erased"), "erased").otherwise("missing").alias("state"), "n")
        # Targets that were late for a group's first reference: for all of them, or for those before it.
        behind = part.join(seen, "key").filter(c("first_seen") > c("first"))
        whole = behind.filter(c("first_seen") > c("last")).select("src_table", "period", F.lit("late").alias("state"), c("timed").alias("n"))
        straddling = behind.filter(c("first_seen") <= c("last")).select("src_table", "key", "period", "first_seen")
        match = (c("r.src_table") == c("s.src_table")) & (c("r.key") == c("s.key")) & c("r.period").eqNullSafe(c("s.period")) & (c("arrival") < c("first_seen"))
        some = rows.alias("r").join(hint(straddling).alias("s"), match).select("r.src_table", "r.period", F.lit("late").alias("state"), F.lit(1).cast("bigint").alias("n"))
        return absent.unionByName(whole).unionByName(some)

    out = counted(groups.filter(~few), refs.filter(~few), targets, erased, False) if heavy else counted(groups, refs, targets, erased, False)
    if heavy:
        out = out.unionByName(counted(groups.filter(few), refs.filter(few), targets.filter(few), erased.filter(few), True))
    return out.groupBy("src_table", "period", "state").agg(F.sum("n").alias("orphans"))
