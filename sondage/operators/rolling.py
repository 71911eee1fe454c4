"""Rolling totals over trailing periods, also for days without activity.

Method: records are summed per entity and day; the days are cut into tiles, and each tile also receives the
days just before it (the halo), as many as the longest span needs. Within a tile, entities are packed by days
into dense numpy blocks of a bounded size, and one multiplication by a banded 0/1 matrix gives all spans at once.
An entity has at most tile + halo rows in a tile, so no key is ever hot after the daily sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days in a tile, and entities in a dense block.
TILE_DAYS = 64
BLOCK = 512

SCHEMA = "entity string, day int, span_days bigint, records bigint, total double, active boolean"


def daily(df: DataFrame, entity: Column, ts: Column, value: Column, counted: Column) -> DataFrame:
    """(entity, day, records, total): the counted records per entity and day since 1970, UTC.

    Values that are infinite or no numbers make the total of their day so, and of the spans that hold it, no others.
    """
    day = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")
    return (
        df.filter(counted)
        .select(entity.alias("entity"), day.alias("day"), value.cast("double").alias("value"))
        .filter("entity IS NOT NULL AND day IS NOT NULL")
        .groupBy("entity", "day")
        .agg(F.count("*").alias("records"), F.sum("value").alias("total"))
    )


def band(spans: Sequence[int], halo: int, tile: int) -> np.ndarray:
    """(halo + tile) x (tile * spans): column (d, s) adds the spans[s] days that end with day d of the tile."""
    out = np.zeros((halo + tile, tile, len(spans)))
    for k, span in enumerate(spans):
        for d in range(tile):
            out[halo + d - span + 1 : halo + d + 1, d, k] = 1
    return out.reshape(halo + tile, -1)


def _blocks(batches: Iterator[pa.RecordBatch], spans: tuple[int, ...], last: int, tile: int, block: int, quiet: bool) -> Iterator[pa.RecordBatch]:
    halo = max(spans) - 1
    banded = band(spans, halo, tile)
    rest: pa.Table | None = None

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (tile, entity), whole pairs only."""
        no = t["tile_no"].to_numpy()
        entity = t["entity"].combine_chunks().dictionary_encode()
        code = entity.indices.to_numpy(zero_copy_only=False)
        new = np.r_[True, (no[1:] != no[:-1]) | (code[1:] != code[:-1])]
        row, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        col = t["day"].to_numpy() - (no * tile - halo)
        for a in range(0, len(starts), block):
            b = min(a + block, len(starts))
            lo, hi = starts[a], starts[b] if b < len(starts) else len(no)
            sums, counts = np.zeros((b - a, halo + tile)), np.zeros((b - a, halo + tile))
            total = t["total"].to_numpy()[lo:hi]
            finite = np.isfinite(total)
            sums[row[lo:hi] - a, col[lo:hi]] = np.where(finite, total, 0.0)
            counts[row[lo:hi] - a, col[lo:hi]] = t["records"].to_numpy()[lo:hi]
            shape = (b - a, tile, len(spans))
            n, s = (counts @ banded).reshape(shape), (sums @ banded).reshape(shape)
            if not finite.all():  # days that aren't finite are counted by kind, since 0 times infinity is no number
                for value in (np.inf, -np.inf, np.nan):
                    odd = np.zeros_like(sums)
                    odd[row[lo:hi] - a, col[lo:hi]] = np.isnan(total) if value != value else total == value
                    if odd.any():
                        s = s + np.where((odd @ banded).reshape(shape) > 0.5, value, 0.0)
            busy = counts[:, halo:, None] > 0
            day = no[starts[a:b], None] * tile + np.arange(tile)
            keep = (n > 0) & (day <= last)[:, :, None] & ~(busy & quiet)
            i, d, k = np.nonzero(keep)
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [
                        entity.dictionary.take(pa.array(code[starts[a:b]][i])).cast(pa.string()),
                        pa.array(day[i, d].astype(np.int32)),
                        pa.array(np.array(spans, dtype=np.int64)[k]),
                        pa.array(np.rint(n[i, d, k]).astype(np.int64)),
                        pa.array(s[i, d, k]),
                        pa.array(busy[i, d, 0]),
                    ],
                    names=["entity", "day", "span_days", "records", "total", "active"],
                )

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        # The last (tile, entity) may go on in the next batch.
        no, e = t["tile_no"], t["entity"]
        cut = t.num_rows - 1
        last_no, last_e = no[cut].as_py(), e[cut].as_py()
        while cut and no[cut - 1].as_py() == last_no and e[cut - 1].as_py() == last_e:
            cut -= 1
        rest = t.slice(cut)
        if cut:
            yield from emit(t.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield from emit(rest)


def rolling(days: DataFrame, spans: Sequence[int], last_day: int, *, tile: int = TILE_DAYS, block: int = BLOCK, quiet: bool = False) -> DataFrame:
    """Totals over the trailing ``spans`` days, the day itself included, up to ``last_day``.

    ``days`` as :func:`daily` gives it. A row for each entity, day and span with at least one record in the
    span: (entity, day, span_days, records, total, active); active tells whether the day itself has records.
    With ``quiet`` only days without records come out. Totals are sums of daily sums as doubles; an empty
    input gives an empty result; days after ``last_day`` and spans below 1 are left out; other columns are ignored.
    """
    spans = tuple(sorted({int(s) for s in spans if s >= 1}))
    if not spans:
        return days.sparkSession.createDataFrame([], SCHEMA)
    halo = max(spans) - 1
    # A day belongs to its own tile and to all those within the halo after it, none of them past the last day.
    first, final = F.floor(F.col("day") / F.lit(tile)), F.floor(F.least(F.col("day") + halo, F.lit(last_day)) / F.lit(tile))
    placed = days.filter(F.col("day") <= last_day).select(
        "entity", "day", "records", "total", F.explode(F.sequence(first.cast("int"), final.cast("int"))).alias("tile_no")
    )
    placed = placed.repartition("entity", "tile_no").sortWithinPartitions("tile_no", "entity")
    return placed.mapInArrow(lambda it: _blocks(it, spans, last_day, tile, block, quiet), SCHEMA)


def with_averages(totals: DataFrame) -> DataFrame:
    """Adds the average per day of the span and per record."""
    return totals.withColumns({"per_day": F.col("total") / F.col("span_days"), "per_record": F.col("total") / F.col("records")})


def last_day(df: DataFrame, ts: Column) -> int | None:
    """The last UTC day, since 1970, of a table; null if it has none. One number comes back."""
    top = df.agg(F.max(F.unix_micros(ts)).alias("t")).first()["t"]
    return None if top is None else top // 86_400_000_000
