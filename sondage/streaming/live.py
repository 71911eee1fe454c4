"""The same operators on streams: windows with a watermark, state per key, micro-batches to many sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sondage.functions.stats import ratio, wilson
from sondage.operators.state import Breaker, admit

log = logging.getLogger(__name__)


def rolling_rates(decisions: DataFrame, by: Sequence[str] = (), window: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Decisions, confirmed harms, near misses and refusals in windows of event time; rows later than ``late`` are left out."""
    confirmed = F.coalesce("confirmed_tier3", F.lit(False))
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    out = decisions.filter("kind = 'decision'").withWatermark("timestamp", late).groupBy(w.alias("w"), *by).agg(
        F.count("*").alias("n"), F.count_if(confirmed).alias("confirmed"), F.count_if(F.coalesce("near_miss", F.lit(False))).alias("near"),
        F.count_if((F.col("status") == "BLOCKED") & ~confirmed).alias("refused"),
    )
    low, high = wilson(F.col("confirmed"), F.col("n"))
    return out.select("w.start", "w.end", *by, "n", "confirmed", "near", "refused", ratio(F.col("confirmed"), F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


class BudgetProcessor(StatefulProcessor):
    """Admits requests of a key until its budget is used; rows of a batch in order of (ts, seq)."""

    def __init__(self, limit: float) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        used = self.used.get()[0] if self.used.exists() else 0.0
        d = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        out = []
        for seq, kwh in zip(d["seq"], d["kwh"].fillna(0.0).clip(lower=0.0)):
            ok, used = admit(used, float(kwh), self.limit)
            out.append((key[0], seq, ok, used))
        self.used.update((used,))
        yield pd.DataFrame(out, columns=["key", "seq", "admitted", "used"])

    def close(self) -> None:
        pass


def budget_stream(requests: DataFrame, limit: float, key: str = "tenant") -> DataFrame:
    """Streaming :func:`sondage.operators.state.budget` over (key, ts, seq, kwh); needs the RocksDB state store."""
    d = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "ts", "seq", "kwh")
    return d.groupBy("key").transformWithStateInPandas(BudgetProcessor(limit), "key string, seq bigint, admitted boolean, used double", "Append", "None")


class BreakerProcessor(StatefulProcessor):
    """A breaker for each key; its state is kept between batches as one row."""

    def __init__(self, **settings: float) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("breaker", "state string, opened_at double, times array<double>, callers array<string>, names array<string>, since array<double>, probation array<string>, trips int, reason string")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        b = Breaker(**self.settings)
        if self.kept.exists():
            b.state, b.opened_at, times, callers, names, since, probation, b.trips, b.reason = self.kept.get()
            b.probation = list(probation)
            b.hits.extend(zip(times, callers))
            b.suspended = dict(zip(names, since))
        d = pd.concat(list(rows), ignore_index=True).sort_values(["t", "seq"], kind="stable")
        out = []
        for seq, t, who, bad in zip(d["seq"], d["t"], d["who"], d["bad"]):
            verdict = b.admit(t, who)
            if verdict == "ALLOW":
                b.violation(t, who) if bad else b.success(t)
            out.append((key[0], seq, verdict, b.state))
        self.kept.update((b.state, b.opened_at, [h[0] for h in b.hits], [h[1] for h in b.hits], list(b.suspended), list(b.suspended.values()), b.probation, b.trips, b.reason))
        yield pd.DataFrame(out, columns=["key", "seq", "admission", "state"])

    def close(self) -> None:
        pass


def breaker_stream(rows: DataFrame, key: str, **settings: float) -> DataFrame:
    """Streaming :func:`sondage.operators.state.breaker` over (key, ts, seq, principal, violation)."""
    d = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
                    F.coalesce("principal", F.lit("anonymous")).alias("who"), F.coalesce("violation", F.lit(False)).alias("bad"))
    return d.groupBy("key").transformWithStateInPandas(BreakerProcessor(**settings), "key string, seq bigint, admission string, state string", "Append", "None")


Sink = Callable[[DataFrame, int], None]


class FanOut:
    """A foreachBatch function that writes to several sinks. One that fails is counted, not raised, and the count goes into the next batch's records."""

    def __init__(self, *sinks: Sink) -> None:
        self.sinks, self.failures = sinks, 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("sink_failures", F.lit(self.failures)).persist()
        try:
            for sink in self.sinks:
                try:
                    sink(batch, batch_id)
                except Exception:
                    self.failures += 1
                    log.exception("a sink failed")
        finally:
            batch.unpersist()


def jsonl_sink(path: str) -> Sink:
    return lambda batch, _: batch.write.mode("append").json(path)


def table_sink(path: str) -> Sink:
    return lambda batch, _: batch.write.mode("append").parquet(path)


def log_sink(batch: DataFrame, batch_id: int) -> None:
    """One line for each batch, with its counts by status."""
    log.info("batch %s: %s", batch_id, {r["status"]: r["count"] for r in batch.groupBy("status").count().collect()})


class MemorySink:
    """Keeps the rows of its batches in the driver: for tests and small feeds."""

    def __init__(self) -> None:
        self.records: list[dict] = []

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.records += [r.asDict(recursive=True) for r in batch.toLocalIterator()]


class MonitorSink:
    """Runs the monitors over the accumulated trail, every ``every`` records, and hands on alerts that were not seen before.

    ``history`` gives the accumulated (audit, events); alerts are the same if agent, code and title are. What was seen is kept
    in the table ``seen`` (a shared path) if one is given, so that a restart does not repeat alerts, else in the driver. One
    row for each (agent, code, title) comes to the driver, with the number of its alerts: a few dozen at any size of the trail.
    """

    def __init__(self, history: Callable[[], tuple[DataFrame, DataFrame]], on_alert: Callable[[list], None], agents: dict | None = None, every: int = 1, seen: str | None = None) -> None:
        self.history, self.on_alert, self.agents, self.every, self.path = history, on_alert, agents, every, seen
        self.waiting, self.seen = 0, set()

    def _known(self, spark) -> set:  # noqa: ANN001
        if self.path and not self.seen:
            try:
                self.seen = {tuple(r) for r in spark.read.json(self.path, "agent string, code string, title string").collect()}
            except Exception:  # no table yet
                log.debug("no alerts seen before")
        return self.seen

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from sondage.plans import monitors

        if self.every > 1:
            self.waiting += batch.count()
            if self.waiting < self.every:
                return
            self.waiting = 0
        spark = batch.sparkSession
        alerts = monitors.assess(monitors.observe(*self.history()), self.agents)
        kinds = alerts.groupBy("agent", "code", "title").agg(F.min("severity").alias("severity"), F.count("*").alias("alerts"), F.max("raised_at").alias("raised_at"))
        known = self._known(spark)
        new = [a for a in kinds.orderBy("agent", "code", "title").collect() if (a.agent, a.code, a.title) not in known]
        if new:
            self.seen |= (names := {(a.agent, a.code, a.title) for a in new})
            if self.path:
                spark.createDataFrame(sorted(names), "agent string, code string, title string").coalesce(1).write.mode("append").json(self.path)
            self.on_alert(new)
