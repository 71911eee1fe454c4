import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sondage.operators import state
from sondage.streaming import live

T0 = datetime(2026, 1, 1)
REQUESTS = "seq bigint, tenant string, ts timestamp, kwh double, principal string, violation boolean"


@pytest.fixture()
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(rows, schema, build, mode="append", batches=3):
        src, out = tmp_path / "src", []
        src.mkdir(exist_ok=True)
        step = -(-len(rows) // batches)
        names = [c.strip().split()[0] for c in schema.split(",")]
        for i in range(batches):
            (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(names, r)), default=lambda t: t.isoformat()) for r in rows[i * step : (i + 1) * step]))
            os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by age
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        q = build(df).writeStream.outputMode(mode).foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return out

    return run


def requests(n=60):
    rng = random.Random(2)
    return [(i, rng.choice("ab"), T0 + timedelta(seconds=i), rng.choice([0.2, 0.5]), f"p{i % 3}", rng.random() < 0.4) for i in range(n)]


def test_budget_stream_equals_batch(spark, stream):
    rows = requests()
    got = {r.seq: (r.admitted, round(r.used, 9)) for r in stream(rows, REQUESTS, lambda d: live.budget_stream(d, 3.0))}
    want = {r.seq: (r.admitted, round(r.used, 9)) for r in state.budget(spark.createDataFrame(rows, REQUESTS), 3.0).collect()}
    assert got == want


def test_breaker_stream_equals_batch(spark, stream):
    rows, settings = requests(), dict(threshold=3, principals=2, window_s=8.0, cooldown_s=6.0)
    got = {r.seq: (r.admission, r.state) for r in stream(rows, REQUESTS, lambda d: live.breaker_stream(d, "tenant", **settings))}
    want = {r.seq: (r.admission, r.state) for r in state.breaker(spark.createDataFrame(rows, REQUESTS), "tenant", **settings).collect()}
    assert got == want and len({s for _, s in want.values()}) > 1


def test_rolling_rates_drop_late_rows(stream):
    schema = "timestamp timestamp, kind string, status string, confirmed_tier3 boolean, near_miss boolean"
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(at(5), "decision", "BLOCKED", False, True), (at(20), "decision", "APPROVED", True, False), (at(30), "energy", "METERED", None, None), (at(300), "decision", "APPROVED", None, None), (at(310), "decision", "APPROVED", None, None), (at(10), "decision", "APPROVED", True, True), (at(600), "decision", "APPROVED", None, None)]
    got = [(r.n, r.confirmed, r.near, r.refused) for r in stream(rows, schema, lambda d: live.rolling_rates(d), batches=7) if r.start == T0]
    assert got == [(2, 1, 1, 1)]


def test_fan_out_counts_failures(spark, tmp_path):
    seen = []

    def broken(batch, _):
        raise OSError("full")

    fan = live.FanOut(broken, live.jsonl_sink(str(tmp_path / "j")), live.table_sink(str(tmp_path / "t")), live.log_sink, lambda b, i: seen.append(b.select("sink_failures").first()[0]))
    df = spark.createDataFrame([("a", "APPROVED")], "audit_id string, status string")
    fan(df, 0), fan(df, 1)
    assert seen == [0, 1] and fan.failures == 2 and spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_monitor_sink_tells_each_alert_once(spark):
    from sondage.plans import monitors
    from tests.trail import audit, events, rec

    a = audit(spark, [rec(0, 10, sink_failures=1), rec(1, 5)])
    told = []
    sink = live.MonitorSink(lambda: (a, events(spark, [])), told.append, {"CA-6": monitors.AGENTS["CA-6"]})
    sink(a, 0), sink(a, 1)
    assert len(told) == 1 and {x.code for x in told[0]} == {"AUDIT_SINK_FAILURES", "AUDIT_CLOCK_SKEW"}
    assert F is not None
