import json
import random
from datetime import datetime, timedelta

from sondage.operators import state as s

T0 = datetime(2026, 1, 1)


def test_budget_against_a_sequential_run(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randint(0, 50)), rng.choice([0.1, 0.6, None, float("nan"), -1.0]), rng.random() < 0.2) for i in range(200)]
    got = {r.seq: (r.admitted, round(r.used, 9)) for r in s.budget(spark.createDataFrame(rows, "seq bigint, tenant string, ts timestamp, kwh double, back boolean"), 1.5, refunded="back").collect()}
    used, want = {}, {}
    for i, tenant, ts, kwh, back in sorted(rows, key=lambda r: (r[2], r[0])):
        k = kwh if kwh and kwh > 0 else 0.0
        u = used.get(tenant, 0.0)
        fits = u + k <= 1.5
        u = u + k if fits else u
        want[i] = (fits, round(u, 9))
        used[tenant] = max(0.0, u - k) if fits and back else u
    assert got == want
    two = spark.createDataFrame([(1, "a", T0, 0.6), (2, "a", T0, 0.6)], "seq bigint, tenant string, ts timestamp, kwh double")
    assert sorted((r.admitted, r.used) for r in s.budget(two, 1.0).collect()) == [(False, 0.6), (True, 0.6)]
    assert s.budget(two.limit(0), 1.0).count() == 0


def test_throttle_and_reconciliation(spark):
    rows = [(1, "a", T0, 0.6), (2, "a", T0, 0.6), (3, "b", T0, None), (4, "a", T0, -1.0)]
    df = spark.createDataFrame(rows, "seq bigint, tenant string, ts timestamp, kwh double")
    assert {r.seq: (r.used, r.over) for r in s.throttle(df, 1.0).collect()} == {1: (0.6, False), 2: (1.2, True), 3: (0.0, False), 4: (1.2, True)}
    held = spark.createDataFrame([("x", 0.5), ("y", None), (None, 9.0)], "key string, kwh double")
    t = lambda i: T0 + timedelta(seconds=i)
    meters = [("x", t(1), 1, 0.7), ("x", t(2), 2, 0.4), ("x", t(3), 3, float("nan")), ("y", t(1), 4, 0.1), ("z", t(1), 5, 0.2), (None, t(1), 6, 1.0), ("x", t(4), 7, -1.0)]
    got = {r.seq: (round(r.delta, 9), r.held) for r in s.reconciled(held, spark.createDataFrame(meters, "key string, ts timestamp, seq bigint, actual double")).collect()}
    assert got == {1: (0.2, 0.7), 2: (-0.3, 0.4), 4: (0.1, 0.1), 5: (0.2, 0.2)}


def test_breaker_lifecycle():
    b = s.Breaker(threshold=3, principals=2, window_s=10, cooldown_s=100)
    b.violation(0, "x"), b.violation(1, "x")
    assert b.admit(1, "x") == "ALLOW"
    b.violation(2, "x")
    assert b.admit(2, "x") == "PRINCIPAL_SUSPENDED" and b.admit(2, "y") == "ALLOW" and b.state == "CLOSED"
    b.violation(3, "y")
    assert b.state == "OPEN" and b.admit(4, "z") == "GLOBAL_OPEN" and b.admit(104, "z") == "ALLOW" and b.state == "HALF_OPEN"
    b.violation(105, "z")
    assert b.state == "HALF_OPEN"
    b.violation(106, "w")
    assert b.state == "OPEN"
    b.admit(300, "z"), b.success(300)
    assert b.state == "CLOSED"
    c = s.Breaker(threshold=2, principals=1, window_s=10)
    c.violation(0, "a"), c.violation(10.0, "a")
    assert c.state == "OPEN"  # exactly at the window's end still counts
    c.reset()
    assert c.snapshot() == {"state": "CLOSED", "opened_at": 0.0, "in_window": 0, "callers": 0, "suspended": [], "trips": 1}


def test_breaker_replay_and_empty(spark):
    rows = [(i, T0 + timedelta(seconds=i), f"p{i % 4}", i < 6) for i in range(10)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, principal string, violation boolean")
    got = [r.admission for r in s.breaker(df).orderBy("seq").collect()]
    assert got[:5] == ["ALLOW"] * 5 and got[5:] == ["GLOBAL_OPEN"] * 5
    assert s.breaker(df.limit(0)).count() == 0


def test_chain(spark):
    key = b"k"
    recs = s.write_chain([{"audit_id": f"a{i}", "note": "é" * i} for i in range(7)], key)

    def report(rows, block=100_000):
        t = spark.createDataFrame([(i, json.dumps(x), x.get("prev_digest"), x.get("record_hmac")) for i, x in rows], "seq bigint, raw string, prev_digest string, record_hmac string")
        return s.chain_report(s.verify_chain(t, key)), sorted(r.seq for r in s.links(t, block).filter("NOT linked").collect())

    whole = list(enumerate(recs))
    assert report(whole) == ({"verified": 7, "total": 7, "broken_at": []}, [])
    changed = [(i, dict(x, note="!") if i == 1 else x) for i, x in whole]
    assert report(changed)[0]["broken_at"] == [1]
    for block in (1, 2, 100):
        assert report([w for w in whole if w[0] != 3], block)[1] == [4] and report(whole[1:], block)[1] == [1]
    bad = spark.createDataFrame([(0, "{", None, None), (1, "[]", None, None)], "seq bigint, raw string, prev_digest string, record_hmac string")
    assert s.chain_report(s.verify_chain(bad, key))["verified"] == 0
