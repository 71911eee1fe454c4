from datetime import timedelta

from pyspark.sql import functions as F

from sondage.functions import stats
from sondage.plans import monitors as m
from tests.trail import T0, audit, event, events, rec

DAY = 24 * 60


def codes(spark, agent, records, evs=(), now=None, **kw):
    o = m.observe(audit(spark, records), events(spark, list(evs)), now or T0 + timedelta(days=30))
    return [r.code for r in m.AGENTS[agent](o, **kw).collect()]


def test_breaker_precursor(spark):
    now = T0 + timedelta(minutes=59)
    two = [rec(i, 50, principal_digest="x", confirmed_tier3=True) for i in range(2)] + [rec(9 + i, 51, principal_digest="x", near_miss=True) for i in range(3)]
    assert codes(spark, "CA-1", two, now=now) == ["PRINCIPAL_TRIP_LIKELY"]
    many = [rec(i, 30 + i % 20, principal_digest=f"p{i % 4}", confirmed_tier3=True) for i in range(30)]
    assert "GLOBAL_TRIP_LIKELY" in codes(spark, "CA-1", many, now=now)
    assert codes(spark, "CA-1", [rec(i, 58, confirmed_tier3=True) for i in range(5)], now=now) == []
    assert codes(spark, "CA-1", [rec(1)], now=now) == []


def test_energy(spark):
    burn = [rec(i, i * DAY, energy={"budget_used_kwh": float(i), "budget_remaining_kwh": 10.0 - i}) for i in range(8)]
    assert codes(spark, "CA-2", burn, now=T0 + timedelta(days=8)) == ["BUDGET_EXHAUSTION_FORECAST"]
    low = [rec(i, i, kind="energy", energy={"estimated_kwh": 1.0, "actual_kwh": 3.0}) for i in range(40)]
    assert codes(spark, "CA-2", low) == ["ENERGY_UNDER_REPORTING"]
    rise = [rec(i, i * 60, energy={"carbon_intensity_g_kwh": 100.0 + 4 * i}) for i in range(50)]
    assert codes(spark, "CA-2", rise) == ["CARBON_INTENSITY_RISING"]
    assert codes(spark, "CA-2", [rec(1, energy={"estimated_kwh": 1.0})]) == []


def test_drift(spark):
    def days(rate):
        return [rec(d * 100 + i, d * DAY + i, near_miss=i < rate(d)) for d in range(20) for i in range(100)]

    now = T0 + timedelta(days=20)
    assert codes(spark, "CA-3", days(lambda d: 1 if d < 7 else 1 + 0.6 * (d - 6)), now=now) == ["NEAR_MISS_DRIFT"]
    assert codes(spark, "CA-3", days(lambda d: 2), now=now) == []
    assert codes(spark, "CA-3", days(lambda d: 2 if d < 10 else 30), now=now) == []


def test_over_blocking(spark):
    rows = [rec(i, i, labels={"language": "sw"}) for i in range(30)] + [rec(100 + i, 29 * DAY, labels={"language": "sw"}, status="BLOCKED") for i in range(30)]
    evs = [event("canary_result", corpus="protected_speech", passed=27, total=28)] + [event("appeal_outcome", upheld=i < 10) for i in range(20)]
    assert sorted(codes(spark, "CA-4", rows, evs)) == ["APPEALS_OFTEN_UPHELD", "CANARY_FAILURE", "REFUSAL_SPIKE"]
    assert codes(spark, "CA-4", [rec(1)]) == []


def test_integrity_timeouts_consent_simulation(spark):
    rows = [rec(0, 10, sink_failures=2), rec(1, 5, governance_metadata={"rule_timeouts": ["R"]})]
    assert sorted(codes(spark, "CA-6", rows)) == ["AUDIT_CLOCK_SKEW", "AUDIT_SINK_FAILURES"] and codes(spark, "CA-5", rows) == ["RULE_TIMEOUT"]
    assert codes(spark, "CA-6", [rec(0), rec(1, 1)]) == [] and codes(spark, "CA-6", [rec(0)], broken=1) == ["AUDIT_CHAIN_BROKEN"]
    acts = [rec(i, i, governance_metadata={"community_action": True}) for i in range(20)]
    evs = [event("consent_verified", audit_id=f"a{i}") for i in range(10)] + [event("consent_revoked", revoked_at=T0 + timedelta(days=30) - timedelta(hours=h)) for h in (60, 80, 1)]
    assert sorted(codes(spark, "CA-7", acts, evs)) == ["CONSENT_UNVERIFIED", "REVOCATION_DUE_SOON", "REVOCATION_OVERDUE"]
    like = [rec(i, i, governance_metadata={"policy_like": True}) for i in range(3)]
    assert codes(spark, "CA-8", like) == ["SIMULATION_SKIPPED"] and codes(spark, "CA-8", like[:2]) == []


def test_incidents_and_cohorts(spark):
    one = [rec(1, confirmed_tier3=True)]
    assert [codes(spark, "CA-9", one, now=T0 + timedelta(days=d)) for d in (0.04, 13, 16)] == [[], ["INCIDENT_DUE_SOON"], ["INCIDENT_OVERDUE"]]
    assert codes(spark, "CA-9", one, [event("incident_reported", audit_id="a1")], T0 + timedelta(days=16)) == []

    def cohort(rate):
        return [rec(d * 100 + i, d * DAY + i, labels={"cohort": "c"}, capability={"context": "learning", "mode": "scaffold" if i < rate(d) else "substitute"}) for d in range(12) for i in range(100)]

    assert codes(spark, "CA-10", cohort(lambda d: 90 - 3 * d), now=T0 + timedelta(days=12)) == ["SCAFFOLDING_DECLINING"]
    assert codes(spark, "CA-10", cohort(lambda d: 70), now=T0 + timedelta(days=12)) == []


def test_diversity_precursors_extraction(spark):
    rows = [rec(i, i, labels={"language": "en"}) for i in range(30)] + [rec(50 + i, i, labels={"language": "sw"}, status="BLOCKED") for i in range(30)] + [rec(200 + i, 20 * DAY + i * 60, labels={"language": "en"}) for i in range(200)]
    got = codes(spark, "CA-11", rows, [event("policy_change", 24 * 10)])
    assert got.count("REFUSAL_DISPARITY") == 1 and "SILENT_EXCLUSION" in got

    def signals(stages):
        return [rec(i, 25 * DAY + i, code={3: "RELATIONAL_SCORING", 4: "HUMAN_WORTH_RANKING"}[s]) for i, s in enumerate(stages)]

    assert codes(spark, "CA-12", signals([3, 3, 3, 4, 4, 4])) == ["ATROCITY_PRECURSOR_ESCALATION"] and codes(spark, "CA-12", signals([3, 3, 3])) == []
    flows = [event("value_flow", 24 * d, region="A", extracted=100.0, returned=90.0 - 4 * d) for d in range(11)] + [event("value_flow", region="B", extracted=100.0, returned=10.0), event("capacity", region="B", local_share=0.05)]
    assert sorted(codes(spark, "CA-13", [rec(1)], flows)) == ["LOW_LOCAL_CAPACITY", "VALUE_RETURN_GAP", "VALUE_RETURN_GAP"]


def test_all_on_empty_input_and_public_view(spark):
    o = m.observe(audit(spark, []), events(spark, []))
    assert m.assess(o).count() == 0
    assert not set(m.RESTRICTED) & set(m.public(m.assess(o)).columns)


def test_statistics(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert tuple(v(F.array(*stats.wilson(F.lit(0), F.lit(0))))) == (0.0, 1.0)
    lo, hi = v(F.array(*stats.wilson(F.lit(5), F.lit(100))))
    assert 0.02 < lo < 0.05 < hi < 0.12
    assert v(stats.poisson_tail(F.lit(0), F.lit(1))) == 0 and v(stats.poisson_tail(F.lit(3), F.lit(0))) == 1
    assert abs(v(stats.poisson_tail(F.lit(2), F.lit(3))) - (1 - 5 * 2.718281828459045**-2)) < 1e-12
    rate = lambda x, k: v(stats.rating(F.lit(x), *k))
    low, high, band = ("lower", 1.0, 5.0), ("higher", 0.95, 0.8), ("band", (0.4, 0.8), (0.25, 0.9))
    assert [rate(x, low) for x in (0.5, 3.0, 9.0)] == ["green", "amber", "red"] and [rate(x, high) for x in (0.99, 0.5)] == ["green", "red"]
    assert [rate(x, band) for x in (0.6, 0.3, 0.1)] == ["green", "amber", "red"] and rate(1.0, ("info", None, None)) == "info"
    assert v(stats.rating(F.lit(None).cast("double"), *low)) == "insufficient_data"
    assert abs(v(stats.ewma(F.array(F.lit(1.0), F.lit(2.0)), 0.3)) - 1.3) < 1e-12 and v(stats.ewma(F.array().cast("array<double>"), 0.3)) is None
    pts = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 1.0), ("b", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "g string, x double, y double")
    t = {r.g: r.slope for r in stats.trend(pts, ["g"], "x", "y").collect()}
    assert t["a"] is None and t["c"] is None and abs(t["b"] - 1) < 1e-12
    assert v(stats.crossing(F.lit(1.0), F.lit(0.0), 0.5, F.lit(2.0), False)) is None and v(stats.crossing(F.lit(1.0), F.lit(0.0), 5.0, F.lit(2.0), True)) == 5.0
