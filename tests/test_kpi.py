from datetime import timedelta

import pytest

from sondage.plans import kpi, scorecard, snapshot
from sondage.sources.audit import in_window
from tests.trail import T0, audit, event, events, rec, traffic


@pytest.fixture(scope="module")
def computed(spark):
    a, e = traffic()
    r, b = kpi.compute(kpi.Inputs(audit(spark, a), events(spark, e), 5))
    return {x.kpi: x for x in r.collect()}, {(x.kpi, x.dim, x.member): x for x in b.collect()}


EXPECTED = {
    "K-01": 1 / 60 * 1e4, "K-02": 1 / 60 * 1e4, "K-04": 0.5, "K-05": 20.0, "K-06": 1.0, "K-07": (0.03 + 59 * 0.01) / 60 * 1000, "K-08": 62 / 60, "K-09": 0.59, "K-10": 1 / 60, "K-11": 1 / 15, "K-13": 1.0,
    "K-15": 1.0, "K-16": 1.0, "K-17": 1.0, "K-18": 0.03, "K-19": 59 / 60, "K-20": 1 / 60 * 1e4, "K-21": 2 / 60, "K-22": 6 / 54, "K-23": 40 / 60, "K-24": 2 / 17, "K-26": 0.5, "K-27": 0.4, "K-28": 0.3, "K-29": 0.6 / 0.9,
}


def test_values(computed):
    r, b = computed
    approved_low = sum(1 for i in range(60) if i % 10 and i % 5 == 0)
    assert r["K-22"].value == pytest.approx(approved_low / 54)
    for k, v in EXPECTED.items():
        if k != "K-22":
            assert r[k].value == pytest.approx(v), k
    assert r["K-11"].n == 15 and r["K-25"].value is not None and r["K-12"].value is None and r["K-14"].note == "audit key not supplied"
    assert r["K-06"].status == "green" and "without human confirmation" in r["K-17"].note and "projected exhaustion" in r["K-09"].note
    assert b["K-03", "language", "sw"].value is not None
    h = b["K-04", "topic", "hard_history"]
    assert (h.n, h.value, h.suppressed) == (1, None, True)


def test_empty_and_window(spark):
    r, b = kpi.compute(kpi.Inputs(audit(spark, []), events(spark, []), 5), rules=(1.0, 0, "no community rules"))
    got = {x.kpi: x.value for x in r.collect()}
    assert len(got) == 29 and b.count() == 0
    assert {k for k, v in got.items() if v is not None} == {"K-12", "K-17"}
    a, e = traffic()
    late = in_window(audit(spark, a), T0 + timedelta(hours=30))
    assert {x.kpi: x.n for x in kpi.compute(kpi.Inputs(late, events(spark, e), 5))[0].collect()}["K-01"] == 30


def test_dirty_rows(spark):
    rows = [rec(1, energy={"estimated_kwh": float("nan")}), rec(1, energy={"estimated_kwh": -1.0}), rec(2), dict(audit_id=None, timestamp=T0, kind="decision", status="APPROVED"), dict(audit_id=" ", timestamp=None, kind="decision"), dict(kind=None)]
    r = {x.kpi: x for x in kpi.compute(kpi.Inputs(audit(spark, rows), events(spark, [event("escaped_harm"), event("appeal_outcome", upheld=None)]), 5))[0].collect()}
    assert r["K-01"].n == 5 and r["K-07"].value == 0.0 and r["K-02"].value == 0.0 and r["K-04"].value == 0.0


def test_groups_are_separate_and_events_find_theirs(spark):
    a = [rec(i, i, labels={"model": "m1" if i % 2 else "m2"}, status="BLOCKED" if i % 4 == 0 else "APPROVED") for i in range(40)]
    e = [event("escaped_harm", audit_id="a1"), event("escaped_harm", audit_id="zz"), event("redteam_result", attempts=10, evasions=1, model="m2"), event("redteam_result", attempts=10, evasions=5)]
    r = {(x.g, x.kpi): x for x in kpi.compute(kpi.Inputs(audit(spark, a), events(spark, e), 5, "model"))[0].collect()}
    assert len(r) == 58 and (r["m1", "K-02"].value, r["m2", "K-02"].value) == (500.0, 0.0)
    assert r["m2", "K-18"].value == 0.1 and r["m1", "K-18"].n == 0


def test_scorecards(spark):
    def model(name, n, harms):
        return [rec(f"{name}{i}", i, labels={"model": name, "language": "en" if i % 2 else "sw", "task_class": "x"}, completion_digest=f"d{i}", confirmed_tier3=i < harms, governance_metadata={"seed_stock": {"agency": 1.0}}) for i in range(n)]

    a = model("good", 200, 0) + model("harmful", 200, 10) + model("tiny", 5, 0)
    e = [event("redteam_result", attempts=100, evasions=1, model=m) for m in ("good", "harmful")] + [event("human_override", audit_id=f"good{i}") for i in range(0, 200, 10)]
    cards = {c.model: c for c in scorecard.scorecards(kpi.Inputs(audit(spark, a), events(spark, e), 20, "model")).collect()}
    assert list(cards)[-1] == "tiny" and cards["tiny"].grade is None and cards["good"].grade in "AB"
    assert cards["harmful"].grade >= "C" and cards["harmful"].caps == ["confirmed serious harm"]


def test_snapshot(spark):
    a, e = traffic()
    doc = snapshot.build(audit(spark, a), events(spark, e), T0 + timedelta(days=40), delay_days=30, k=20)
    shown = {x["id"]: x for x in doc["kpis"]}
    cells = {(x["id"], c): v for x in doc["kpis"] for c, v in x["breakdown"].items()}
    assert shown["K-04"]["n_band"] == "suppressed" and shown["K-04"]["value"] is None and shown["K-01"]["value"] is not None and len(shown["K-01"]["ci"]) == 2
    assert not any(c.split(":")[0] in snapshot.COMMUNITY_DIMS for _, c in cells) and all(v["value"] is None for (k, _), v in cells.items() if k == "K-17")
    assert all(not set(x) & {"subject", "detail", "evidence"} for x in doc["alerts"]) and set(snapshot.schema()["required"]) == set(doc)
    shared = snapshot.build(audit(spark, a), events(spark, e), T0 + timedelta(days=40), k=5, policy={"governance": {"publication_consent": True}})
    assert shared["community_breakdowns"] and any(c.startswith("language:") for x in shared["kpis"] for c in x["breakdown"]) and shared["delay_days"] == 7
    early = snapshot.build(audit(spark, a), events(spark, e), T0 + timedelta(days=1), delay_days=30, k=20)
    assert {x["id"] for x in early["kpis"] if x["value"] is not None} <= {"K-12", "K-17"} and early["alerts"] == [] and early["models"] == []
