import json

import pytest

from sondage import cli, schemas
from sondage.plans import policy as p
from sondage.plans import snapshot
from sondage.sources import audit as a
from tests.trail import T0, rec, traffic

RULE = {"id": "OWN_RULE", "pattern": "sacred grove", "reason": "ours", "scope": "DATA_USE", "legal_basis": "by-law 3", "adopting_body_ref": "council"}
MINIMAL = {
    "tier_1_planetary_boundaries": {"max_compute_kwh_per_job": 5, "carbon_intensity_threshold_g_co2_kwh": 100},
    "tier_2_community_sovereignty": {"jurisdiction_id": "NO-03", "cultural_context_framework": "TILLIT"},
    "tier_3_inviolable_floor": {"allow_human_degradation_tradeoff": False, "allow_surveillance_coercion": False},
}
# A document of the size that communities use.
FULL = {
    "$schema": "policy.schema.json",
    "metadata": {"policy_id": "water", "version": "1.0.0", "issuer": "county", "instrument": "AU_CONVENTION", "effective_from": "2026-10-01"},
    "tier_1_planetary_boundaries": {"max_compute_kwh_per_job": 2.0, "carbon_intensity_threshold_g_co2_kwh": 250, "resource_exhaustion_circuit_breaker": True, "max_cumulative_kwh": 500, "max_water_liters_per_job": 5, "default_carbon_intensity_g_co2_kwh": 120},
    "tier_2_community_sovereignty": {"jurisdiction_id": "KE", "community_consent_required": True, "cultural_context_framework": "UBUNTU", "custom_rules": [RULE | {"unless": "council approv"}]},
    "tier_3_inviolable_floor": {"allow_human_degradation_tradeoff": False, "allow_surveillance_coercion": False, "allow_relational_scoring": False, "child_protection_override": True},
    "simulation": {"require_simulation_for_macro_policy": True, "runs": 64, "worst_case_floor": 0.3},
    "circuit_breaker": {"violation_threshold": 3, "window_seconds": 600, "cooldown_seconds": 1800, "min_principals": 3},
    "governance": {"fail_closed": True, "min_seed_stock_score": None, "judge_threshold": 0.5, "audit_include_text": False, "screen_prompts": False, "unscreenable_content": "block"},
}


def changed(doc, **sections):
    out = json.loads(json.dumps(doc))
    for section, keys in sections.items():
        out.setdefault(section, {}).update(keys)
    return out


def test_documents_and_their_errors():
    assert p.errors(MINIMAL) == [] and p.errors(FULL) == [] and p.errors([]) == [("", "not of type object")]
    bad = [
        changed(MINIMAL, tier_3_inviolable_floor={"allow_surveillance_coercion": True}), changed(MINIMAL, tier_3_inviolable_floor={"child_protection_override": False}),
        changed(MINIMAL, tier_2_community_sovereignty={"cultural_context_framework": "LAISSEZ_FAIRE"}), changed(MINIMAL, tier_1_planetary_boundaries={"max_compute_kwh_per_job": -1}),
        changed(MINIMAL, tier_1_planetary_boundaries={"unlimited": True}), changed(MINIMAL, governance={"judge_threshold": 1}), changed(MINIMAL, simulation={"runs": 2.5}),
        changed(MINIMAL, governance={"fail_closed": 1}), changed(MINIMAL, tier_2_community_sovereignty={"custom_rules": [RULE | {"scope": "TOPICS"}]}), changed(MINIMAL, circuit_breaker={"cooldown_seconds": float("nan")}),
    ]
    assert all(len(p.errors(d)) == 1 for d in bad)
    many = changed(MINIMAL, governance={"zz": 0, "fail_closed": 3}, nope={})
    del many["tier_3_inviolable_floor"]
    assert [e[0] for e in p.errors(many)] == ["", "governance/fail_closed", "governance/zz", "nope"]
    with pytest.raises(p.PolicyError) as e:
        p.validated(many)
    assert len(e.value.errors) == 4
    for pattern, message in (("([unclosed", "invalid regular expression"), (r"\bprotest", "protected speech"), (r"(?:a|aa)+$", "time limit")):
        found = p.errors(changed(MINIMAL, tier_2_community_sovereignty={"custom_rules": [RULE | {"pattern": pattern}]}))
        assert len(found) == 1 and message in found[0][1], pattern
    assert p.rules_share(changed(FULL, tier_2_community_sovereignty={"custom_rules": [RULE, RULE | {"pattern": "strike"}]})) == (0.5, 2, "")
    assert p.rules_share(MINIMAL)[2] == "no community rules" and p.rules_share(None)[0] is None
    limits = p.limits(FULL)
    assert (limits.max_kwh, limits.max_carbon, limits.consent_required, limits.budget_kwh, limits.custom[0].code, limits.custom[0].unless) == (2.0, 250, True, 500, "OWN_RULE", "council approv")
    assert p.limits(MINIMAL).cultural_context == "TILLIT" and p.limits({}).max_kwh == 100.0 and p.breaker_settings(FULL)["cooldown_s"] == 1800
    assert p.fingerprint(FULL) == p.fingerprint(dict(reversed(FULL.items()))) and p.schema()["properties"]["governance"]


def test_comparison(spark):
    assert p.compare(FULL, FULL) == []
    new = changed(FULL, governance={"fail_closed": False, "judge_threshold": 0.9, "unscreenable_content": "allow"}, circuit_breaker={"cooldown_seconds": 900}, metadata={"issuer": "someone else"})
    new["tier_2_community_sovereignty"]["custom_rules"].append(RULE | {"id": "RISKY", "pattern": "(ab+)+c"})
    codes = [f.code for f in p.compare(FULL, new)]
    assert codes.count("POLICY_RELAXATION") == 4 and {"ISSUER_CHANGED", "RISKY_PATTERN"} <= set(codes)
    assert [f.path for f in p.compare(new, FULL)] == ["metadata.issuer"]  # tighter is no finding
    censor = changed(FULL, tier_2_community_sovereignty={"custom_rules": [RULE | {"pattern": r"\bprotest"}]})
    assert [(f.code, f.severity) for f in p.compare(FULL, censor)] == [("POLICY_INVALID", "critical")]
    rows = [(1, json.dumps(FULL), json.dumps(new)), (2, json.dumps(FULL), json.dumps(FULL)), (3, None, json.dumps(MINIMAL)), (4, json.dumps(FULL), "{"), (5, "[]", None)]
    got = [(r.event_no, r.code) for r in p.review(spark.createDataFrame(rows, "event_no bigint, old string, new string")).collect()]
    assert {(no, c) for no, c in got if no > 1} == {(4, "POLICY_INVALID"), (4, "ISSUER_CHANGED"), (5, "POLICY_INVALID")} and sum(no == 1 for no, _ in got) == 6
    nested = {"(a+)+b": True, "((a+)b)*": True, r"(\w+\s?)*$": True, "(a{2,})*": True, "(ab)+": False, "[(a+)]+": False, r"a\(+b+": False, "(?:x|y?)+": False}
    assert {k: p.nested_repeats(k) for k in nested} == nested


def test_lines_and_records(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("\n".join(["", json.dumps({"audit_id": "x", "timestamp": "2026-01-01T00:00:00Z", "kind": "decision", "labels": {"model": "m"}, "extra": 1}), "   ", "broken {", json.dumps({"audit_id": "y", "status": None})]))
    rows = a.load_audit(spark, str(f)).orderBy("seq").collect()
    assert [r.audit_id for r in rows] == ["x", None, "y"] and rows[0].labels.model == "m" and rows[1].raw == "broken {" and rows[0].timestamp.year == 2026
    doc = tmp_path / "items.json"
    doc.write_text(json.dumps({"items": [{"category": "c", "text": "t"}], "other": 1}))
    assert [tuple(r) for r in a.items(spark, str(doc), "items", "category: string, text: string").collect()] == [("c", "t")]
    with pytest.raises(TypeError):
        a.as_dicts(["x"])
    got = a.from_records(spark, [rec(1), {"audit_id": "z"}], schemas.AUDIT).collect()
    assert [r.audit_id for r in got] == ["a1", "z"] and got[1].kind is None
    assert a.parse_time("2026-09-01T00:00:00") == a.parse_time("2026-09-01T02:00:00+02:00") == T0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    for name, doc in (("p", FULL), ("q", changed(FULL, governance={"judge_threshold": 5}))):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    good, bad = str(tmp_path / "p.json"), str(tmp_path / "q.json")
    assert cli.main(["validate-policy", good]) == 0 and cli.main(["validate-policy", good, bad]) == 1
    assert cli.main(["policy-diff", good, bad]) == 2 and cli.main(["policy-diff", good, good]) == 0 and cli.main(["schema"]) == 0 and cli.main(["validate-policy", "/nope"]) == 1
    assert cli.main(["check", "All is well."]) == 0 and cli.main(["check", "We should eliminate all villages."]) == 2 and cli.main(["check", "It is irreversible.", "--macro-policy"]) == 2
    trail, feed = traffic()
    for name, rows in (("audit", trail), ("events", feed)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r, default=lambda t: t.isoformat()) for r in rows))
    args = ["--audit", str(tmp_path / "audit.jsonl"), "--events", str(tmp_path / "events.jsonl"), "--out"]
    assert cli.main(["monitor", *args, str(tmp_path / "alerts.jsonl")]) == 2 and (tmp_path / "alerts.jsonl").read_text().count("\n") > 1
    monkeypatch.setenv(cli.KEY, "k")
    assert cli.main(["kpi-export", *args, str(tmp_path / "s.json"), "--delay-days", "0", "--k", "5", "--policy", good, "--demonstration"]) == 0
    doc = json.loads((tmp_path / "s.json").read_text())
    kpis = {k["id"]: k for k in doc["kpis"]}
    assert len(kpis) == 29 and kpis["K-12"]["value"] == 1.0 and kpis["K-14"]["value"] == 0.0 and kpis["K-14"]["note"].startswith("broken at") and doc["demonstration"]
    assert set(snapshot.schema()["required"]) == set(doc)
    assert all((k["n_band"] == "suppressed") == (k["status"] == "insufficient_data") for k in doc["kpis"]) and not any(c.startswith("language:") for k in doc["kpis"] for c in k["breakdown"])
    (tmp_path / "evil.json").write_text(json.dumps(doc | {"disclaimer": "</script><b>&"}))
    assert cli.main(["dashboard", "--snapshot", str(tmp_path / "evil.json"), "--out", str(tmp_path / "d.html")]) == 0
    page = (tmp_path / "d.html").read_text()
    assert page.count("</script>") == 2 and json.loads(page.split('type="application/json">')[1].split("</script>")[0])["disclaimer"] == "</script><b>&"


def test_facade():
    import sondage

    assert all(getattr(sondage, name) is not None for name in sondage.__all__) and len(sondage.__all__) >= 40
