"""The public snapshot: delayed, suppressed below k, rounded, without anything restricted."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage import __version__
from sondage.functions.stats import size_band
from sondage.plans import kpi, monitors, policy as P, scorecard
from sondage.sources.audit import in_window, parse_time, with_key

# Dimensions that show communities and are published with their consent only; the delay in days.
COMMUNITY_DIMS = ("language", "region", "cohort", "target_group", "group")
DELAY_DAYS = 7
SCHEMA_VERSION = "1.0"
DISCLAIMER = "Totals of an automated guard. Its lexical and model-based checks have error rates. No certificate of compliance."
# Name, pillar and unit of each indicator, and the one it is read together with.
SHOWN = {
    "K-01": ("Confirmed Tier 3 violations", "Harm prevention", "per 10k", "K-04"), "K-02": ("Escaped harms", "Harm prevention", "per 10k", "K-04"),
    "K-03": ("Near-miss rate", "Harm prevention", "share", "K-01"), "K-04": ("False-refusal rate", "Fair refusals", "share", "K-01"),
    "K-05": ("Time to human review", "Fair refusals", "hours", "K-04"), "K-06": ("Protected-speech canary pass rate", "Fair refusals", "share", "K-01"),
    "K-07": ("Energy per 1,000 interactions", "Planetary", "kWh per 1k", "K-08"), "K-08": ("Carbon per interaction", "Planetary", "gCO2e", None),
    "K-09": ("Energy budget used", "Planetary", "share", "K-07"), "K-10": ("Metered energy share", "Planetary", "share", "K-07"),
    "K-11": ("Verified community consent", "Community", "share", None), "K-12": ("Canary-safe community rules", "Community", "share", "K-06"),
    "K-13": ("Revocations honoured in time", "Community", "share", None), "K-14": ("Audit-chain integrity", "Integrity", "share", None),
    "K-15": ("Audit completeness", "Integrity", "share", None), "K-16": ("Incident reports on time", "Integrity", "share", "K-01"),
    "K-17": ("Circuit-breaker trips", "Integrity", "count", None), "K-18": ("Red-team evasion rate", "Robustness", "share", "K-04"),
    "K-19": ("Channel coverage", "Robustness", "share", None), "K-20": ("Fail-closed events", "Robustness", "per 10k", None),
    "K-21": ("Human override rate", "Agency", "share", None), "K-22": ("Directive-language share", "Agency", "share", None),
    "K-23": ("Scaffold ratio", "Moderated struggle", "share", None), "K-24": ("Over-protection index", "Moderated struggle", "share", "K-01"),
    "K-25": ("Refusal disparity across languages", "Diversity", "ratio", None), "K-26": ("Output diversity", "Diversity", "share", None),
    "K-27": ("Value-return ratio", "Value-flow equity", "ratio", None), "K-28": ("Local capacity share", "Value-flow equity", "share", None),
    "K-29": ("Service-parity index", "Value-flow equity", "ratio", None),
}


def published(results: DataFrame, k: int) -> DataFrame:
    """(kpi, value, ci_low, ci_high, status, n_band, note, suppressed): withheld where the status is insufficient or n is below the least.

    Of a withheld indicator nothing is shown, not even the band of its size.
    """
    c = F.col
    least = F.element_at(F.create_map(*[F.lit(x) for i, d in kpi.DEFINITIONS.items() for x in (i, min(d[3], k))]), c("kpi"))
    held = (c("status") == "insufficient_data") | (c("value").isNotNull() & (c("n") < least))
    open_ = lambda x: F.when(~held, x)
    return results.select(
        "kpi", open_(F.bround("value", 4)).alias("value"), open_(F.bround("ci_low", 4)).alias("ci_low"), open_(F.bround("ci_high", 4)).alias("ci_high"),
        F.when(held, "insufficient_data").otherwise(c("status")).alias("status"), F.when(held, "suppressed").otherwise(size_band(c("n"))).alias("n_band"),
        F.when(held, "").otherwise(c("note")).alias("note"), held.alias("suppressed"),
    )


def published_breakdown(b: DataFrame, k: int, consent: bool) -> DataFrame:
    """(kpi, dim, member, value, suppressed): no community dimension without consent, and again no value for n below k, nor any size.

    Cells that carry n = 1 by construction (regions, groups) are therefore withheld for any k above 1.
    """
    b = b if consent else b.filter(~F.col("dim").isin(*COMMUNITY_DIMS))
    small: Column = F.col("suppressed") | (F.col("n") < k)
    return b.select("kpi", "dim", "member", F.when(~small, F.bround("value", 4)).alias("value"), small.alias("suppressed"))


def published_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts for the public, those that differ in nothing shown counted in one row: their number is small at any size of the trail."""
    shown = monitors.public(alerts)
    keys = ["agent", "code", "severity", "title", "confidence", "raised_at"]
    day = F.date_trunc("day", F.min("predicted_at"))
    return shown.groupBy(*keys).agg(F.count("*").alias("alerts"), F.max("value").alias("value"), F.max("level").alias("level"), day.alias("predicted_day"))


def build(
    audit: DataFrame, events: DataFrame, now: datetime, *, delay_days: int = DELAY_DAYS, k: int = 20, policy: dict | None = None, chain: tuple[float | None, int, str] | None = None,
    consent: bool | None = None, demonstration: bool = False,
) -> dict:
    """The snapshot document. Only aggregates reach the driver: 29 indicators, their published cells, models, alerts by kind.

    ``policy`` gives K-12 and, unless ``consent`` is given, whether community dimensions are published; ``chain`` is K-14 as
    :func:`sondage.operators.state.chain_share` finds it. Nothing after ``now`` less the delay is looked at.
    """
    cutoff = parse_time(now) - timedelta(days=delay_days)
    consent = P.publication_consent(policy) if consent is None else consent
    audit, events = in_window(with_key(audit), end=cutoff), in_window(with_key(events), end=cutoff)
    results, b = kpi.compute(kpi.Inputs(audit, events, k), rules=P.rules_share(policy), chain=chain)
    start = audit.agg(F.min("timestamp").alias("t")).first()["t"]
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    cells: dict = {}
    for r in rows(published_breakdown(b, k, consent).orderBy("kpi", "dim", "member")):
        cells.setdefault(r["kpi"], {})[f"{r['dim']}:{r['member']}"] = {"value": r["value"], "suppressed": r["suppressed"]}
    indicators = []
    for r in rows(published(results, k).orderBy("kpi")):
        name, pillar, unit, paired = SHOWN[r["kpi"]]
        direction, green, amber, _ = kpi.DEFINITIONS[r["kpi"]]
        indicators.append({
            "id": r["kpi"], "name": name, "pillar": pillar, "unit": unit, "direction": direction, "target": {"green": green, "amber": amber}, "paired_with": paired, "value": r["value"],
            "ci": None if r["ci_low"] is None else [r["ci_low"], r["ci_high"]], "status": r["status"], "n_band": r["n_band"], "breakdown": cells.get(r["kpi"], {}), "note": r["note"],
        })
    alerts = rows(published_alerts(monitors.assess(monitors.observe(audit, events, cutoff)))) if start else []
    rank = lambda a: (monitors.SEVERITY[a["severity"]], a["agent"], a["code"], a["title"])
    return {
        "schema_version": SCHEMA_VERSION,
        "generator": f"sondage {__version__}",
        "generated_at": parse_time(now).isoformat(),
        "period": {"start": (start.replace(tzinfo=timezone.utc) if start else cutoff).isoformat(), "end": cutoff.isoformat()},
        "delay_days": delay_days,
        "k_threshold": k,
        "community_breakdowns": consent,
        "demonstration": demonstration,
        "disclaimer": DISCLAIMER,
        "kpis": indicators,
        "alerts": sorted(alerts, key=rank),
        "models": rows(scorecard.scorecards(kpi.Inputs(audit, events, k, "model"))),
        "rating_method": scorecard.rating_method(),
    }


def schema() -> dict:
    """JSON-Schema of a snapshot document."""
    text, number, flag = {"type": "string"}, {"type": ["number", "null"]}, {"type": "boolean"}
    cell = {"type": "object", "required": ["value", "suppressed"], "properties": {"value": number, "suppressed": flag}}
    indicator = {"id": text, "name": text, "pillar": text, "unit": text, "direction": text, "target": {"type": "object"}, "paired_with": {"type": ["string", "null"]}, "value": number,
                 "ci": {"type": ["array", "null"], "items": {"type": "number"}}, "status": {"enum": ["green", "amber", "red", "info", "insufficient_data"]},
                 "n_band": text, "breakdown": {"type": "object", "additionalProperties": cell}, "note": text}
    top = {"schema_version": text, "generator": text, "generated_at": text, "period": {"type": "object", "required": ["start", "end"]}, "delay_days": {"type": "integer"}, "k_threshold": {"type": "integer"},
           "community_breakdowns": flag, "demonstration": flag, "disclaimer": text, "kpis": {"type": "array", "items": {"type": "object", "required": list(indicator), "properties": indicator}},
           "alerts": {"type": "array", "items": {"type": "object"}}, "models": {"type": "array", "items": {"type": "object"}}, "rating_method": {"type": "object"}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": list(top), "properties": top}


_PAGE = """<!doctype html><meta charset="utf-8"><title>Accountability snapshot</title>
<style>body{{font:15px system-ui;margin:2rem}}td,th{{padding:.3rem .7rem;text-align:left;border-bottom:1px solid #ccc}}</style>
<h1>Accountability snapshot</h1><p id="about"></p><table id="kpis"><tr><th>Indicator<th>Value<th>Status<th>Size</table>
<h2>Alerts</h2><ul id="alerts"></ul><script id="snapshot" type="application/json">{data}</script>
<script>const s=JSON.parse(document.getElementById("snapshot").textContent);
const put=(where,kind,cells)=>{{const row=document.createElement(kind);for(const c of cells){{const e=document.createElement(kind=="tr"?"td":"span");e.textContent=c??"–";row.append(e," ")}}document.getElementById(where).append(row)}};
document.getElementById("about").textContent=s.period.start+" to "+s.period.end+". "+s.disclaimer;
for(const k of s.kpis)put("kpis","tr",[k.id+" "+k.name,k.value===null?null:k.value+" "+k.unit,k.status,k.n_band]);
for(const a of s.alerts)put("alerts","li",[a.severity,a.agent,a.title]);</script>"""


def dashboard(snapshot: dict) -> str:
    """A page with the snapshot inside, as JSON in which no tag can begin or end."""
    data = json.dumps(snapshot, ensure_ascii=False, separators=(",", ":"), default=str)
    for sign in "<>&":
        data = data.replace(sign, f"\\u{ord(sign):04x}")
    return _PAGE.format(data=data)
