"""Policy documents: read, validated with all errors at once, compared. Small documents, handled on the driver or in one worker call each."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import normal
from sondage.operators.decisions import Limits
from sondage.operators.rules import LIMIT_S, Rule, RuleTimeout
from sondage.plans.canaries import texts

NUMBER, INTEGER, TEXT, FLAG = {"type": "number"}, {"type": "integer"}, {"type": "string"}, {"type": "boolean"}


def _section(required: Sequence[str] = (), **keys: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": keys} | ({"required": list(required)} if required else {})


_UPTO = lambda top: NUMBER | {"exclusiveMinimum": 0, "maximum": top}
_FROM = lambda low, top, kind=NUMBER: kind | {"minimum": low, "maximum": top}
_WORDS = lambda least: TEXT | {"minLength": least}
_ONE_OF = lambda *values: TEXT | {"enum": list(values)}
_ALWAYS = lambda value: FLAG | {"const": value}

# The sections and keys of a policy document with their bounds, as in its published JSON-Schema.
RULE = _section(
    ("id", "pattern", "reason", "scope", "legal_basis", "adopting_body_ref"),
    id=TEXT | {"pattern": "^[A-Z0-9_]+$"},
    pattern=_WORDS(1),
    unless=_WORDS(1),
    reason=_WORDS(1),
    scope=_ONE_OF("RESOURCE_ALLOCATION", "SACRED_OR_TK_DISCLOSURE", "DATA_USE", "CONSENT_PROCESS"),
    legal_basis=_WORDS(3),
    adopting_body_ref=_WORDS(3),
)
SECTIONS: dict[str, dict] = {
    "metadata": _section(
        policy_id=_WORDS(1), version=TEXT, issuer=TEXT, instrument=_ONE_OF("UN_MODEL_LAW", "EU_REGULATION", "AU_CONVENTION", "VOLUNTARY"), effective_from=TEXT
    ),
    "tier_1_planetary_boundaries": _section(
        ("max_compute_kwh_per_job", "carbon_intensity_threshold_g_co2_kwh"),
        max_compute_kwh_per_job=_UPTO(1_000_000),
        carbon_intensity_threshold_g_co2_kwh=_UPTO(5_000),
        resource_exhaustion_circuit_breaker=FLAG,
        max_cumulative_kwh=_UPTO(1_000_000_000),
        max_water_liters_per_job=_UPTO(1_000_000),
        default_carbon_intensity_g_co2_kwh=_FROM(0, 5_000),
    ),
    "tier_2_community_sovereignty": _section(
        ("jurisdiction_id", "cultural_context_framework"),
        jurisdiction_id=_WORDS(1),
        community_consent_required=FLAG,
        cultural_context_framework=_ONE_OF("UBUNTU", "TILLIT", "INDIGENOUS_CARE", "RELATIONAL_COMMONWEALTH"),
        custom_rules={"type": "array", "items": RULE},
    ),
    "tier_3_inviolable_floor": _section(
        ("allow_human_degradation_tradeoff", "allow_surveillance_coercion"),
        allow_human_degradation_tradeoff=_ALWAYS(False),
        allow_surveillance_coercion=_ALWAYS(False),
        allow_relational_scoring=_ALWAYS(False),
        child_protection_override=_ALWAYS(True),
    ),
    "simulation": _section(require_simulation_for_macro_policy=FLAG, runs=_FROM(1, 10_000, INTEGER), worst_case_floor=_FROM(0, 1)),
    "circuit_breaker": _section(
        violation_threshold=_FROM(1, 100, INTEGER), window_seconds=_FROM(1, 86_400), cooldown_seconds=_FROM(60, 604_800), min_principals=_FROM(1, 1_000, INTEGER)
    ),
    "governance": _section(
        fail_closed=FLAG,
        min_seed_stock_score={"type": ["number", "null"], "minimum": 0, "maximum": 1},
        judge_threshold=NUMBER | {"exclusiveMinimum": 0, "exclusiveMaximum": 1},
        judge_timeout_seconds=_UPTO(300),
        capability_monitoring=FLAG,
        audit_include_text=FLAG,
        screen_prompts=FLAG,
        publication_consent=FLAG,
        max_input_chars=_FROM(1, 5_000_000, INTEGER),
        unscreenable_content=_ONE_OF("block", "allow"),
    ),
}
REQUIRED = ("tier_1_planetary_boundaries", "tier_2_community_sovereignty", "tier_3_inviolable_floor")
# The safeguards of a document, and which change of each relaxes it.
RELAXES: dict[tuple[str, str], str] = {
    ("governance", "fail_closed"): "off",
    ("governance", "screen_prompts"): "off",
    ("governance", "audit_include_text"): "on",
    ("governance", "unscreenable_content"): "allow",
    ("governance", "judge_threshold"): "up",
    ("governance", "max_input_chars"): "up",
    ("circuit_breaker", "violation_threshold"): "up",
    ("circuit_breaker", "min_principals"): "up",
    ("circuit_breaker", "cooldown_seconds"): "down",
    ("tier_1_planetary_boundaries", "max_compute_kwh_per_job"): "up",
    ("tier_1_planetary_boundaries", "carbon_intensity_threshold_g_co2_kwh"): "up",
    ("tier_1_planetary_boundaries", "max_cumulative_kwh"): "up",
    ("tier_1_planetary_boundaries", "resource_exhaustion_circuit_breaker"): "off",
    ("simulation", "require_simulation_for_macro_policy"): "off",
    ("simulation", "worst_case_floor"): "down",
}
#: Texts on which a community's rule must stay quick.
STRESS = ("a" * 30 + "!", "ab" * 40 + "!", " " * 200 + "x", "a b " * 60 + "!")


class PolicyError(ValueError):
    """A policy is not valid; ``errors`` lists every reason as (path, message)."""

    def __init__(self, errors: list[tuple[str, str]]) -> None:
        super().__init__("; ".join(f"{p}: {m}" for p, m in errors))
        self.errors = errors


class BlockedError(RuntimeError):
    """A request was refused; carries the decision."""

    def __init__(self, decision: dict) -> None:
        super().__init__(f"{decision.get('code')}: {decision.get('reason')}")
        self.decision = decision


def schema() -> dict:
    """JSON-Schema of a policy document, for editors and other tools."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "policy document"} | _section(REQUIRED, **{"$schema": TEXT}, **SECTIONS)


def read(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except ValueError as e:
        raise PolicyError([(path, f"not valid JSON: {e}")]) from e


_KINDS = {"number": (int, float), "integer": (int,), "string": (str,), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}


def _is(v: Any, kind: str) -> bool:
    if isinstance(v, bool) and kind in ("number", "integer"):
        return False
    if kind == "integer" and isinstance(v, float):
        return v.is_integer()
    return isinstance(v, _KINDS[kind])


def _wrong(v: Any, spec: dict, path: str) -> Iterator[tuple[str, str]]:
    """Every (path, message) by which a value breaks its part of the schema."""
    kinds = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
    if not any(_is(v, k) for k in kinds):
        yield path, f"not of type {' or '.join(kinds)}"
        return
    if "enum" in spec and v not in spec["enum"]:
        yield path, f"not one of {', '.join(spec['enum'])}"
    if "const" in spec and v is not spec["const"]:
        yield path, f"must be {json.dumps(spec['const'])}"
    if isinstance(v, str):
        if len(v) < spec.get("minLength", 0):
            yield path, f"shorter than {spec['minLength']}"
        if "pattern" in spec and not re.search(spec["pattern"], v):
            yield path, f"does not match {spec['pattern']}"
    elif isinstance(v, (int, float)) and not isinstance(v, bool):
        low, high, above, below = (spec.get(k) for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"))
        if v != v or (low is not None and v < low) or (high is not None and v > high) or (above is not None and v <= above) or (below is not None and v >= below):
            yield path, "out of range"
    elif isinstance(v, dict):
        for k in spec.get("required", ()):
            if k not in v:
                yield path, f"{k} is required"
        for k, x in v.items():
            at = f"{path}/{k}" if path else str(k)
            yield from _wrong(x, spec["properties"][k], at) if k in spec["properties"] else [(at, "unknown key")]
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from _wrong(x, spec["items"], f"{path}/{i}")


def errors(policy: Any, canaries: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """Every (path, message) that is wrong with a document, by path: first its form, and if that is right its community rules.

    ``canaries`` are the texts that no rule may match, by default those of :mod:`sondage.plans.canaries`.
    """
    out = sorted(_wrong(policy, schema(), ""))
    if not out:
        for i, r in enumerate(policy["tier_2_community_sovereignty"].get("custom_rules", [])):
            out += [(f"tier_2_community_sovereignty/custom_rules/{i}", m) for m in rule_errors(r, canaries)]
    return out


def rule_errors(r: dict, canaries: Sequence[str] | None = None) -> list[str]:
    """What is wrong with a community's rule of the right form: a pattern that doesn't compile, is slow, or matches a protected text.

    Any match counts, also one that screening would take for a mere mention.
    """
    out = []
    for part in ("pattern", "unless"):
        try:
            regex.compile(r.get(part) or "")
        except (regex.error, TypeError) as e:
            out.append(f"{part} is an invalid regular expression: {e}")
    if out:
        return out
    rule = Rule(str(r.get("id")), r["pattern"], unless=r.get("unless"), limit_s=LIMIT_S)
    try:
        for t in STRESS:
            rule.hits(t)
    except RuleTimeout:
        return ["pattern exceeds its time limit"]
    try:
        blocked = any(rule.hits(normal(t) or "") for t in (texts() if canaries is None else canaries))
    except RuleTimeout:
        blocked = True
    return ["blocks protected speech"] if blocked else []


def validated(policy: Any, canaries: Sequence[str] | None = None) -> dict:
    if found := errors(policy, canaries):
        raise PolicyError(found)
    return policy


def fingerprint(policy: dict) -> str:
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _get(policy: dict | None, section: str, key: str, default: Any = None) -> Any:
    part = (policy or {}).get(section)
    v = part.get(key) if isinstance(part, dict) else None
    return default if v is None else v


def community_rules(policy: dict | None) -> list[dict]:
    found = _get(policy, "tier_2_community_sovereignty", "custom_rules", [])
    return [r for r in found if isinstance(r, dict)] if isinstance(found, list) else []


def limits(policy: dict) -> Limits:
    """The policy as the screening operators take it; what it leaves open has the usual values."""
    d, one, two = Limits(), "tier_1_planetary_boundaries", "tier_2_community_sovereignty"
    v = lambda s, k, own: _get(policy, s, k, own)
    return Limits(
        max_kwh=v(one, "max_compute_kwh_per_job", d.max_kwh),
        max_carbon=v(one, "carbon_intensity_threshold_g_co2_kwh", d.max_carbon),
        default_carbon=v(one, "default_carbon_intensity_g_co2_kwh", d.default_carbon),
        max_water=v(one, "max_water_liters_per_job", d.max_water),
        budget_kwh=v(one, "max_cumulative_kwh", d.budget_kwh),
        halt_on_exhaustion=v(one, "resource_exhaustion_circuit_breaker", d.halt_on_exhaustion),
        jurisdiction_id=v(two, "jurisdiction_id", d.jurisdiction_id),
        cultural_context=v(two, "cultural_context_framework", d.cultural_context),
        consent_required=v(two, "community_consent_required", d.consent_required),
        custom=tuple(Rule(r["id"], r["pattern"], r["reason"], r.get("unless"), limit_s=LIMIT_S) for r in community_rules(policy)),
        simulate_macro=v("simulation", "require_simulation_for_macro_policy", d.simulate_macro),
        simulation_runs=v("simulation", "runs", d.simulation_runs),
        worst_case_floor=v("simulation", "worst_case_floor", d.worst_case_floor),
        seed_stock_floor=v("governance", "min_seed_stock_score", d.seed_stock_floor),
        fail_closed=v("governance", "fail_closed", d.fail_closed),
        judge_threshold=v("governance", "judge_threshold", d.judge_threshold),
        screen_prompts=v("governance", "screen_prompts", d.screen_prompts),
        max_input_chars=v("governance", "max_input_chars", d.max_input_chars),
        unscreenable=v("governance", "unscreenable_content", d.unscreenable),
        policy_digest=fingerprint(policy),
    )


def breaker_settings(policy: dict) -> dict:
    """The settings of :class:`sondage.operators.state.Breaker` that a policy makes."""
    names = {"violation_threshold": "threshold", "window_seconds": "window_s", "cooldown_seconds": "cooldown_s", "min_principals": "principals"}
    return {own: v for key, own in names.items() if (v := _get(policy, "circuit_breaker", key)) is not None}


def publication_consent(policy: dict | None) -> bool:
    """Whether the community consents to publication of its own series."""
    return bool(_get(policy, "governance", "publication_consent", False))


def rules_share(policy: dict | None, canaries: Sequence[str] | None = None) -> tuple[float | None, int, str]:
    """K-12: the share of community rules that are in order, how many there are, and a note."""
    if policy is None:
        return None, 0, "no policy document supplied"
    rules = community_rules(policy)
    if not rules:
        return 1.0, 0, "no community rules"
    good = [r for r in rules if not list(_wrong(r, RULE, "")) and not rule_errors(r, canaries)]
    return len(good) / len(rules), len(rules), ""


def nested_repeats(pattern: str) -> bool:
    """Whether a group that repeats something is itself repeated; one walk over the pattern, groups on a stack.

    Such a pattern may take exponential time. Escapes and character classes hold no repeats.
    """
    repeats, closed, i = [False], None, 0
    while i < len(pattern):
        ch = pattern[i]
        again = ch in "*+" or ch == "{" and re.match(r"\{\d*,?\d*\}", pattern[i:]) is not None
        if again:
            if closed:
                return True
            repeats[-1] = True
        inner = None
        if ch == "\\":
            i += 1
        elif ch == "[":
            end = re.compile(r"\^?\]?(?:[^\]\\]|\\.)*\]").match(pattern, i + 1)
            i = end.end() - 1 if end else i
        elif ch == "(":
            repeats.append(False)
        elif ch == ")" and len(repeats) > 1:
            inner = repeats.pop()
            repeats[-1] |= inner
        closed = inner
        i += 1
    return False


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    path: str
    detail: str


def _relaxed(way: str, a: Any, b: Any) -> bool:
    number = isinstance(b, (int, float)) and not isinstance(b, bool) and isinstance(a, (int, float))
    return {"off": a is True and b is False, "on": a is False and b is True, "allow": b == "allow" != a, "up": number and b > a, "down": number and b < a}[way]


def compare(old: Any, new: Any, canaries: Sequence[str] | None = None) -> list[Finding]:
    """What a new policy changes for the worse: errors, safeguards relaxed that both documents have, another issuer, new risky patterns."""
    out = []
    if found := errors(new, canaries):
        out.append(Finding("POLICY_INVALID", "critical", "", "; ".join(f"{p or '<root>'}: {m}" for p, m in found)))
    old, new = (p if isinstance(p, dict) else {} for p in (old, new))
    for (section, key), way in RELAXES.items():
        a, b = _get(old, section, key), _get(new, section, key)
        if a is not None and b is not None and _relaxed(way, a, b):
            out.append(Finding("POLICY_RELAXATION", "warning", f"{section}.{key}", f"{json.dumps(a)} -> {json.dumps(b)}"))
    before, after = _get(old, "metadata", "issuer"), _get(new, "metadata", "issuer")
    if before and before != after:
        out.append(Finding("ISSUER_CHANGED", "warning", "metadata.issuer", f"{before} -> {after}"))
    known = {r.get("id") for r in community_rules(old)}
    for r in community_rules(new):
        if r.get("id") not in known and nested_repeats(str(r.get("pattern", ""))):
            out.append(Finding("RISKY_PATTERN", "warning", f"rule {r.get('id')}", str(r.get("pattern"))))
    return out


REVIEW = "event_no bigint, code string, severity string, path string, detail string"


def review(changes: DataFrame, canaries: Sequence[str] | None = None) -> DataFrame:
    """:func:`compare` of every policy change (event_no, old, new), the documents as JSON text: rows of :data:`REVIEW`.

    Text that is no JSON, and null, is an invalid document. Documents are reviewed in Arrow batches, wherever they lie.
    """
    held = list(texts() if canaries is None else canaries)

    def document(text: str | None) -> Any:
        try:
            return json.loads(text) if text is not None else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(no, f.code, f.severity, f.path, f.detail) for no, old, new in zip(*[c.to_pylist() for c in b.columns]) for f in compare(document(old), document(new), held)]
            if rows:
                kinds = [pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["event_no", "code", "severity", "path", "detail"])

    return changes.select(F.col("event_no").cast("bigint"), F.col("old").cast("string"), F.col("new").cast("string")).mapInArrow(run, REVIEW)
