"""sondage: screening, accountability analytics and audit-trail data operators on Spark."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

#: The names that callers need most, and where they live; loaded on first use.
_NAMES = {
    "sondage.session": ("local_session", "ship"),
    "sondage.sources.audit": ("load_audit", "load_events", "from_records", "in_window", "parse_time"),
    "sondage.operators.decisions": ("Limits", "screen", "simulate", "judged", "evaluator", "external", "audit_rows", "energy_rows", "seed_stock"),
    "sondage.operators.rules": ("LEXICON", "STRUCTURAL", "Rule", "RuleTimeout", "looks_like_policy", "rules_for", "screened"),
    "sondage.operators.calls": ("complete", "guarded"),
    "sondage.operators.judge": ("TEMPLATES", "Template", "ask", "questions"),
    "sondage.operators.state": ("Breaker", "budget", "throttle", "reconciled", "breaker", "verify_chain", "write_chain"),
    "sondage.operators.nested": ("child_table", "elements", "first_deliveries", "read_records"),
    "sondage.operators.references": ("orphans", "orphan_counts", "references"),
    "sondage.operators.rolling": ("daily", "rolling", "with_averages"),
    "sondage.plans.kpi": ("DEFINITIONS", "Inputs", "compute"),
    "sondage.plans.monitors": ("AGENTS", "assess", "observe", "public"),
    "sondage.plans.policy": ("BlockedError", "PolicyError", "compare", "limits", "validated"),
    "sondage.plans.scorecard": ("rating_method", "scorecards"),
    "sondage.plans.snapshot": ("build", "dashboard"),
}
_HOME = {name: module for module, names in _NAMES.items() for name in names}
__all__ = ["__version__", *sorted(_HOME)]


def __getattr__(name: str):  # noqa: ANN202
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(_HOME[name]), name)
