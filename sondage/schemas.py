"""Schemas of the audit trail and of the accountability feed."""

from __future__ import annotations

LABELS = "model string, language string, topic string, region string, task_class string, cohort string, target_group string"
GOVERNANCE = (
    "community_action boolean, consent_asserted boolean, macro_policy boolean, policy_like boolean, unscreened array<string>, "
    "rule_timeouts array<string>, lexical_hits array<string>, mitigations array<string>, "
    "seed_stock struct<demographic: double, ecological: double, trust: double, agency: double, aggregate: double>"
)
ENERGY = "estimated_kwh double, actual_kwh double, carbon_intensity_g_kwh double, budget_used_kwh double, budget_remaining_kwh double"


def _struct(fields: str) -> str:
    return "struct<" + fields.replace("struct<", "\0").replace(": ", "\1").replace(" ", ":").replace(",:", ",").replace("\0", "struct<").replace("\1", ":") + ">"


AUDIT = (
    "audit_id string, timestamp timestamp, kind string, status string, tier string, code string, reason string, jurisdiction_id string, "
    "cultural_context string, tenant string, principal_digest string, policy_digest string, prompt_digest string, completion_digest string, "
    f"labels {_struct(LABELS)}, evaluators array<struct<evaluator:string,passed:boolean,code:string>>, governance_metadata {_struct(GOVERNANCE)}, "
    f"energy {_struct(ENERGY)}, channels_screened array<string>, near_miss boolean, review_flag boolean, infrastructure_error boolean, "
    "confirmed_tier3 boolean, judge_scores map<string,double>, capability struct<context:string,mode:string>, sink_failures int, prompt string, "
    "completion string, prev_digest string, record_hmac string"
)
EVENTS = (
    "type string, timestamp timestamp, audit_id string, model string, tenant string, cohort string, language string, topic string, region string, "
    "corpus string, cause string, `group` string, upheld boolean, human_confirmed boolean, filed_at timestamp, reviewed_at timestamp, "
    "occurred_at timestamp, reported_at timestamp, revoked_at timestamp, honoured_at timestamp, started_at timestamp, ended_at timestamp, "
    "attempts bigint, evasions bigint, passed bigint, total bigint, extracted double, returned double, local_share double, score double, old string, new string"
)
EVENT_TYPES = (
    "appeal_outcome", "escaped_harm", "incident_reported", "consent_verified", "consent_revoked", "redteam_result", "canary_result",
    "human_override", "breaker_trip", "value_flow", "capacity", "service_quality", "policy_change",
)
