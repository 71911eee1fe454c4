"""Decisions as column expressions: checks in a fixed order, the first failure decides.

A check is a Column of :data:`RESULT`, null-safe, over a row of requests: audit_id, prompt, completion, and, where they are
there, estimated_kwh, carbon_intensity, water_l, macro_policy, affects_community, community_consent, context, principal,
tenant, labels, channels, unscreenable, admission (of the breaker), budget_admitted, model_error, twin. Columns that
are absent count as null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.digests import keyed_digest
from sondage.functions.stats import dbl, ratio, sound
from sondage.functions.text import size_guard
from sondage.operators import rules as R

RESULT = "struct<evaluator: string, passed: boolean, tier: string, code: string, reason: string, infrastructure_error: boolean>"
ERRORS = ("EVALUATOR_ERROR", "JUDGE_ERROR")
# The labels that an audit record may carry.
LABELS = ("model", "language", "topic", "region", "task_class", "cohort", "target_group")
#: A judge's score from this share of the threshold on is a near miss.
NEAR = 0.6


@dataclass(frozen=True)
class Limits:
    """What a policy sets; see :mod:`sondage.plans.policy`. What holds where a policy is silent."""

    max_kwh: float = 100.0
    max_carbon: float = 200.0
    default_carbon: float = 120.0
    default_kwh: float = 0.001
    max_water: float | None = None
    budget_kwh: float | None = None
    halt_on_exhaustion: bool = True
    jurisdiction_id: str = "GLOBAL"
    cultural_context: str = "UBUNTU"
    max_input_chars: int = 200_000
    unscreenable: str = "block"
    consent_required: bool = False
    screen_prompts: bool = False
    escalate: bool = False
    fail_closed: bool = True
    judge_threshold: float = 0.5
    seed_stock_floor: float | None = None
    simulate_macro: bool = True
    simulation_runs: int = 32
    worst_case_floor: float = 0.0
    rules: Sequence[R.Rule] = field(default=R.LEXICON)
    custom: Sequence[R.Rule] = ()
    policy_digest: str | None = None


def result(name: str, code: Column, tier: Column | str, reason: Column | str = "", error: Column | None = None) -> Column:
    """A result that fails with ``code``, or passes where it is null; ``error`` tells whether the check itself failed."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    ok = code.isNull()
    return F.struct(
        F.lit(name).alias("evaluator"), ok.alias("passed"), F.when(~ok, lit(tier)).alias("tier"), F.coalesce(code, F.lit("")).alias("code"),
        F.when(~ok, lit(reason)).otherwise("").alias("reason"), F.coalesce(error if error is not None else F.lit(False), F.lit(False)).alias("infrastructure_error"),
    )


def invalid_number(*cols: str) -> Column:
    """True where any quantity is negative, infinite or not a number; null is none of these."""
    bad = [F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, bad)


def tier1(p: Limits, used: str | None = None, limit: str | None = None) -> Column:
    """The first limit that is exceeded, strictly: energy, carbon intensity, water, budget. Unsound figures count as absent."""
    kwh = sound(F.col("estimated_kwh"))
    code = F.when(kwh > p.max_kwh, "COMPUTE_LIMIT")
    code = code.when(F.coalesce(sound(F.col("carbon_intensity")), dbl(p.default_carbon)) > p.max_carbon, "CARBON_INTENSITY_LIMIT")
    if p.max_water is not None:
        code = code.when(sound(F.col("water_l")) > p.max_water, "WATER_LIMIT")
    if used and limit:
        code = code.when(F.col(used) + F.coalesce(kwh, dbl(0.0)) > F.col(limit), "RESOURCE_BUDGET_EXHAUSTED")
    return result("tier1.resources", code, "TIER_1")


def utilisation(p: Limits) -> Column:
    """Shares of the limits that a request uses; null for an unsound figure."""
    return F.struct(
        ratio(sound(F.col("estimated_kwh")), F.lit(p.max_kwh)).alias("energy"),
        ratio(F.coalesce(sound(F.col("carbon_intensity")), dbl(p.default_carbon)), F.lit(p.max_carbon)).alias("carbon"),
        (ratio(sound(F.col("water_l")), F.lit(p.max_water)) if p.max_water else dbl(None)).alias("water"),
    )


def consent_gate(p: Limits) -> Column:
    """A community's consent must be there, and true, before it is affected."""
    touches = F.coalesce("macro_policy", F.lit(False)) | F.coalesce("affects_community", F.lit(False))
    missing = F.lit(p.consent_required) & touches & ~F.col("community_consent").eqNullSafe(F.lit(True))
    return result("tier2.consent", F.when(missing, "COMMUNITY_CONSENT_MISSING"), "TIER_2")


def lexical(name: str, tier: int, screened: Column, escalate: bool = False, error: Column | None = None, fail_closed: bool = True) -> Column:
    """Proposals block with the code of the first; mentions pass. With ``escalate`` a judge decides instead.

    A check that failed itself (``error``) blocks with EVALUATOR_ERROR in tier 3 always, else with ``fail_closed``.
    """
    failed = F.coalesce(error.isNotNull(), F.lit(False)) if error is not None else F.lit(False)
    first = F.when(F.lit(not escalate), F.get(screened["proposals"], F.lit(0))["code"])
    code = F.when(failed & F.lit(fail_closed or tier == 3), "EVALUATOR_ERROR").when(~failed, first)
    return result(name, code, f"TIER_{tier}", error=failed)


def evaluator(name: str, tier: str, check: Callable[[str | None], str | None], column: str, *, fail_closed: bool = True) -> Column:
    """A user's check as a result: ``check(text)`` gives a code, or None to pass. It runs in Arrow batches.

    An exception is an EVALUATOR_ERROR of its row, closed in tier 3 or with ``fail_closed``, else a pass that is marked.
    """
    closed = fail_closed or tier == "TIER_3"
    kind = pa.struct([("evaluator", pa.string()), ("passed", pa.bool_()), ("tier", pa.string()), ("code", pa.string()), ("reason", pa.string()), ("infrastructure_error", pa.bool_())])

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                code, broken, why = check(t), False, ""
            except Exception as e:
                code, broken, why = "EVALUATOR_ERROR", True, f"{name} raised {type(e).__name__}"
            blocks = closed if broken else code is not None
            out.append({"evaluator": name, "passed": not blocks, "tier": tier if blocks else None, "code": code or "", "reason": why, "infrastructure_error": broken})
        return pa.array(out, kind)

    return run(F.col(column))


def judged(verdicts: DataFrame, threshold: float = 0.5, fail_closed: bool = True) -> DataFrame:
    """One result per audit_id from a table of verdicts (audit_id, template, ordinal, tier, violation, score, error).

    A verdict fires on a violation or a score at the threshold; of several the tier decides (3, 1, 2), then the
    template's order. Errors of tier-3 templates block always, others if ``fail_closed``.
    """
    bad = F.col("error").isNotNull()
    fires = F.coalesce(F.col("violation") | (F.col("score") >= threshold), F.lit(False)) | (bad & (F.lit(fail_closed) | (F.col("tier") == "TIER_3")))
    rank = F.element_at(F.create_map(F.lit("TIER_3"), F.lit(0), F.lit("TIER_1"), F.lit(1), F.lit("TIER_2"), F.lit(2)), F.col("tier"))
    code = F.when(bad, F.lit("JUDGE_ERROR")).otherwise(F.col("template"))
    won = F.min_by(F.struct(code.alias("code"), "tier", F.coalesce("error", F.lit("")).alias("reason")), F.when(fires, F.struct(rank, "ordinal")))
    out = verdicts.groupBy("audit_id").agg(won.alias("w"), F.max("score").alias("top"), F.count_if(bad).alias("broken"), F.map_from_entries(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("template", "score")))).alias("scores"))
    verdict = result("judge", F.col("w.code"), F.col("w.tier"), F.col("w.reason"), F.col("broken") > 0)
    return out.select("audit_id", verdict.alias("judge"), (F.col("top") >= NEAR * threshold).alias("judge_near"), "scores")


#: The tier of each pillar.
PILLAR_TIER = {"demographic": "TIER_3", "ecological": "TIER_1", "trust": "TIER_2", "agency": "TIER_2"}
#: Words that speak for and against each pillar of the seed stock; our own.
PILLARS = {
    "demographic": (
        r"\b(?:care(?:s|d|giv\w+)?|famil(?:y|ies)|children|elders?|health\w*|births?|midwi\w+|parents?|grandparents?|childhood|matern\w+|patern\w+|nurs(?:e|es|ing|ery)|schools?|housing|generations?)\b",
        r"\b(?:abandon\w*|neglect\w*|overwork\w*|displac\w*|evict\w*|sterili[sz]\w*|burdens? of (?:care|children)|childless\w*|depopulat\w*|unpaid overtime|separat\w+ families)\b",
    ),
    "trust": (
        r"\b(?:trust\w*|consent\w*|transparen\w*|honest\w*|agreements?|accountab\w*|open (?:books|records|meetings?)|neighbou?rs?|solidarity|apolog\w+|public(?:ly)? report\w*)\b",
        r"\b(?:secre\w*|deceiv\w*|decept\w*|surveil\w*|informants?|suspect\w*|blackmail\w*|mislead\w*|monitor\w* (?:staff|residents|citizens)|hidden (?:fees|terms)|lie[sd]? to)\b",
    ),
    "agency": (
        r"\b(?:choices?|choos\w+|decid\w+|vot(?:e|es|ed|ing)|learn\w*|appeal\w*|opt(?:ing)? out|alternatives?|deliberat\w*|consult\w*|you (?:may|might|could)|pilots?|options?)\b",
        r"\b(?:mandatory|forced|no choice|automatic(?:ally)?|overrid\w*|must obey|comply immediately|without (?:asking|appeal|question)|compulsory|only option|do as (?:told|instructed))\b",
    ),
}


def signal_score(good: Column, bad: Column) -> Column:
    return (dbl(good) + 1) / (dbl(good) + dbl(bad) + 1)


def ecological(used: Column) -> Column:
    """1 less the largest utilisation of a struct, within [0, 1]; 1 where none is known."""
    top = F.greatest(used["energy"], used["carbon"], F.coalesce(used["water"], dbl(0.0)))
    return F.coalesce(F.greatest(dbl(0.0), F.least(dbl(1.0), 1 - top)), dbl(1.0))


def seed_stock(text: Column, used: Column) -> Column:
    """demographic, ecological, trust and agency in [0, 1], their minimum and the first pillar that has it."""
    score = {n: signal_score(F.regexp_count(F.lower(text), F.lit(g)), F.regexp_count(F.lower(text), F.lit(b))) for n, (g, b) in PILLARS.items()}
    score = {n: ecological(used) if n == "ecological" else score[n] for n in ("demographic", "ecological", "trust", "agency")}
    low = F.least(*score.values())
    weakest = F.coalesce(*[F.when(s == low, n) for n, s in score.items()])
    return F.struct(*[s.alias(n) for n, s in score.items()], low.alias("aggregate"), weakest.alias("weakest"))


def weighted(stock: Column, weights: dict[str, float]) -> Column:
    """The weighted mean of the pillars; weights must not add up to 0 or less."""
    if sum(weights.values()) <= 0:
        raise ValueError("weights must add up to more than 0")
    return sum((stock[n] * w for n, w in weights.items()), dbl(0.0)) / sum(weights.values())


def floor_gate(stock: Column, floor: float) -> Column:
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in PILLAR_TIER.items() for x in kv]), stock["weakest"])
    return result("seed_stock.floor", F.when(stock["aggregate"] < floor, "SEED_STOCK_DEPLETION"), tier)


def simulate(proposals: DataFrame, twin: Callable[[str, int], float], runs: int = 32, floor: float = 0.5) -> DataFrame:
    """(id, passed, runs, worst, mean): a twin run for every proposal (id, text) and seed, spread over the cluster.

    ``twin(text, seed)`` gives a number; one that is not finite fails the proposal, others are clipped to [0, 1], and the worst decides.
    """
    import pandas as pd

    if runs < 1 or not 0 < floor <= 1:
        raise ValueError("a twin needs at least one run and a floor above 0")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": [float(twin(t, int(s))) for t, s in zip(b["text"], b["seed"])]})

    every = proposals.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    scores = every.select("id", "text", "seed").mapInPandas(run, "id string, score double")
    bad = F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()
    clipped = F.when(~bad, F.greatest(dbl(0.0), F.least(dbl(1.0), F.col("score"))))
    out = scores.groupBy("id").agg(F.count("*").alias("runs"), F.count_if(bad).alias("bad"), F.min(clipped).alias("worst"), F.avg(clipped).alias("mean"))
    return out.select("id", ((F.col("bad") == 0) & (F.col("worst") >= floor)).alias("passed"), "runs", "worst", "mean")


def decide(results: Sequence[Column]) -> Column:
    """status, tier and code of the first failing result, and the results up to and including it."""
    every = F.array(*results)
    failed = F.array_position(F.transform(every, lambda r: ~F.coalesce(r["passed"], F.lit(False))), True)
    first = F.when(failed > 0, F.get(every, failed.cast("int") - 1))
    return F.struct(
        F.when(first["code"] == "MODEL_ERROR", "ERROR").when(failed > 0, "BLOCKED").otherwise("APPROVED").alias("status"), first["tier"].alias("tier"), F.coalesce(first["code"], F.lit("")).alias("code"),
        F.coalesce(first["reason"], F.lit("")).alias("reason"), F.when(failed > 0, F.slice(every, F.lit(1), failed.cast("int"))).otherwise(every).alias("evaluators"),
    )


def confirmed_tier3(decision: Column, infrastructure_error: Column) -> Column:
    """A tier-3 failure that is no failure of a check itself."""
    return (decision["tier"] == "TIER_3").eqNullSafe(F.lit(True)) & ~decision["code"].isin(*ERRORS) & ~F.coalesce(infrastructure_error, F.lit(False))


#: Columns of requests that screening reads where they are there, and their types.
ASKED = {
    "audit_id": "string", "prompt": "string", "completion": "string", "estimated_kwh": "double", "carbon_intensity": "double", "water_l": "double", "macro_policy": "boolean",
    "affects_community": "boolean", "community_consent": "boolean", "context": "string", "principal": "string", "tenant": "string", "unscreenable": "array<string>", "channels": "array<string>",
    "admission": "string", "budget_admitted": "boolean", "model_error": "string",
}


def screen(requests: DataFrame, p: Limits = Limits(), extra: Sequence[Column] = (), verdicts: DataFrame | None = None, extra_pre: Sequence[Column] = ()) -> DataFrame:
    """Requests with their decision. The order of checks, the first failure deciding:

    what can't be read; the prompt's size; the breaker's ``admission``; figures that are no quantities; tier 1; prompt rules if
    asked for; consent; ``extra_pre``; the budget (``budget_admitted``); the model's own error; the completion's size; tier-3 and
    tier-2 rules; the judge (``verdicts``, of :func:`sondage.operators.judge.ask`); ``extra``; the seed-stock floor; and for
    macro policies the structural rules and the ``twin``'s outcome (a struct with passed).

    Each text is read once, in Arrow batches, and only within the size limit. With a judge, tier-3 proposals are its to
    decide. Adds ``decision`` (status, tier, code, reason, evaluators), ``near_miss``, ``review_flag``, ``infrastructure_error``,
    ``lexical_hits``, ``mitigations``, ``rule_timeouts``, ``structural``, ``seed_stock``, ``judge_scores``, ``confirmed_tier3``,
    ``breaker_violation`` (counts towards the breaker) and ``policy_like``; existing columns of these names are replaced.
    """
    absent = {c: F.lit(None).cast(t) for c, t in ASKED.items() if c not in requests.columns}
    d = requests.withColumns(absent) if absent else requests
    long_prompt, long_answer = size_guard(F.col("prompt"), F.lit(""), p.max_input_chars), size_guard(F.lit(""), F.col("completion"), p.max_input_chars)
    context = F.coalesce("context", F.lit(p.cultural_context))
    fits = lambda guard, c: F.when(guard.isNull(), F.col(c))
    none = F.lit(None).cast(R.READ)
    d = d.withColumns({
        "_c": R.read(fits(long_answer, "completion"), context, p.rules, p.custom, R.STRUCTURAL), "_p": R.read(fits(long_prompt, "prompt"), context, [r for r in p.rules if r.tier == 3]) if p.screen_prompts else none,
    })
    if verdicts is not None:
        d = d.join(judged(verdicts, p.judge_threshold, p.fail_closed), "audit_id", "left")
    d = d.withColumn("seed_stock", seed_stock(F.col("_c.norm"), utilisation(p)))
    escalate, error = p.escalate or verdicts is not None, F.col("_c.error")
    unread = F.when((F.lit(p.unscreenable == "block")) & (F.size(F.coalesce("unscreenable", F.array().cast("array<string>"))) > 0), "UNSCREENABLE_CONTENT")
    stopped = F.when(F.col("admission") == "GLOBAL_OPEN", "CIRCUIT_OPEN").when(F.col("admission") == "PRINCIPAL_SUSPENDED", "PRINCIPAL_SUSPENDED")
    spent = F.when(F.lit(p.halt_on_exhaustion) & ~F.coalesce("budget_admitted", F.lit(True)), "RESOURCE_BUDGET_EXHAUSTED")
    macro = F.coalesce("macro_policy", F.lit(False)) & F.lit(p.simulate_macro)
    twin = ~F.coalesce(F.col("twin")["passed"], F.lit(False)) & F.col("twin").isNotNull() if "twin" in requests.columns else F.lit(False)
    flagged = F.size("_c.structural") > 0
    stages = [
        result("input", F.coalesce(unread, long_prompt), "INPUT_LIMITS", F.when(unread.isNotNull(), F.array_join(F.array_sort("unscreenable"), ", ")).otherwise("the prompt is too long")),
        result("breaker", stopped, "CIRCUIT_BREAKER"),
        result("figures", F.when(invalid_number("estimated_kwh", "carbon_intensity", "water_l"), "INVALID_FIGURE"), "INPUT_LIMITS"),
        tier1(p), lexical("tier3.prompt", 3, F.col("_p.t3"), escalate, F.col("_p.error")), consent_gate(p), *extra_pre,
        result("budget", spent, "TIER_1"), result("model", F.when(F.col("model_error").isNotNull(), "MODEL_ERROR"), F.lit(None).cast("string"), F.col("model_error")),
        result("output", long_answer, "INPUT_LIMITS", "the completion is too long"),
        lexical("tier3.rules", 3, F.col("_c.t3"), escalate, error), lexical("tier2.lexical", 2, F.col("_c.t2"), False, error, p.fail_closed),
        *([F.coalesce("judge", result("judge", F.lit(None).cast("string"), "TIER_2"))] if verdicts is not None else []), *extra,
        *([floor_gate(F.col("seed_stock"), p.seed_stock_floor)] if p.seed_stock_floor is not None else []),
        result("simulation", F.when(macro & (flagged | twin), "SIMULATION_FAILED"), "SILICON_SIMULATION", F.coalesce(F.get("_c.structural", F.lit(0)), F.lit("the twin's worst case"))),
    ]
    d = d.withColumn("decision", decide(stages))
    # Only checks that ran leave their marks: those up to the first failure.
    ran = F.transform("decision.evaluators", lambda e: e["evaluator"])
    hits_of = lambda name, c: F.when(F.array_contains(ran, name), F.concat(F.col(c)["proposals"], F.col(c)["mentions"]))
    empty = F.array().cast("array<struct<code:string,start:int,stop:int,mitigations:array<string>>>")
    parts = {"tier3.prompt": "_p.t3", "tier3.rules": "_c.t3", "tier2.lexical": "_c.t2"}
    d = d.withColumn("_hits", F.concat(*[F.coalesce(hits_of(n, c), empty) for n, c in parts.items()]))
    mentioned = reduce(lambda a, b: a | b, [F.array_contains(ran, n) & (F.size(F.coalesce(F.col(c)["mentions"], empty)) > 0) for n, c in parts.items()])
    judge_ok = F.coalesce(F.col("judge.passed"), F.lit(False)) if verdicts is not None else F.lit(False)
    union = lambda f: F.array_sort(F.array_distinct(F.transform("_hits", f)))
    d = d.withColumns({
        "near_miss": (F.size("_hits") > 0) | (judge_ok & F.coalesce("judge_near", F.lit(False)) if verdicts is not None else F.lit(False)), "review_flag": mentioned,
        "infrastructure_error": F.exists("decision.evaluators", lambda e: e["infrastructure_error"]), "lexical_hits": union(lambda h: h["code"]),
        "mitigations": F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda h: h["mitigations"])))), "rule_timeouts": F.when(F.array_contains(ran, "tier2.lexical"), F.col("_c.t2.timed_out")),
        "structural": F.when(F.array_contains(ran, "simulation") & macro, F.col("_c.structural")), "policy_like": F.coalesce("_c.policy_like", F.lit(False)),
        "judge_scores": F.when(judge_ok, F.col("scores")) if verdicts is not None else F.lit(None).cast("map<string,double>"),
    })
    d = d.withColumn("confirmed_tier3", confirmed_tier3(F.col("decision"), F.element_at("decision.evaluators", -1)["infrastructure_error"]))
    own = F.element_at("decision.evaluators", -1)["evaluator"]
    # Blocks before the model is called, floors and simulations never count towards the breaker.
    d = d.withColumn("breaker_violation", F.col("confirmed_tier3") & F.array_contains(ran, "output") & ~own.isin("seed_stock.floor", "simulation"))
    return d.drop("_c", "_p", "_hits", "judge", "judge_near", "scores")


def labelled(labels: Column, fields: Sequence[str]) -> Column:
    """The labels that an audit record may carry, as text; those that are absent or null are left out."""
    pairs = [F.when(labels[f].isNotNull(), F.struct(F.lit(f), labels[f].cast("string"))) for f in LABELS if f in fields]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull())) if pairs else F.create_map().cast("map<string,string>")


def audit_rows(decided: DataFrame, key: bytes, p: Limits = Limits(), include_text: bool = False) -> DataFrame:
    """Audit records of screened requests, digests in place of texts and of principals unless ``include_text``."""
    c = F.col
    dig = lambda x: keyed_digest(c(x), key) if x in decided.columns else F.lit(None).cast("string")
    text = lambda x: c(x) if include_text and x in decided.columns else F.lit(None).cast("string")
    own = lambda x, kind, or_: F.coalesce(c(x).cast(kind), or_) if x in decided.columns else or_.cast(kind)
    failed = c("decision.code") == "MODEL_ERROR"
    answered = F.when(F.exists("decision.evaluators", lambda e: e["evaluator"] == "output"), dig("completion"))  # else no model was asked, or it failed
    kind = decided.schema["labels"].dataType if "labels" in decided.columns else None
    labels = labelled(c("labels"), kind.fieldNames()) if kind is not None else F.create_map().cast("map<string,string>")
    yes = lambda x: F.coalesce(c(x), F.lit(False)) if x in decided.columns else F.lit(False)
    return decided.select(
        "audit_id", F.when(failed, "model_error").otherwise("decision").alias("kind"), "decision.status", "decision.tier", "decision.code", "decision.reason",
        F.lit(p.jurisdiction_id).alias("jurisdiction_id"), own("context", "string", F.lit(p.cultural_context)).alias("cultural_context"), own("tenant", "string", F.lit(None)).alias("tenant"),
        dig("principal").alias("principal_digest"), F.lit(p.policy_digest).cast("string").alias("policy_digest"), dig("prompt").alias("prompt_digest"), answered.alias("completion_digest"), labels.alias("labels"),
        F.transform(c("decision.evaluators"), lambda e: F.struct(e["evaluator"].alias("evaluator"), e["passed"].alias("passed"), e["code"].alias("code"))).alias("evaluators"),
        F.struct(
            (yes("affects_community") | yes("macro_policy")).alias("community_action"), yes("community_consent").alias("consent_asserted"), yes("macro_policy").alias("macro_policy"), "policy_like",
            own("unscreenable", "array<string>", F.lit(None)).alias("unscreened"), "rule_timeouts", "lexical_hits", "mitigations", "structural", "seed_stock",
        ).alias("governance_metadata"),
        F.struct(own("estimated_kwh", "double", F.lit(p.default_kwh)).alias("estimated_kwh"), own("carbon_intensity", "double", F.lit(p.default_carbon)).alias("carbon_intensity_g_kwh")).alias("energy"),
        own("channels", "array<string>", F.array(F.lit("text"))).alias("channels_screened"), "near_miss", "review_flag", "infrastructure_error", "confirmed_tier3", "judge_scores",
        text("prompt").alias("prompt"), text("completion").alias("completion"),
    )


def energy_rows(meters: DataFrame, p: Limits = Limits()) -> DataFrame:
    """Audit records of metered energy (audit_id, tenant, estimated_kwh, actual_kwh); unsound readings give none."""
    c = F.col
    return meters.filter(sound(c("actual_kwh")).isNotNull()).select(
        "audit_id", F.lit("energy").alias("kind"), F.lit("METERED").alias("status"), F.lit("ENERGY_RECONCILED").alias("code"), F.lit(p.jurisdiction_id).alias("jurisdiction_id"),
        F.lit(p.cultural_context).alias("cultural_context"), "tenant", F.struct(c("estimated_kwh").cast("double").alias("estimated_kwh"), c("actual_kwh").cast("double").alias("actual_kwh")).alias("energy"),
    )


def external(decided: DataFrame) -> DataFrame:
    """What a caller sees: the completion only if approved, else tier, code, reason and a reference to contest it."""
    ok = F.col("decision.status") == "APPROVED"
    return decided.select(
        "audit_id", "decision.status", F.when(ok, F.col("completion")).alias("completion"), F.when(~ok, F.col("decision.tier")).alias("tier"), F.when(~ok, F.col("decision.code")).alias("code"),
        F.when(~ok, F.col("decision.reason")).alias("reason"), F.when(~ok, F.concat(F.lit("contest:"), F.col("audit_id"))).alias("contest_ref"),
    )


def redacted(c: Column, secret: Sequence[str] = ("matched", "rationale")) -> Column:
    """JSON text without the keys of ``secret``, at any depth, in Arrow batches; text that is no JSON gives null."""
    import json

    drop = frozenset(secret)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(redact(json.loads(t), drop), ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return run(c)


def redact(v, secret: frozenset[str] = frozenset({"matched", "rationale"})):  # noqa: ANN001, ANN201
    """A nested value without the keys of ``secret``."""
    if isinstance(v, dict):
        return {k: redact(x, secret) for k, x in v.items() if k not in secret}
    return [redact(x, secret) for x in v] if isinstance(v, list) else v
