"""Thirteen statistical monitors over records and events; each gives rows of alerts, most often none.

Every monitor is one declarative plan; those that count decisions by day and label share one cube of counts. ``now`` is a
literal (:func:`observe` finds the default), as are the other moments that monitors compare. Days are counted from
the first decision, not from midnight. Rows tie by their order columns (seq, event_no). Alerts hold what a
reader may see in public; ``subject``, ``detail`` and ``evidence`` are restricted and go in :func:`public`.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sondage.functions.quantiles import exact_quantile, order_statistics
from sondage.functions.stats import crossing, dbl, ewma, poisson_tail, ratio, sound, trend
from sondage.plans.kpi import _hits, _true, refused
from sondage.plans.policy import review
from sondage.session import cut_lineage
from sondage.sources.audit import parse_time, with_key

ALERT = (
    "agent string, code string, severity string, title string, value double, level double, n bigint, predicted_at timestamp, confidence double, "
    "subject string, detail string, evidence array<string>"
)
RESTRICTED = ("subject", "detail", "evidence")
DAY_US = 86_400_000_000
#: Rule codes and their stage on the ladder of persecution.
STAGES = {
    "RELATIONAL_SCORING": 3, "HUMAN_WORTH_RANKING": 4, "JUSTIFICATION_LAUNDERING": 4, "DISSENT_SUPPRESSION": 5, "COERCIVE_SURVEILLANCE": 5,
    "COGNITIVE_MANIPULATION": 6, "ARBITRARY_CONFINEMENT_OR_FORCED_LABOUR": 8, "POPULATION_HARM": 9,
}
SEVERITY = {"critical": 0, "warning": 1, "info": 2}


_us = lambda c: F.unix_micros(c)
_when = lambda us: F.timestamp_micros(us.cast("bigint"))


@dataclass(frozen=True)
class Observed:
    """Records, events and the moment from which they are looked at, with what one scan told about the records.

    ``origin`` is the time of the first decision and ``budget_from`` that of the first with a budget, ``pivot`` the last policy
    change (microseconds since 1970, null for none), ``failures`` the most sink failures of a record.
    """

    audit: DataFrame
    events: DataFrame
    now: datetime
    origin: int | None = None
    budget_from: int | None = None
    pivot: int | None = None
    failures: int = 0

    @property
    def decisions(self) -> DataFrame:
        return self.audit.filter("kind = 'decision'")

    def of(self, kind: str) -> DataFrame:
        return self.events.filter(F.col("type") == kind)

    @property
    def at(self) -> Column:
        """``now`` as a literal in microseconds since 1970."""
        return F.lit(int(parse_time(self.now).timestamp() * 1_000_000 + 0.5))

    @property
    def start(self) -> Column:
        return F.lit(self.origin).cast("bigint")

    @cached_property
    def cube(self) -> DataFrame:
        """Decisions counted by day since the origin, labels, and side of the moments that monitors compare; written once.

        (day, language, topic, cohort, recent, changed, n, near, refused, learning, scaffold, unsimulated). Its size goes by
        the days and label values, not by the decisions.
        """
        c = F.col
        t = _us("timestamp")
        label = lambda x: F.nullif(c(f"labels.{x}"), F.lit("")).alias(x)
        learning = (c("capability.context") == "learning").eqNullSafe(F.lit(True))
        policy = (c("status") == "APPROVED") & _true("governance_metadata.policy_like") & ~_true("governance_metadata.macro_policy")
        day = F.floor((t - self.start) / F.lit(DAY_US)).cast("bigint").alias("day")
        sides = [(t >= self.at - 2 * DAY_US).alias("recent"), (t >= F.lit(self.pivot).cast("bigint")).alias("changed")]
        rows = self.decisions.groupBy(day, label("language"), label("topic"), label("cohort"), *sides)
        return cut_lineage(rows.agg(
            F.count("*").alias("n"), _hits(c("near_miss")).alias("near"), _hits(refused()).alias("refused"), _hits(learning).alias("learning"),
            _hits(learning & c("capability.mode").isin("scaffold", "mixed")).alias("scaffold"), _hits(policy).alias("unsimulated"),
        ))


def observe(audit: DataFrame, events: DataFrame, now: datetime | None = None) -> Observed:
    """One scan of the records and one of the policy changes; a few numbers come back. ``now`` is the last record's time by default."""
    audit, events = with_key(audit), with_key(events)
    t, d = _us("timestamp"), F.col("kind") == "decision"
    point = (F.col("energy.budget_used_kwh") + F.col("energy.budget_remaining_kwh")).isNotNull()
    r = audit.agg(F.max(t).alias("last"), F.min(F.when(d, t)).alias("origin"), F.min(F.when(d & point, t)).alias("budget"), F.max("sink_failures").alias("failures")).first()
    pivot = events.filter("type = 'policy_change'").agg(F.max(t).alias("p")).first()["p"]
    last = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=r["last"] or 0)
    return Observed(audit, events, now or last, r["origin"], r["budget"], pivot, r["failures"] or 0)


def _alerts(df: DataFrame, agent: str, code: str | Column, severity: str | Column, title: str | Column, **cols: Column) -> DataFrame:
    none = {"value": "double", "level": "double", "n": "bigint", "predicted_at": "timestamp", "confidence": "double", "subject": "string", "detail": "string", "evidence": "array<string>"}
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(agent).alias("agent"), as_col(code).alias("code"), as_col(severity).alias("severity"), as_col(title).alias("title"),
        *[(cols[c] if c in cols else F.lit(None)).cast(t).alias(c) for c, t in none.items()],
    )


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def daily_rates(o: Observed, hits: str, of: str = "n", least: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(<by>, day, n, rate): shares per day since the first decision, from the cube; days with fewer than ``least`` rows, and nameless groups, left out."""
    rows = o.cube
    for c in by:
        rows = rows.filter(F.col(c).isNotNull())
    days = rows.groupBy(*by, "day").agg(F.sum(of).alias("n"), F.sum(hits).alias("hits")).filter(F.col("n") >= max(1, least))
    return days.select(*by, "day", "n", ratio(F.col("hits"), F.col("n")).alias("rate"))


def smoothed(points: DataFrame, by: list[str], x: str = "day", y: str = "rate", last: int = 3) -> DataFrame:
    """(<by>, points, latest): the mean of the last three points."""
    w = W.partitionBy(*by).orderBy(F.desc(x))
    return points.withColumn("_r", F.row_number().over(w)).groupBy(*by).agg(F.count("*").alias("points"), F.avg(F.when(F.col("_r") <= last, F.col(y))).alias("latest"))


def breaker_precursor(o: Observed, threshold: int = 5, window_s: int = 300, principals: int = 3, lookback_s: int = 3600, probability: float = 0.5) -> DataFrame:
    """CA-1: a caller, or the whole system, is about to trip the breaker."""
    age = o.at - _us("timestamp")
    recent = o.decisions.filter(age <= lookback_s * 1_000_000).withColumn("who", F.coalesce(F.nullif("principal_digest", F.lit("")), F.lit("anonymous")))
    now_too = F.col("confirmed_tier3") & (age <= window_s * 1_000_000)
    # The first ten ids as a bounded aggregate: the ten smallest positions, kept in order.
    first = recent.filter(_true("confirmed_tier3")).withColumn("_r", F.row_number().over(W.partitionBy("who").orderBy("seq"))).filter("_r <= 10")
    evidence = first.groupBy("who").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "audit_id"))), lambda x: x["audit_id"]).alias("evidence"))
    each = recent.groupBy("who").agg(
        _hits(F.col("confirmed_tier3")).alias("count"), _hits(F.col("near_miss")).alias("near"), _hits(now_too).alias("current"), F.min(F.when(F.col("confirmed_tier3"), _us("timestamp"))).alias("first")
    )
    c = F.col
    p = poisson_tail(c("count") / lookback_s * window_s, threshold - c("current"))
    own = (
        each.filter((c("count") > 0) & (c("current") < threshold)).withColumn("p", p)
        .filter((c("p") >= probability) | ((c("near") >= 2) & (c("count") >= 2))).join(evidence, "who", "left")
    )
    eta = o.at + (threshold - c("current")) / (c("count") / dbl(lookback_s)) * 1e6
    whole = each.agg(
        F.count_if(c("count") > 0).alias("callers"), F.sum("count").alias("total"), F.sum("current").alias("current"), F.count_if(c("current") > 0).alias("in_window"), F.min("first").alias("first")
    )
    span = F.greatest((o.at - c("first")) / 1e6, dbl(window_s))
    already = (c("current") >= threshold) & (c("in_window") >= principals)
    whole = whole.filter((c("callers") >= max(2, principals - 1)) & ~already).withColumn("p", poisson_tail(c("total") / span * window_s, threshold - c("current"))).filter(c("p") >= probability)
    return _all(
        _alerts(own, "CA-1", "PRINCIPAL_TRIP_LIKELY", "warning", "A caller is close to suspension", value=c("p"), level=dbl(probability), n=c("count"), predicted_at=_when(eta),
                confidence=F.round("p", 3), subject=c("who"), evidence=c("evidence")),
        _alerts(whole, "CA-1", "GLOBAL_TRIP_LIKELY", "critical", "A system-wide stop is likely", value=c("p"), level=dbl(probability), n=c("total"), confidence=F.round("p", 3)),
    )


def budget_burn(o: Observed, alpha: float = 0.3) -> DataFrame:
    """(used, limit, burn): the latest point of the cumulative budget, and the smoothed use per day between days with points."""
    used, rest = F.col("energy.budget_used_kwh"), F.col("energy.budget_remaining_kwh")
    points = o.decisions.select(_us("timestamp").alias("t"), "seq", used.alias("used"), (used + rest).alias("limit")).filter("used IS NOT NULL AND limit IS NOT NULL")
    days = points.groupBy(F.floor((F.col("t") - F.lit(o.budget_from).cast("bigint")) / F.lit(DAY_US)).alias("day")).agg(F.max(F.struct("t", "used", "limit", "seq")).alias("last"))
    # One row a day from here on.
    ends = days.agg(F.array_sort(F.collect_list(F.struct("day", F.col("last.used").alias("used")))).alias("a"), F.max("last").alias("last"), F.count("*").alias("days"))
    steps = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("a") - 1, F.lit(1))),
        lambda i: ratio(F.get("a", i)["used"] - F.get("a", i - 1)["used"], F.get("a", i)["day"] - F.get("a", i - 1)["day"]),
    )
    return ends.select("last.used", "last.limit", "days", F.when(F.col("days") >= 2, ewma(steps, alpha)).alias("burn"))


def misreporting(o: Observed) -> DataFrame:
    """(tenant, n, median): metered over estimated energy per tenant; the tenant is the decision's where it is there."""
    est, act = sound(F.col("energy.estimated_kwh")), sound(F.col("energy.actual_kwh"))
    meters = o.audit.filter("kind = 'energy'").select("key", "tenant", est.alias("est"), act.alias("act")).filter("est > 0 AND act IS NOT NULL")
    known = o.decisions.filter("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("tenant"), "seq").alias("d"))
    own = F.when(F.col("d").isNotNull(), F.col("d.tenant")).otherwise(F.col("tenant"))
    ratios = meters.join(known, "key", "left").select(F.coalesce(F.nullif(own, F.lit("")), F.lit("default")).alias("tenant"), (F.col("act") / F.col("est")).alias("r"))
    return exact_quantile(cut_lineage(ratios), ["tenant"], "r", 0.5).withColumnRenamed("quantile", "median")  # joined once, read by each pass


def carbon_thirds(o: Observed) -> DataFrame:
    """(n, early, late): mean carbon intensity of the first and the last n // 3 readings by time, then by value; one row.

    The times at which the thirds end are exact order statistics; readings of just these moments are then taken by value, as
    counts of distinct ones. No reading is sorted into one task.
    """
    c = F.col
    r = o.decisions.select(_us("timestamp").alias("t"), sound(c("energy.carbon_intensity_g_kwh")).alias("c")).filter("c IS NOT NULL AND t IS NOT NULL")
    third = lambda n: F.floor(n / 3)
    at = order_statistics(r, [], "t", [lambda n: F.nullif(third(n), F.lit(0)) - 1, lambda n: F.when(third(n) > 0, n - third(n))])
    marked = r.crossJoin(F.broadcast(at.select("n", third(c("n")).alias("k"), F.get("values", F.lit(0)).cast("bigint").alias("lo"), F.get("values", F.lit(1)).cast("bigint").alias("hi"))))
    # Whole sums outside of the two moments, and one row for each different value at them.
    side = F.when(c("t") == c("lo"), "lo").when(c("t") < c("lo"), "early")
    after = F.when(c("t") == c("hi"), "hi").when(c("t") > c("hi"), "late")
    cells = marked.select("n", "k", "c", F.explode(F.array(side, after)).alias("part")).filter("part IS NOT NULL")
    cells = cells.groupBy("n", "k", "part", F.when(c("part").isin("lo", "hi"), c("c")).alias("v")).agg(F.count("*").alias("m"), F.sum("c").alias("s"))
    whole = F.broadcast(cells.groupBy("n", "k").agg(*[F.coalesce(f(F.when(c("part") == p, c(x))), F.lit(0)).alias(f"{p}_{x}") for p in ("early", "late") for x, f in (("m", F.sum), ("s", F.sum))]))
    edge = cells.filter(c("part").isin("lo", "hi")).withColumn("rank", F.sum("m").over(W.partitionBy("part").orderBy(F.when(c("part") == "lo", c("v")).otherwise(-c("v")))))
    taken = edge.join(whole, ["n", "k"]).withColumn("left", c("k") - F.when(c("part") == "lo", c("early_m")).otherwise(c("late_m")))
    use = F.greatest(F.lit(0), F.least(c("m"), c("left") - (c("rank") - c("m"))))
    sums = taken.groupBy("n", "k", "early_s", "late_s").agg(*[F.coalesce(F.sum(F.when(c("part") == p, use * c("v"))), dbl(0.0)).alias(p) for p in ("lo", "hi")])
    return sums.select("n", ((c("early_s") + c("lo")) / c("k")).alias("early"), ((c("late_s") + c("hi")) / c("k")).alias("late"))


def energy_steward(o: Observed, horizon_days: float = 7, least: int = 20, misreport: float = 1.5, rise: float = 1.2) -> DataFrame:
    """CA-2: the budget runs out soon, a tenant's estimates are too low, or the grid's carbon intensity rises."""
    c = F.col
    burn = budget_burn(o)
    left = (c("limit") - c("used")) / c("burn")
    burn = burn.filter((c("burn") > 0) & (c("limit") > c("used"))).filter(left <= horizon_days)
    low = misreporting(o).filter((c("n") >= least) & (c("median") >= misreport))
    dirty = carbon_thirds(o).filter((c("n") >= 2 * least) & (c("early") > 0) & (c("late") / c("early") >= rise))
    return _all(
        _alerts(burn, "CA-2", "BUDGET_EXHAUSTION_FORECAST", "warning", "The energy budget runs out soon", value=left, level=dbl(horizon_days), predicted_at=_when(o.at + left * DAY_US), confidence=dbl(0.7)),
        _alerts(low, "CA-2", "ENERGY_UNDER_REPORTING", "warning", "Energy estimates are too low", value=c("median"), level=dbl(misreport), n=c("n"), confidence=dbl(0.8), subject=c("tenant")),
        _alerts(dirty, "CA-2", "CARBON_INTENSITY_RISING", "info", "Carbon intensity rises", value=c("late") / c("early"), level=dbl(rise), n=c("n")),
    )


def cusum(points: DataFrame, baseline: int = 7, slack: float = 0.02, x: str = "day", y: str = "rate") -> DataFrame:
    """(<x>, <y>, base, s): the one-sided cumulative sum after the baseline, as prefix sum less its running minimum."""
    order = W.orderBy(x)
    numbered = points.withColumn("_i", F.row_number().over(order))
    base = F.broadcast(points.sparkSession.createDataFrame([(0,)], "one int").crossJoin(numbered.filter(F.col("_i") <= baseline).agg(F.avg(y).alias("base"))).select("base"))
    after = numbered.filter(F.col("_i") > baseline).crossJoin(base)
    run = order.rowsBetween(W.unboundedPreceding, 0)
    p = after.withColumn("_p", F.sum(F.col(y) - F.col("base") - slack).over(run))
    return p.withColumn("s", F.col("_p") - F.least(dbl(0.0), F.min("_p").over(run))).select(x, y, "base", "s")


def drift(o: Observed, amber: float = 0.15, slack: float = 0.02, alarm: float = 0.08, baseline: int = 7, horizon: float = 30) -> DataFrame:
    """CA-3: near misses creep up but are not yet past the amber level. One row a day goes through the window."""
    c = F.col
    series = daily_rates(o, "near")
    s = cusum(series, baseline, slack)
    one = lambda d: F.broadcast(d)
    line = trend(s, [], "day", "rate")
    found = (
        s.agg(F.min(F.when(c("s") > alarm, c("day"))).alias("alarm_day"), F.max("base").alias("base"))
        .crossJoin(one(smoothed(series.withColumn("_", F.lit(1)), ["_"]).drop("_").withColumnRenamed("points", "total")))
        .crossJoin(one(line))
        .filter(c("alarm_day").isNotNull() & (c("latest") < amber) & (c("total") >= baseline + 2))
    )
    at = crossing(c("slope"), c("intercept"), amber, c("last_x"), True)
    at = F.when(at - c("last_x") <= horizon, at)
    return _alerts(found, "CA-3", "NEAR_MISS_DRIFT", "warning", "Near misses creep up", value=c("latest"), level=dbl(amber), n=c("total"), predicted_at=_when(o.start + at * DAY_US),
                   confidence=dbl(0.6), detail=F.format_string("alarm on day %d, baseline %.3f", "alarm_day", "base"))


def over_blocking(o: Observed, spike: float = 2.0, least: int = 20, limit: float = 0.15) -> DataFrame:
    """CA-4: protected items blocked, refusals that double in a language or topic, appeals often upheld."""
    c = F.col
    canary = o.of("canary_result").filter("passed < total")
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c(d).alias("member")) for d in ("language", "topic")]))
    of = lambda x, new: F.sum(F.when(c("recent") if new else ~c("recent"), c(x)).otherwise(0))
    rates = (
        o.cube.select(dims.alias("m"), "recent", "n", "refused").filter("m.member IS NOT NULL AND recent IS NOT NULL").groupBy("m.dim", "m.member")
        .agg(of("n", False).alias("n_old"), of("n", True).alias("n_new"), ratio(of("refused", False), of("n", False)).alias("old"), ratio(of("refused", True), of("n", True)).alias("rate"))
        .filter((c("n_old") >= least) & (c("n_new") >= least)).filter(c("rate") >= F.greatest(spike * c("old"), dbl(0.05)))
    )
    worst = rates.groupBy("dim").agg(F.max(F.struct("rate", "old", "member")).alias("w"), F.count("*").alias("n"))
    upheld = o.of("appeal_outcome").agg(F.count("*").alias("n"), ratio(_hits(c("upheld")), F.count("*")).alias("share")).filter((c("n") >= least) & (c("share") > limit))
    return _all(
        _alerts(canary, "CA-4", "CANARY_FAILURE", "critical", "Protected items were blocked", value=dbl(c("total") - c("passed")), n=c("total"), detail=c("corpus")),
        _alerts(worst, "CA-4", "REFUSAL_SPIKE", "warning", "Refusals rise sharply", value=c("w.rate"), level=c("w.old"), n=c("n"), confidence=dbl(0.7), subject=F.concat_ws(":", "dim", "w.member")),
        _alerts(upheld, "CA-4", "APPEALS_OFTEN_UPHELD", "warning", "Many refusals are overturned", value=c("share"), level=dbl(limit), n=c("n")),
    )


def rule_timeouts(o: Observed) -> DataFrame:
    """CA-5, its part over records: rules that ran out of time."""
    late = o.decisions.filter(F.size("governance_metadata.rule_timeouts") > 0).agg(F.count("*").alias("n"), F.min_by(F.struct("audit_id", "governance_metadata.rule_timeouts"), "seq").alias("first")).filter("n > 0")
    return _alerts(late, "CA-5", "RULE_TIMEOUT", "warning", "Rules ran out of time", n=F.col("n"), detail=F.to_json("first"), evidence=F.array("first.audit_id"))


def policy_governance(o: Observed) -> DataFrame:
    """CA-5: every policy change reviewed (invalid documents, relaxed safeguards, another issuer, risky patterns), and rules that ran out of time."""
    changes = o.of("policy_change").select("event_no", "old", "new")
    names = {
        "POLICY_INVALID": "A new policy is not valid", "POLICY_RELAXATION": "A new policy relaxes a safeguard",
        "ISSUER_CHANGED": "A new policy has another issuer", "RISKY_PATTERN": "A new rule has a risky pattern",
    }
    title = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("code"))
    found = review(changes)
    shown = F.concat(title, F.when(F.col("path") != "", F.concat(F.lit(": "), "path")).otherwise(""))
    return _all(_alerts(found, "CA-5", F.col("code"), F.col("severity"), shown, n=F.col("event_no"), subject=F.nullif("path", F.lit("")), detail=F.col("detail")), rule_timeouts(o))


def clock_skew(o: Observed, tolerance_s: float = 5, block: int = 100_000) -> DataFrame:
    """(seq, back_s): records whose time is before that of the record ahead of them, in order of ``seq``.

    The order is global, so rows are compared within blocks of consecutive ``seq``, and each block's first row with
    the last one of the blocks before it; no window runs over the whole trail.
    """
    t = o.audit.filter("timestamp IS NOT NULL").select("seq", _us("timestamp").alias("t"), F.floor(F.col("seq") / F.lit(block)).alias("b"))
    w = W.partitionBy("b").orderBy("seq")
    within = t.withColumn("before", F.lag("t").over(w))
    ends = t.groupBy("b").agg(F.max_by("t", "seq").alias("end"))
    prior = ends.withColumn("prior", F.lag("end").over(W.orderBy("b"))).select("b", "prior")  # a row for each block
    full = within.join(prior, "b", "left").withColumn("back", F.coalesce("before", "prior") - F.col("t"))
    return full.filter(F.col("back") > tolerance_s * 1_000_000).select("seq", (F.col("back") / 1e6).alias("back_s"))


def integrity(o: Observed, broken: int = 0) -> DataFrame:
    """CA-6: a broken chain (``broken`` links, from the chain's verification), sinks that fail, clocks that run back."""
    c = F.col
    failed = o.audit.sparkSession.createDataFrame([(o.failures,)] if o.failures > 0 else [], "n bigint")
    skew = clock_skew(o).agg(F.count("*").alias("n"), F.max("back_s").alias("v")).filter("n > 0")
    chain = o.audit.sparkSession.createDataFrame([(broken,)] if broken else [], "n bigint")
    return _all(
        _alerts(chain, "CA-6", "AUDIT_CHAIN_BROKEN", "critical", "The audit chain is broken", n=c("n")),
        _alerts(failed, "CA-6", "AUDIT_SINK_FAILURES", "warning", "Audit records were lost by a sink", n=c("n")),
        _alerts(skew, "CA-6", "AUDIT_CLOCK_SKEW", "warning", "Record times run backwards", value=c("v"), n=c("n")),
    )


def consent(o: Observed, limit: float = 0.1, sla_h: int = 72, least: int = 10) -> DataFrame:
    """CA-7: community actions without verified consent, and revocations that are due."""
    c = F.col
    acts = o.decisions.filter(_true("governance_metadata.community_action")).select("key")
    verified = o.of("consent_verified").filter("key IS NOT NULL").select("key", F.lit(True).alias("ok")).distinct()
    missing = acts.join(verified, "key", "left").agg(F.count("*").alias("n"), ratio(F.count_if(c("ok").isNull()), F.count("*")).alias("share"))
    due = _us("revoked_at") + sla_h * 3_600_000_000
    open_ = o.of("consent_revoked").filter("honoured_at IS NULL").withColumn("due", due).filter(c("due") - o.at <= DAY_US)
    over = o.at > c("due")
    return _all(
        _alerts(missing.filter((c("n") >= least) & (c("share") > limit)), "CA-7", "CONSENT_UNVERIFIED", "warning", "Community actions without verified consent", value=c("share"), level=dbl(limit), n=c("n")),
        _alerts(open_, "CA-7", F.when(over, "REVOCATION_OVERDUE").otherwise("REVOCATION_DUE_SOON"), F.when(over, "critical").otherwise("warning"), "A revocation is not honoured", predicted_at=_when(c("due"))),
    )


def skipped_simulation(o: Observed, least: int = 3) -> DataFrame:
    """CA-8: approved outputs that read like policy but were not simulated."""
    g = "governance_metadata."
    rows = o.decisions.filter((F.col("status") == "APPROVED") & _true(g + "policy_like") & ~_true(g + "macro_policy"))
    first = rows.orderBy("seq").limit(10).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "audit_id"))), lambda x: x["audit_id"]).alias("evidence"))
    n = o.cube.agg(F.sum("unsimulated").alias("n")).filter(F.col("n") >= least)
    return _alerts(n.crossJoin(F.broadcast(first)), "CA-8", "SIMULATION_SKIPPED", "warning", "Policy-like outputs were not simulated", n=F.col("n"), level=dbl(least), evidence=F.col("evidence"))


def incidents(o: Observed, deadline_d: int = 15, warn_d: int = 3) -> DataFrame:
    """CA-9: confirmed incidents that are not reported and due soon or overdue."""
    reported = o.of("incident_reported").filter("key IS NOT NULL").select("key").distinct()
    late = o.decisions.filter(_true("confirmed_tier3")).join(reported, "key", "left_anti").withColumn("due", _us("timestamp") + deadline_d * DAY_US).filter(F.col("due") - o.at <= warn_d * DAY_US)
    over = o.at > F.col("due")
    return _alerts(late, "CA-9", F.when(over, "INCIDENT_OVERDUE").otherwise("INCIDENT_DUE_SOON"), F.when(over, "critical").otherwise("warning"), "An incident is not reported",
                   predicted_at=_when(F.col("due")), detail=F.to_json(F.struct("audit_id", "code", "tier", "jurisdiction_id")), evidence=F.array("audit_id"))


def atrophy(o: Observed, floor: float = 0.4, per_day: int = 5, horizon: float = 30) -> DataFrame:
    """CA-10: learners in a cohort get ever less scaffolding."""
    c = F.col
    days = o.cube.filter("learning > 0").groupBy(F.coalesce("cohort", F.lit("all")).alias("cohort"), "day").agg(F.sum("learning").alias("n"), F.sum("scaffold").alias("hits"))
    series = days.filter(c("n") >= per_day).select("cohort", "day", "n", ratio(c("hits"), c("n")).alias("rate"))
    line = trend(series, ["cohort"], "day", "rate").drop("points").join(smoothed(series, ["cohort"]), "cohort")
    at = crossing(c("slope"), c("intercept"), floor, c("last_x"), False)
    found = line.filter((c("points") >= 4) & (c("latest") >= floor)).withColumn("at", at).filter(c("at") - c("last_x") <= horizon)
    return _alerts(found, "CA-10", "SCAFFOLDING_DECLINING", "warning", "Scaffolding declines", value=c("latest"), level=dbl(floor), n=c("points"), predicted_at=_when(o.start + c("at") * DAY_US),
                   confidence=dbl(0.6), subject=c("cohort"))


def diversity(o: Observed, disparity: float = 1.25, drop: float = 0.5, least: int = 20) -> DataFrame:
    """CA-11: refusals differ between languages, or a language's traffic falls after the last policy change."""
    c = F.col
    side = lambda changed: F.sum(F.when(c("changed") if changed else ~c("changed"), c("n")).otherwise(0))
    each = o.cube.filter("language IS NOT NULL").groupBy("language").agg(F.sum("n").alias("n"), ratio(F.sum("refused"), F.sum("n")).alias("rate"), side(False).alias("before"), side(True).alias("after"))
    rated = each.filter(c("n") >= least).agg(F.max("rate").alias("hi"), F.min("rate").alias("lo"), F.count("*").alias("n"), F.max_by("language", F.struct("rate", "language")).alias("worst"))
    r = (c("hi") + 0.001) / (c("lo") + 0.001)
    pivot = F.lit(o.pivot).cast("bigint")
    a = c("after") / F.greatest((o.at - pivot) / 1e6, dbl(1.0))
    b = c("before") / F.greatest((pivot - o.start) / 1e6, dbl(1.0))
    gone = each.filter((c("before") >= least) & pivot.isNotNull()).withColumns({"ra": a, "rb": b}).filter(c("ra") < (1 - drop) * c("rb"))
    return _all(
        _alerts(rated.filter((c("n") >= 2) & (r > disparity)), "CA-11", "REFUSAL_DISPARITY", "warning", "Refusals differ between languages", value=r, level=dbl(disparity), n=c("n"), subject=c("worst")),
        _alerts(gone, "CA-11", "SILENT_EXCLUSION", "warning", "A language's traffic fell after a policy change", value=c("ra") / c("rb"), level=dbl(1 - drop), n=c("before"), subject=c("language")),
    )


def precursors(o: Observed, least: int = 3, window_d: int = 14) -> DataFrame:
    """CA-12: signals about a target group that climb the ladder: the highest stage of the first half against that of the second.

    A stage is in the first half if its first signal is, and in the second if its last one is. So only the ranks of two
    signals a stage are needed, and those are counts; no subject's signals are sorted into one task.
    """
    c = F.col
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    codes = F.array_union(F.array(F.coalesce("code", F.lit(""))), F.coalesce("governance_metadata.lexical_hits", F.array().cast("array<string>")))
    top = F.array_max(F.transform(codes, lambda x: F.element_at(stage, x)))
    subject = F.concat_ws("/", F.coalesce(F.nullif("tenant", F.lit("")), F.lit("default")), F.coalesce(F.nullif(c("labels.target_group"), F.lit("")), F.lit("unspecified")))
    s = o.decisions.filter(_us("timestamp") >= o.at - window_d * DAY_US).select(subject.alias("subject"), _us("timestamp").alias("t"), top.alias("stage")).filter("stage IS NOT NULL")
    s = cut_lineage(s)  # the signals of two weeks, read twice
    kinds = sorted(set(STAGES.values()))
    ends = s.groupBy("subject").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "stage"))["stage"].alias("first"),
        *[f(F.when(c("stage") == k, c("t"))).alias(f"{name}{k}") for k in kinds for name, f in (("f", F.min), ("l", F.max))],
    ).filter(c("n") >= least)
    before = lambda k: (c("t") < c(f"f{k}")) | ((c("t") == c(f"f{k}")) & (c("stage") < k))
    upto = lambda k: (c("t") < c(f"l{k}")) | ((c("t") == c(f"l{k}")) & (c("stage") <= k))
    ranks = s.join(ends, "subject").groupBy("subject", "n", "first").agg(
        *[F.when(F.first(f"f{k}").isNotNull(), F.count_if(before(k))).alias(f"b{k}") for k in kinds], *[F.when(F.first(f"f{k}").isNotNull(), F.count_if(upto(k))).alias(f"u{k}") for k in kinds]
    )
    half = F.floor(c("n") / 2)
    highest = lambda conds: F.greatest(*[F.when(x, k) for k, x in zip(kinds, conds)])
    found = ranks.withColumns({"early": F.coalesce(highest([c(f"b{k}") < half for k in kinds]), c("first")), "late": highest([c(f"u{k}") > half for k in kinds])})
    found = found.filter((c("late") > c("early")) | (c("late") >= 4))
    return _alerts(found, "CA-12", "ATROCITY_PRECURSOR_ESCALATION", F.when(c("late") >= 5, "critical").otherwise("warning"), "Signals of dehumanisation escalate", value=dbl(c("late")), level=dbl(c("early")),
                   n=c("n"), confidence=dbl(0.5), subject=c("subject"))


def flow_ratios(o: Observed) -> DataFrame:
    """(region, day, ratio, o, t0): returned over extracted value, both summed up to each event, by whole days since a region's first.

    Sums run within blocks of an hour and are carried from block to block, so a region's events are never one task.
    """
    e = o.of("value_flow").select(F.coalesce("region", F.lit("None")).alias("region"), _us("timestamp").alias("t"), "event_no", F.coalesce("extracted", dbl(0.0)).alias("x"), F.coalesce("returned", dbl(0.0)).alias("r"))
    e = e.withColumn("b", F.floor(F.col("t") / F.lit(3_600_000_000)))
    blocks = e.groupBy("region", "b").agg(F.sum("x").alias("bx"), F.sum("r").alias("br"), F.min("t").alias("bt"))
    prior = W.partitionBy("region").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        "region", "b", F.coalesce(F.sum("bx").over(prior), dbl(0.0)).alias("px"), F.coalesce(F.sum("br").over(prior), dbl(0.0)).alias("pr"), F.min("bt").over(W.partitionBy("region")).alias("t0")
    )
    w = W.partitionBy("region", "b").orderBy("t", "event_no").rowsBetween(W.unboundedPreceding, 0)
    p = e.withColumns({"ox": F.sum("x").over(w), "orr": F.sum("r").over(w)}).join(carried, ["region", "b"]).withColumns({"sx": F.col("px") + F.col("ox"), "sr": F.col("pr") + F.col("orr")}).filter("sx > 0")
    return p.select("region", F.floor((F.col("t") - F.col("t0")) / F.lit(DAY_US)).alias("day"), (F.col("sr") / F.col("sx")).alias("ratio"), F.struct("t", "event_no").alias("o"), "t0")


def extraction(o: Observed, target: float = 0.5, floor: float = 0.2) -> DataFrame:
    """CA-13: regions that get too little back, or soon will, and regions with little capacity of their own."""
    c = F.col
    p = flow_ratios(o)
    line = trend(p, ["region"], "day", "ratio").join(p.groupBy("region").agg(F.max_by("ratio", "o").alias("ratio"), F.max("t0").alias("t0")), "region")
    at = F.when(c("ratio") >= target, crossing(c("slope"), c("intercept"), target, c("last_x"), False))
    found = line.withColumn("at", at).filter((c("ratio") < target) | c("at").isNotNull())
    weak = o.of("capacity").filter(c("local_share") < floor)
    return _all(
        _alerts(found, "CA-13", "VALUE_RETURN_GAP", F.when(c("ratio") < target, "critical").otherwise("warning"), "Too little value returns", value=c("ratio"), level=dbl(target), n=c("points"),
                predicted_at=_when(c("t0") + c("at") * DAY_US), subject=c("region")),
        _alerts(weak, "CA-13", "LOW_LOCAL_CAPACITY", "info", "Little local capacity", value=c("local_share"), level=dbl(floor), subject=c("region")),
    )


AGENTS = {
    "CA-1": breaker_precursor, "CA-2": energy_steward, "CA-3": drift, "CA-4": over_blocking, "CA-5": policy_governance, "CA-6": integrity, "CA-7": consent,
    "CA-8": skipped_simulation, "CA-9": incidents, "CA-10": atrophy, "CA-11": diversity, "CA-12": precursors, "CA-13": extraction,
}


def assess(o: Observed, agents: dict | None = None) -> DataFrame:
    """The alerts of all monitors, most severe first, then by agent and code as text."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity"))
    return _all(*[f(o) for f in (agents or AGENTS).values()]).withColumn("raised_at", _when(o.at)).orderBy(rank, "agent", "code", "subject")


def public(alerts: DataFrame) -> DataFrame:
    """Alerts without what is restricted."""
    return alerts.drop(*RESTRICTED)
