"""Queries of the monitors, scorecards, screening and state operators over the audit tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.digests import keyed_digest
from sondage.functions.ids import clean_name
from sondage.functions.stats import poisson_tail, size_band, sound
from sondage.functions.text import estimated_kwh, sentences, size_guard
from sondage.operators import decisions, rules, state
from sondage.plans import kpi, kpi_queries, monitors, policy, scorecard, snapshot
from sondage.plans.kpi_queries import K, inputs, views_sql
from sondage.sources.audit import audit_view, events_view
from sondage.sources.tables import table

KEY = b"a key for tests"
US = "epoch_us"


def _observed(spark: SparkSession, folder: str) -> monitors.Observed:
    return monitors.observe(audit_view(spark, folder), events_view(spark, folder))


def _r(c: str, n: int = 9):  # noqa: ANN202
    return F.round(c, n).alias(c)


# --- scorecards and snapshot ---
def scorecards(spark: SparkSession, folder: str) -> DataFrame:
    cards = scorecard.scorecards(inputs(spark, folder, "model"))
    return cards.select("model", "n_band", "harm", "struggle", "fairness", "rated_kpis", "score", "grade", F.size("caps").alias("caps"))


def _sql_scorecards() -> str:
    groups = ", ".join(f"('{k}', '{g}')" for g, ids in scorecard.GROUPS.items() for k in ids)
    caps = ", ".join(f"'{k}'" for k in scorecard.CAPS)
    grade = "CASE " + " ".join(f"WHEN m >= {cut} THEN '{x}'" for cut, x in scorecard.GRADES) + " ELSE 'F' END"
    return f"""
WITH t AS ({kpi_queries.SQL["kpi_by_model"]}), gr(kpi, grp) AS (VALUES {groups}),
p AS (SELECT t.g, t.kpi, grp, status, CASE status WHEN 'green' THEN 1.0::DOUBLE WHEN 'amber' THEN 0.5::DOUBLE WHEN 'red' THEN 0.0::DOUBLE END AS pt FROM t JOIN gr ON t.kpi = gr.kpi),
c AS (SELECT g, round(avg(pt) FILTER (WHERE grp = 'harm'), 4) AS harm, round(avg(pt) FILTER (WHERE grp = 'struggle'), 4) AS struggle, round(avg(pt) FILTER (WHERE grp = 'fairness'), 4) AS fairness,
  count(pt) AS rated_kpis, count(CASE WHEN status = 'red' AND kpi IN ({caps}) THEN 1 END) AS caps FROM p GROUP BY g),
s AS (SELECT c.*, n, (coalesce(harm, 0) + coalesce(struggle, 0) + coalesce(fairness, 0)) / nullif((harm IS NOT NULL)::INT + (struggle IS NOT NULL)::INT + (fairness IS NOT NULL)::INT, 0) AS m,
  n >= {K} AND rated_kpis >= 4 AND (harm IS NOT NULL)::INT + (struggle IS NOT NULL)::INT + (fairness IS NOT NULL)::INT >= 2 AS ok FROM c JOIN (SELECT g, n FROM t WHERE kpi = 'K-01') USING (g))
SELECT g AS model, {_BAND.format(n='n')} AS n_band, harm, struggle, fairness, rated_kpis, CASE WHEN ok THEN round(m, 4) END AS score,
  CASE WHEN ok THEN CASE WHEN caps > 0 THEN greatest({grade}, 'C') ELSE {grade} END END AS grade, CAST(CASE WHEN ok THEN caps ELSE 0 END AS INTEGER) AS caps FROM s"""


_BAND = "CASE WHEN {n} < 20 THEN '1-19' WHEN {n} < 100 THEN '20-99' WHEN {n} < 1000 THEN '100-999' WHEN {n} < 10000 THEN '1k-10k' ELSE '10k+' END"


def public_snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    r = snapshot.published(kpi.compute(inputs(spark, folder))[0], K)
    return r.select("kpi", "value", "ci_low", "ci_high", "status", "n_band", "suppressed")


def public_breakdown_rows(spark: SparkSession, folder: str) -> DataFrame:
    b = snapshot.published_breakdown(kpi.compute(inputs(spark, folder))[1], K, consent=False)
    return b.select("kpi", "dim", "member", "value", "suppressed")


def _sql_snapshot() -> str:
    least = " ".join(f"WHEN '{k}' THEN {min(d[3], K)}" for k, d in kpi.DEFINITIONS.items())
    return f"""WITH t AS (SELECT *, status = 'insufficient_data' OR (value IS NOT NULL AND n < CASE kpi {least} END) AS held FROM ({kpi_queries.SQL["kpi_table"]}))
SELECT kpi, CASE WHEN NOT held THEN round_even(value, 4) END AS value, CASE WHEN NOT held THEN round_even(ci_low, 4) END AS ci_low, CASE WHEN NOT held THEN round_even(ci_high, 4) END AS ci_high,
  CASE WHEN held THEN 'insufficient_data' ELSE status END AS status, CASE WHEN held THEN 'suppressed' ELSE {_BAND.format(n='n')} END AS n_band, held AS suppressed FROM t"""


# --- monitors ---
def poisson_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Per tenant: the probability of five or more confirmed harms in a day at its mean daily rate."""
    d = audit_view(spark, folder).filter("kind = 'decision' AND confirmed_tier3").groupBy(clean_name(F.col("tenant")).alias("tenant")).agg(F.count("*").alias("n"))
    return d.select("tenant", "n", F.round(poisson_tail(F.col("n") / 30, F.lit(5)), 9).alias("p"))


def ca02_budget_burn(spark: SparkSession, folder: str) -> DataFrame:
    return monitors.budget_burn(_observed(spark, folder)).select(_r("used"), _r("limit"), "days", _r("burn"))


def ca02_misreport(spark: SparkSession, folder: str) -> DataFrame:
    return monitors.misreporting(_observed(spark, folder)).select("tenant", "n", _r("median"))


def ca02_carbon(spark: SparkSession, folder: str) -> DataFrame:
    return monitors.carbon_thirds(_observed(spark, folder)).select("n", _r("early", 6), _r("late", 6))


def ca03_cusum(spark: SparkSession, folder: str) -> DataFrame:
    s = monitors.cusum(monitors.daily_rates(_observed(spark, folder), "near"))
    return s.select("day", _r("rate"), _r("base"), _r("s"))


def ca03_trend(spark: SparkSession, folder: str) -> DataFrame:
    points = monitors.daily_rates(_observed(spark, folder), "near", by=("language",))
    t = monitors.trend(points, ["language"], "day", "rate")
    return t.select("language", "points", "last_x", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"))


def _alerts(name: str):  # noqa: ANN202
    def run(spark: SparkSession, folder: str) -> DataFrame:
        a = monitors.AGENTS[name](_observed(spark, folder))
        return a.select("code", "severity", F.round("value", 6).alias("value"), "n", F.unix_micros("predicted_at").alias("predicted_us"), "subject")

    return run


def ca06_clock_skew(spark: SparkSession, folder: str) -> DataFrame:
    return monitors.clock_skew(_observed(spark, folder)).select("seq", _r("back_s", 6))


def ca13_flow_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return monitors.flow_ratios(_observed(spark, folder)).select("region", "day", _r("ratio"), F.col("o.event_no").alias("event_no"))


def monitor_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts of all monitors, as they are published."""
    return monitors.public(monitors.assess(_observed(spark, folder)))


_NOW = "(SELECT max(epoch_us(ts)) FROM a)"
_DAY = "86400000000"
_RATE = f"dr AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM d)) // {_DAY} AS day, avg(CASE WHEN near_miss THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM d GROUP BY 1)"
_TENANT = "nullif(lower(regexp_replace(tenant, '^\\s+|\\s+$', '', 'g')), '')"


def _tail(lam: str, k: str) -> str:
    """P(N >= k) of a Poisson count for k up to 5."""
    terms = ["1", lam, f"{lam} ** 2 / 2", f"{lam} ** 3 / 6", f"{lam} ** 4 / 24"]
    cases = " ".join(f"WHEN {k} = {i} THEN greatest(0.0::DOUBLE, 1 - exp(-{lam}) * ({' + '.join(terms[:i])}))" for i in range(1, 6))
    return f"CASE WHEN {k} <= 0 THEN 1.0::DOUBLE WHEN {lam} <= 0 THEN 0.0::DOUBLE {cases} END"


def _sql_monitors() -> dict[str, str]:
    v = views_sql()
    alert = "SELECT code, severity, round(value, 6) AS value, CAST(n AS BIGINT) AS n, CAST(predicted_us AS BIGINT) AS predicted_us, subject FROM"
    refused = "CASE WHEN status = 'BLOCKED' AND NOT conf THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    pivot = "(SELECT max(epoch_us(ts)) FROM e WHERE etype = 'policy_change')"
    stages = "CASE x " + " ".join(f"WHEN '{k}' THEN {s}" for k, s in monitors.STAGES.items()) + " END"
    return {
        "poisson_tails": v + f"""SELECT {_TENANT} AS tenant, count(*) AS n, round(1 - exp(-count(*) / 30.0::DOUBLE) * (1 + count(*) / 30.0::DOUBLE + (count(*) / 30.0::DOUBLE) ** 2 / 2
            + (count(*) / 30.0::DOUBLE) ** 3 / 6 + (count(*) / 30.0::DOUBLE) ** 4 / 24), 9) AS p FROM d WHERE conf GROUP BY 1""",
        "ca02_budget_burn": v + f""", pt AS (SELECT epoch_us(ts) AS t, seq, energy.budget_used_kwh AS used, energy.budget_used_kwh + energy.budget_remaining_kwh AS lim FROM d
            WHERE energy.budget_used_kwh + energy.budget_remaining_kwh IS NOT NULL),
            dy AS (SELECT (t - (SELECT min(t) FROM pt)) // {_DAY} AS day, max(struct_pack(t := t, used := used, lim := lim, seq := seq)) AS l FROM pt GROUP BY 1),
            st AS (SELECT day, (l.used - lag(l.used) OVER (ORDER BY day)) / (day - lag(day) OVER (ORDER BY day)) AS step FROM dy),
            ls AS (SELECT list(step ORDER BY day) AS a FROM st WHERE step IS NOT NULL)
            SELECT round(m.l.used, 9) AS used, round(m.l.lim, 9) AS "limit", (SELECT count(*) FROM dy) AS days,
              round((SELECT list_reduce(a, lambda x, y: 0.3::DOUBLE * y + 0.7::DOUBLE * x) FROM ls), 9) AS burn FROM (SELECT max(l) AS l FROM dy) m""",
        "ca02_misreport": v + """, o AS (SELECT k, first(tenant ORDER BY seq DESC) AS tenant FROM d WHERE k IS NOT NULL GROUP BY k)
            SELECT coalesce(nullif(CASE WHEN o.k IS NOT NULL THEN o.tenant ELSE a.tenant END, ''), 'default') AS tenant, count(*) AS n, round(median(act / est), 9) AS median
            FROM a LEFT JOIN o ON a.k = o.k WHERE kind = 'energy' AND est > 0 AND act IS NOT NULL GROUP BY 1""",
        "ca02_carbon": v + """, r AS (SELECT co2, row_number() OVER (ORDER BY epoch_us(ts), co2) AS i, count(*) OVER () AS n FROM d WHERE co2 IS NOT NULL AND ts IS NOT NULL)
            SELECT n, round(avg(co2) FILTER (WHERE i <= n // 3), 6) AS early, round(avg(co2) FILTER (WHERE i > n - n // 3), 6) AS late FROM r GROUP BY n""",
        "ca03_cusum": v + f""", {_RATE}, nm AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM dr), bs AS (SELECT avg(rate) AS base FROM nm WHERE i <= 7),
            pf AS (SELECT day, rate, base, sum(rate - base - 0.02::DOUBLE) OVER (ORDER BY day) AS p FROM nm CROSS JOIN bs WHERE i > 7)
            SELECT day, round(rate, 9) AS rate, round(base, 9) AS base, round(p - least(0.0::DOUBLE, min(p) OVER (ORDER BY day)), 9) AS s FROM pf""",
        "ca03_trend": v + f""", lr AS (SELECT labels.lang AS language, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM d)) // {_DAY} AS day, avg(CASE WHEN near_miss THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate
            FROM d WHERE labels.lang IS NOT NULL GROUP BY 1, 2)
            SELECT language, count(*) AS points, max(day) AS last_x, round(regr_slope(rate, day), 9) AS slope, round(regr_intercept(rate, day), 9) AS intercept FROM lr GROUP BY 1""",
        "ca04_over_blocking": v + f""", m AS (SELECT 'language' AS dim, labels.lang AS member, * FROM d UNION ALL SELECT 'topic', labels.topic, * FROM d),
            s AS (SELECT dim, member, avg({refused}) FILTER (WHERE epoch_us(ts) < {_NOW} - 2 * {_DAY}) AS old, avg({refused}) FILTER (WHERE epoch_us(ts) >= {_NOW} - 2 * {_DAY}) AS rate,
              count(*) FILTER (WHERE epoch_us(ts) < {_NOW} - 2 * {_DAY}) AS n_old, count(*) FILTER (WHERE epoch_us(ts) >= {_NOW} - 2 * {_DAY}) AS n_new FROM m WHERE member <> '' GROUP BY 1, 2),
            w AS (SELECT dim, max(struct_pack(rate := rate, old := old, member := member)) AS w, count(*) AS n FROM s WHERE n_old >= 20 AND n_new >= 20 AND rate >= greatest(2 * old, 0.05::DOUBLE) GROUP BY dim)
            {alert} (SELECT 'CANARY_FAILURE' AS code, 'critical' AS severity, (total - passed)::DOUBLE AS value, total AS n, NULL AS predicted_us, NULL AS subject FROM e WHERE etype = 'canary_result' AND passed < total
              UNION ALL SELECT 'REFUSAL_SPIKE', 'warning', w.rate, n, NULL, dim || ':' || w.member FROM w
              UNION ALL SELECT 'APPEALS_OFTEN_UPHELD', 'warning', avg(CASE WHEN upheld THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), count(*), NULL, NULL FROM e WHERE etype = 'appeal_outcome'
                HAVING count(*) >= 20 AND avg(CASE WHEN upheld THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.15)""",
        "ca01_breaker_precursor": v + f""", r AS (SELECT coalesce(nullif(principal_digest, ''), 'anonymous') AS who, epoch_us(ts) AS t, conf, near_miss, {_NOW} - epoch_us(ts) AS age FROM d WHERE {_NOW} - epoch_us(ts) <= 3600000000),
            g AS (SELECT who, count(CASE WHEN conf THEN 1 END) AS cnt, count(CASE WHEN near_miss THEN 1 END) AS near, count(CASE WHEN conf AND age <= 300000000 THEN 1 END) AS cur, min(CASE WHEN conf THEN t END) AS first FROM r GROUP BY 1),
            q AS (SELECT *, cnt / 3600.0::DOUBLE * 300 AS lam, 5 - cur AS k FROM g WHERE cnt > 0 AND cur < 5),
            p AS (SELECT *, {_tail('lam', 'k')} AS p FROM q),
            w AS (SELECT count(CASE WHEN cnt > 0 THEN 1 END) AS callers, sum(cnt) AS total, sum(cur) AS cur, count(CASE WHEN cur > 0 THEN 1 END) AS inw, min(first) AS first FROM g),
            ws AS (SELECT *, total / greatest(({_NOW} - first) / 1e6, 300.0::DOUBLE) * 300 AS lam, 5 - cur AS k FROM w WHERE callers >= 2 AND NOT (cur >= 5 AND inw >= 3)),
            wp AS (SELECT *, {_tail('lam', 'k')} AS p FROM ws)
            {alert} (SELECT 'PRINCIPAL_TRIP_LIKELY' AS code, 'warning' AS severity, p AS value, cnt AS n, CAST(floor({_NOW} + (5 - cur) / (cnt / 3600.0::DOUBLE) * 1e6) AS BIGINT) AS predicted_us, who AS subject FROM p WHERE p >= 0.5 OR (near >= 2 AND cnt >= 2)
              UNION ALL SELECT 'GLOBAL_TRIP_LIKELY', 'critical', p, total, NULL, NULL FROM wp WHERE p >= 0.5)""",
        "ca03_drift": v + f""", {_RATE}, nm AS (SELECT *, row_number() OVER (ORDER BY day) AS i, row_number() OVER (ORDER BY day DESC) AS j, count(*) OVER () AS m FROM dr), bs AS (SELECT avg(rate) AS base FROM nm WHERE i <= 7),
            pf AS (SELECT day, rate, sum(rate - base - 0.02::DOUBLE) OVER (ORDER BY day) AS p FROM nm CROSS JOIN bs WHERE i > 7), cu AS (SELECT day, rate, p - least(0.0::DOUBLE, min(p) OVER (ORDER BY day)) AS s FROM pf),
            ln AS (SELECT count(*) AS c, max(day) AS lx, regr_slope(rate, day) AS sl, regr_intercept(rate, day) AS ic, min(day) FILTER (WHERE s > 0.08) AS alarm FROM cu),
            fi AS (SELECT *, (SELECT avg(rate) FROM nm WHERE j <= 3) AS latest, (SELECT max(m) FROM nm) AS total, CASE WHEN c >= 3 AND sl > 0 AND (0.15 - ic) / sl > lx AND (0.15 - ic) / sl - lx <= 30 THEN (0.15 - ic) / sl END AS meets FROM ln)
            {alert} (SELECT 'NEAR_MISS_DRIFT' AS code, 'warning' AS severity, latest AS value, total AS n, CAST(floor((SELECT min(epoch_us(ts)) FROM d) + meets * {_DAY}) AS BIGINT) AS predicted_us, NULL AS subject FROM fi
              WHERE alarm IS NOT NULL AND latest < 0.15 AND total >= 9)""",
        "ca06_integrity": v + f"""{alert} (SELECT 'AUDIT_SINK_FAILURES' AS code, 'warning' AS severity, NULL::DOUBLE AS value, max(sink_failures) AS n, NULL AS predicted_us, NULL AS subject FROM a HAVING max(sink_failures) > 0
              UNION ALL SELECT 'AUDIT_CLOCK_SKEW', 'warning', max(b / 1e6), count(*), NULL, NULL FROM (SELECT lag(epoch_us(ts)) OVER (ORDER BY seq) - epoch_us(ts) AS b FROM a WHERE ts IS NOT NULL) WHERE b > 5000000 HAVING count(*) > 0)""",
        "ca08_simulation": v + f"""{alert} (SELECT 'SIMULATION_SKIPPED' AS code, 'warning' AS severity, NULL::DOUBLE AS value, count(*) AS n, NULL AS predicted_us, NULL AS subject FROM d
              WHERE status = 'APPROVED' AND CAST(gm->>'policy_like' AS BOOLEAN) AND NOT coalesce(CAST(gm->>'macro_policy' AS BOOLEAN), FALSE) HAVING count(*) >= 3)""",
        "ca13_extraction": v + f""", f AS (SELECT coalesce(area, 'None') AS region, epoch_us(ts) AS t, event_no, sum(coalesce(extracted, 0)) OVER w AS sx, sum(coalesce(returned, 0)) OVER w AS sr,
              min(epoch_us(ts)) OVER (PARTITION BY coalesce(area, 'None')) AS t0 FROM e WHERE etype = 'value_flow' WINDOW w AS (PARTITION BY coalesce(area, 'None') ORDER BY ts, event_no ROWS UNBOUNDED PRECEDING)),
            p AS (SELECT region, (t - t0) // {_DAY} AS day, sr / sx AS ratio, t, event_no, t0 FROM f WHERE sx > 0),
            l AS (SELECT region, count(*) AS points, max(day) AS lx, regr_slope(ratio, day) AS sl, regr_intercept(ratio, day) AS ic, min(day) AS mn, arg_max(ratio, struct_pack(t := t, e := event_no)) AS ratio, max(t0) AS t0 FROM p GROUP BY 1),
            z AS (SELECT *, CASE WHEN ratio >= 0.5 AND points >= 3 AND lx > mn AND sl < 0 AND (0.5 - ic) / sl > lx THEN (0.5 - ic) / sl END AS meets FROM l)
            {alert} (SELECT 'VALUE_RETURN_GAP' AS code, CASE WHEN ratio < 0.5 THEN 'critical' ELSE 'warning' END AS severity, ratio AS value, points AS n, CAST(floor(t0 + meets * {_DAY}) AS BIGINT) AS predicted_us, region AS subject FROM z WHERE ratio < 0.5 OR meets IS NOT NULL
              UNION ALL SELECT 'LOW_LOCAL_CAPACITY', 'info', local_share, NULL, NULL, area FROM e WHERE etype = 'capacity' AND local_share < 0.2)""",
        "ca06_clock_skew": v + "SELECT seq, round(b / 1e6, 6) AS back_s FROM (SELECT seq, lag(epoch_us(ts)) OVER (ORDER BY seq) - epoch_us(ts) AS b FROM a WHERE ts IS NOT NULL) WHERE b > 5000000",
        "ca07_consent": v + f""", mi AS (SELECT count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM e WHERE etype = 'consent_verified' AND e.k = d.k) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS share FROM d WHERE comm)
            {alert} (SELECT 'CONSENT_UNVERIFIED' AS code, 'warning' AS severity, share AS value, n, NULL AS predicted_us, NULL AS subject FROM mi WHERE n >= 10 AND share > 0.1
              UNION ALL SELECT CASE WHEN {_NOW} > due THEN 'REVOCATION_OVERDUE' ELSE 'REVOCATION_DUE_SOON' END, CASE WHEN {_NOW} > due THEN 'critical' ELSE 'warning' END, NULL, NULL, due, NULL
              FROM (SELECT epoch_us(revoked_at) + 259200000000 AS due FROM e WHERE etype = 'consent_revoked' AND honoured_at IS NULL) WHERE due - {_NOW} <= {_DAY})""",
        "ca09_incidents": v + f"""{alert} (SELECT CASE WHEN {_NOW} > due THEN 'INCIDENT_OVERDUE' ELSE 'INCIDENT_DUE_SOON' END AS code, CASE WHEN {_NOW} > due THEN 'critical' ELSE 'warning' END AS severity,
            NULL::DOUBLE AS value, NULL AS n, due AS predicted_us, NULL AS subject
            FROM (SELECT k, epoch_us(ts) + 15 * {_DAY} AS due FROM d WHERE conf) x WHERE due - {_NOW} <= 3 * {_DAY} AND NOT EXISTS (SELECT 1 FROM e WHERE etype = 'incident_reported' AND e.k = x.k))""",
        "ca11_diversity": v + f""", l AS (SELECT labels.lang AS lang, count(*) AS n, avg({refused}) AS rate, count(*) FILTER (WHERE epoch_us(ts) < {pivot}) AS bf, count(*) FILTER (WHERE epoch_us(ts) >= {pivot}) AS af
              FROM d WHERE labels.lang <> '' GROUP BY 1),
            r AS (SELECT max(rate) AS hi, min(rate) AS lo, count(*) AS n, arg_max(lang, rate) AS worst FROM l WHERE n >= 20),
            x AS (SELECT lang, bf, af / greatest(({_NOW} - {pivot}) / 1e6, 1.0::DOUBLE) AS ra, bf / greatest(({pivot} - (SELECT min(epoch_us(ts)) FROM d)) / 1e6, 1.0::DOUBLE) AS rb FROM l WHERE bf >= 20)
            {alert} (SELECT 'REFUSAL_DISPARITY' AS code, 'warning' AS severity, (hi + 0.001) / (lo + 0.001) AS value, n, NULL AS predicted_us, worst AS subject FROM r WHERE n >= 2 AND (hi + 0.001) / (lo + 0.001) > 1.25
              UNION ALL SELECT 'SILENT_EXCLUSION', 'warning', ra / rb, bf, NULL, lang FROM x WHERE ra < 0.5 * rb)""",
        "ca12_precursors": v + f""", s AS (SELECT coalesce(nullif(tenant, ''), 'default') || '/unspecified' AS subject, epoch_us(ts) AS t,
              (SELECT max({stages}) FROM (SELECT unnest(list_append(coalesce(from_json(gm->'lexical_hits', '["VARCHAR"]'), []), coalesce(code, ''))) AS x)) AS stage
              FROM d WHERE epoch_us(ts) >= {_NOW} - 14 * {_DAY}),
            n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t, stage) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM s WHERE stage IS NOT NULL),
            h AS (SELECT subject, n, coalesce(max(stage) FILTER (WHERE i < n // 2), min(stage) FILTER (WHERE i = 0)) AS early, max(stage) FILTER (WHERE i >= n // 2) AS late FROM n GROUP BY 1, 2)
            {alert} (SELECT 'ATROCITY_PRECURSOR_ESCALATION' AS code, CASE WHEN late >= 5 THEN 'critical' ELSE 'warning' END AS severity, late::DOUBLE AS value, n, NULL AS predicted_us, subject FROM h
              WHERE n >= 3 AND (late > early OR late >= 4))""",
        "ca13_flow_ratios": v + f""", f AS (SELECT coalesce(area, 'None') AS region, epoch_us(ts) AS t, event_no, sum(coalesce(extracted, 0)) OVER w AS sx, sum(coalesce(returned, 0)) OVER w AS sr,
              min(epoch_us(ts)) OVER (PARTITION BY coalesce(area, 'None')) AS t0 FROM e WHERE etype = 'value_flow' WINDOW w AS (PARTITION BY coalesce(area, 'None') ORDER BY ts, event_no ROWS UNBOUNDED PRECEDING))
            SELECT region, (t - t0) // {_DAY} AS day, round(sr / sx, 9) AS ratio, event_no FROM f WHERE sx > 0""",
    }


# --- screening, digests, state ---
def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions as requests: their energy, and whether they touch a community and have its consent."""
    a = audit_view(spark, folder).filter("kind = 'decision'")
    g = F.col("governance_metadata")
    return a.select(
        "seq", clean_name(F.col("tenant")).alias("tenant"), F.col("timestamp").alias("ts"), F.col("energy.estimated_kwh").alias("estimated_kwh"), F.col("energy.carbon_intensity_g_kwh").alias("carbon_intensity"),
        F.lit(None).cast("double").alias("water_l"), F.lit(False).alias("macro_policy"), g["community_action"].alias("affects_community"), g["consent_asserted"].alias("community_consent"),
    )


LIMITS = decisions.Limits(max_kwh=0.02, max_carbon=300.0, default_carbon=250.0, consent_required=True)


def tier1_limits(spark: SparkSession, folder: str) -> DataFrame:
    r = _requests(spark, folder)
    return r.select("seq", decisions.tier1(LIMITS)["code"].alias("code"), F.round(decisions.utilisation(LIMITS)["energy"], 9).alias("energy"), decisions.invalid_number("estimated_kwh").alias("invalid"))


def first_failure(spark: SparkSession, folder: str) -> DataFrame:
    d = _requests(spark, folder).withColumn("d", decisions.decide([decisions.tier1(LIMITS), decisions.consent_gate(LIMITS)]))
    return d.groupBy("d.status", "d.tier", "d.code", F.size("d.evaluators").alias("checks")).agg(F.count("*").alias("n"))


def budget_fold(spark: SparkSession, folder: str) -> DataFrame:
    r = _requests(spark, folder).withColumn("kwh", F.coalesce(sound(F.col("estimated_kwh")), F.lit(0.0)))
    b = state.budget(r, 1.0)
    return b.groupBy("key").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"), F.round(F.max_by("used", F.struct("used", "seq")), 6).alias("used"))


def energy_reconciled(spark: SparkSession, folder: str) -> DataFrame:
    """What each metered reading changes in the energy held for its decision."""
    a = audit_view(spark, folder)
    held = a.filter("kind = 'decision'").select("key", sound(F.col("energy.estimated_kwh")).alias("kwh"), "seq")
    meters = a.filter("kind = 'energy'").select("key", F.col("timestamp").alias("ts"), "seq", F.col("energy.actual_kwh").alias("actual"))
    return state.reconciled(held, meters).select("seq", _r("delta"), _r("held"))


def budget_throttle(spark: SparkSession, folder: str) -> DataFrame:
    """The budget tracked but not enforced: use at the end, and requests past the limit, per tenant."""
    r = _requests(spark, folder).withColumn("kwh", F.coalesce(sound(F.col("estimated_kwh")), F.lit(0.0)))
    t = state.throttle(r, 1.0)
    return t.groupBy("key").agg(F.count("*").alias("n"), F.count_if("over").alias("over"), F.round(F.max("used"), 6).alias("used"))


def decision_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Every request of the trail through the whole order of checks, on figures and flags that the trail holds."""
    a = audit_view(spark, folder).filter("kind IN ('decision', 'model_error')")
    g, e = F.col("governance_metadata"), F.col("energy")
    requests = a.select(
        "audit_id", F.lit("p").alias("prompt"), F.lit(None).cast("string").alias("completion"), e["estimated_kwh"].alias("estimated_kwh"), e["carbon_intensity_g_kwh"].alias("carbon_intensity"),
        g["community_action"].alias("affects_community"), g["consent_asserted"].alias("community_consent"), g["unscreened"].alias("unscreenable"),
        F.when(F.col("near_miss") & F.col("confirmed_tier3"), "PRINCIPAL_SUSPENDED").otherwise("ALLOW").alias("admission"), (F.coalesce(e["budget_remaining_kwh"], F.lit(1.0)) > 0).alias("budget_admitted"),
        F.when(F.col("kind") == "model_error", "ERROR").alias("model_error"),
    )
    d = decisions.screen(requests, LIMITS)
    return d.groupBy("decision.status", "decision.tier", "decision.code", F.size("decision.evaluators").alias("checks"), "confirmed_tier3").agg(F.count("*").alias("n"))


def ca05_policy_review(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every policy change: documents that are not valid, safeguards that are relaxed, issuers that change."""
    return policy.review(events_view(spark, folder).filter("type = 'policy_change'")).select("event_no", "code", "severity", "path")


def chain_heads(spark: SparkSession, folder: str) -> DataFrame:
    """A signed chain for each tenant, written in order: its length and last signature."""
    rows = table(spark, folder, "audit_records").select(F.coalesce(clean_name(F.col("tenant")), F.lit("")).alias("shard"), "seq")
    signed = state.write_chains(rows.withColumn("body", F.to_json(F.struct("seq"))), KEY)
    return signed.groupBy("shard").agg(F.count("*").alias("records"), F.max_by("record_hmac", "seq").alias("head"))


def k14_chain(spark: SparkSession, folder: str) -> DataFrame:
    """K-14 of signed chains of which every 97th record was changed: records, and those that verify, per tenant."""
    rows = table(spark, folder, "audit_records").select(F.coalesce(clean_name(F.col("tenant")), F.lit("")).alias("shard"), "seq")
    signed = state.write_chains(rows.withColumn("body", F.to_json(F.struct("seq"))), KEY)
    changed = signed.withColumn("raw", F.when(F.col("seq") % 97 == 0, F.replace("raw", F.lit('"seq":'), F.lit('"seq": 1'))).otherwise(F.col("raw")))
    checked = state.verify_chain(changed, KEY, "shard")
    return checked.groupBy("shard").agg(F.count("*").alias("records"), F.count_if("intact").alias("verified"))


def k12_rules(spark: SparkSession, folder: str) -> DataFrame:
    """K-12 of a policy with three community rules, one of which would hide protected speech, in the table of indicators."""
    rule = lambda name, pattern: {"id": name, "pattern": pattern, "reason": "r", "scope": "DATA_USE", "legal_basis": "by-law", "adopting_body_ref": "council"}
    doc = {"tier_2_community_sovereignty": {"custom_rules": [rule("GROVE", "sacred grove"), rule("WELL", "close the well"), rule("HUSH", r"\bprotest")]}}
    r, _ = kpi.compute(inputs(spark, folder), rules=policy.rules_share(doc))
    return r.filter("kpi = 'K-12'").select("kpi", F.round("value", 9).alias("value"), "n", "status")


def breaker_replay(spark: SparkSession, folder: str) -> DataFrame:
    a = audit_view(spark, folder).filter("kind = 'decision'")
    rows = a.select("seq", F.col("timestamp").alias("ts"), F.col("principal_digest").alias("principal"), F.col("confirmed_tier3").alias("violation"), clean_name(F.col("tenant")).alias("tenant"))
    return state.breaker(rows, "tenant", window_s=864_000.0, cooldown_s=86_400.0).groupBy("key", "admission").agg(F.count("*").alias("n"))


def chain_links(spark: SparkSession, folder: str) -> DataFrame:
    """A chain of digests over the trail from which every 97th record is missing: the broken links."""
    a = table(spark, folder, "audit_records")
    sig = lambda n: F.sha2(n.cast("string"), 256)
    trail = a.select("seq", F.when(F.col("seq") == 1, F.lit(state.GENESIS)).otherwise(sig(F.col("seq") - 1)).alias("prev_digest"), sig(F.col("seq")).alias("record_hmac"))
    return state.links(trail.filter("seq % 97 <> 0"), 5_000).filter(~F.col("linked")).select("seq")


def hmac_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", keyed_digest(F.col("c_custkey").cast("string"), KEY).alias("digest"))


def _sql_hmac() -> str:
    pad = KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in pad).hex() for p in (0x36, 0x5C))
    return f"SELECT c_custkey, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(CAST(c_custkey AS VARCHAR))))) AS digest FROM customer"


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    s = sentences(F.col("text"))
    return d.select("doc_id", F.size(s).alias("sentences"), F.length(F.coalesce(F.get(s, F.lit(0)), F.lit(""))).alias("first_chars"))


def size_guards(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", size_guard(F.lit(""), F.col("text"), 5_000).alias("code"), estimated_kwh(F.length("text") / 4).alias("kwh"))
    return d.groupBy("code").agg(F.count("*").alias("n"), F.round(F.sum("kwh"), 9).alias("kwh"))


#: The lexicon's patterns by code and number: they are in the dialect of all engines.
PLAIN_RULES = {f"{r.code}.{i}": r.pattern for i, r in enumerate(rules.LEXICON)}
TIER3_RULES = {f"{r.code}.{i}": r.pattern for i, r in enumerate(rules.LEXICON) if r.tier == 3}


def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "harmful").select("category", F.explode(rules.mentioned(F.col("text"), PLAIN_RULES)).alias("code"))
    return d.groupBy("category", "code").agg(F.count("*").alias("n"))


def corpus_confusion(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "harmful").select(F.lit("harmful").alias("label"), "text").unionByName(table(spark, folder, "protected_speech").select(F.lit("benign").alias("label"), "text"))
    hit = F.when(F.size(rules.mentioned(F.col("text"), TIER3_RULES)) > 0, "BLOCKED").otherwise("APPROVED")
    return rules.confusion(both, "label", hit)


def screened_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The whole lexicon with its normal form, exceptions and mentions over both corpora."""
    both = table(spark, folder, "harmful").select(F.lit("harmful").alias("label"), "text", "context").unionByName(
        table(spark, folder, "protected_speech").select(F.lit("benign").alias("label"), "text", F.lit(None).cast("string").alias("context"))
    )
    s = rules.screened(F.col("text"), rules.LEXICON, F.col("context"))
    verdict = F.when(F.size(s["proposals"]) > 0, "BLOCKED").when(F.size(s["mentions"]) > 0, "MENTION").otherwise("APPROVED")
    return rules.confusion(both, "label", verdict)


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = events_view(spark, folder).groupBy("type").agg(F.count("*").alias("n"))
    return e.select("type", "n", size_band(F.col("n")).alias("n_band"))


def _sql_review() -> str:
    """Documents without a required section, relaxed safeguards, and another issuer, by the paths of a document."""
    at = lambda side, *path: f"json_extract({side}_policy, '$.{'.'.join(path)}')"
    parts = [f"SELECT event_no, 'POLICY_INVALID' AS code, 'critical' AS severity, '' AS path FROM p WHERE {' OR '.join(at('new', s) + ' IS NULL' for s in policy.REQUIRED)}"]
    for (section, key), way in policy.RELAXES.items():
        a, b = at("old", section, key), at("new", section, key)
        number = lambda x: f"TRY_CAST({x} AS DOUBLE)"
        test = {"off": f"{a}::VARCHAR = 'true' AND {b}::VARCHAR = 'false'", "on": f"{a}::VARCHAR = 'false' AND {b}::VARCHAR = 'true'", "allow": f"""{b}::VARCHAR = '"allow"' AND {a}::VARCHAR <> '"allow"'""",
                "up": f"{number(b)} > {number(a)}", "down": f"{number(b)} < {number(a)}"}[way]
        parts.append(f"SELECT event_no, 'POLICY_RELAXATION', 'warning', '{section}.{key}' FROM p WHERE {test}")
    issuer = [at(side, "metadata", "issuer") for side in ("old", "new")]
    parts.append(f"SELECT event_no, 'ISSUER_CHANGED', 'warning', 'metadata.issuer' FROM p WHERE {issuer[0]} IS NOT NULL AND {issuer[0]} IS DISTINCT FROM {issuer[1]}")
    return "WITH p AS (SELECT * FROM accountability_events WHERE etype = 'policy_change') " + " UNION ALL ".join(parts)


def _sql_chain_heads() -> str:
    pad = KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in pad).hex() for p in (0x36, 0x5C))
    body = """'{"prev_digest":"' || acc || '","seq":' || x || '}'"""
    mac = f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body}))))"
    return (
        f"SELECT shard, CAST(len(l) AS BIGINT) AS records, list_reduce(l, lambda acc, x: {mac}, '{state.GENESIS}') AS head FROM "
        f"(SELECT coalesce({_TENANT}, '') AS shard, list(CAST(seq AS VARCHAR) ORDER BY seq) AS l FROM audit_records GROUP BY 1)"
    )


def _sql_state() -> dict[str, str]:
    v = views_sql()
    t1 = "CASE WHEN est > 0.02::DOUBLE THEN 'COMPUTE_LIMIT' WHEN coalesce(co2, 250) > 300 THEN 'CARBON_INTENSITY_LIMIT' END"
    hit = lambda p: f"""regexp_matches(text, '{p.replace("'", "''")}', 'i')"""
    plain = " UNION ALL ".join(f"SELECT category, '{c}' AS code, text FROM harmful WHERE {hit(p)}" for c, p in PLAIN_RULES.items())
    anyhit = " OR ".join(hit(p) for p in TIER3_RULES.values())
    return {
        "tier1_limits": v + f"""SELECT seq, coalesce({t1}, '') AS code, round(est / 0.02::DOUBLE, 9) AS energy,
            coalesce(isnan(energy.estimated_kwh) OR isinf(energy.estimated_kwh) OR energy.estimated_kwh < 0, FALSE) AS invalid FROM d""",
        "first_failure": v + f""", x AS (SELECT {t1} AS c1, CASE WHEN comm AND coalesce(CAST(gm->>'consent_asserted' AS BOOLEAN), FALSE) IS NOT TRUE THEN 'COMMUNITY_CONSENT_MISSING' END AS c2 FROM d)
            SELECT CASE WHEN coalesce(c1, c2) IS NULL THEN 'APPROVED' ELSE 'BLOCKED' END AS status, CASE WHEN c1 IS NOT NULL THEN 'TIER_1' WHEN c2 IS NOT NULL THEN 'TIER_2' END AS tier,
              coalesce(c1, c2, '') AS code, CASE WHEN c1 IS NOT NULL THEN 1 ELSE 2 END AS checks, count(*) AS n FROM x GROUP BY ALL""",
        "budget_fold": v + f""", q AS (SELECT coalesce({_TENANT}, '') AS key, list(coalesce(est, 0.0::DOUBLE) ORDER BY ts NULLS FIRST, seq) AS ks FROM d GROUP BY 1)
            SELECT key, len(ks) AS n, CAST(r.n AS BIGINT) AS admitted, round(r.used, 6) AS used FROM (SELECT key, ks,
              list_reduce(list_transform(ks, lambda z: {{'used': z, 'n': 1::DOUBLE}}), lambda s, x: CASE WHEN s.used + x.used <= 1 THEN {{'used': s.used + x.used, 'n': s.n + 1}} ELSE s END, {{'used': 0.0::DOUBLE, 'n': 0.0::DOUBLE}}) AS r FROM q)""",
        "energy_reconciled": v + """, h AS (SELECT k, coalesce(first(est ORDER BY seq DESC) FILTER (WHERE est IS NOT NULL), 0) AS reserved FROM d WHERE k IS NOT NULL GROUP BY k),
            m AS (SELECT seq, k, act, lag(act) OVER (PARTITION BY k ORDER BY ts NULLS FIRST, seq) AS before FROM a WHERE kind = 'energy' AND k IS NOT NULL AND act IS NOT NULL)
            SELECT seq, round(act - coalesce(before, reserved, 0), 9) AS delta, round(act, 9) AS held FROM m LEFT JOIN h USING (k)""",
        "budget_throttle": v + f""", q AS (SELECT coalesce({_TENANT}, '') AS key, sum(coalesce(est, 0)) OVER (PARTITION BY coalesce({_TENANT}, '') ORDER BY ts NULLS FIRST, seq ROWS UNBOUNDED PRECEDING) AS used FROM d)
            SELECT key, count(*) AS n, count(CASE WHEN used > 1 THEN 1 END) AS "over", round(max(used), 6) AS used FROM q GROUP BY 1""",
        "decision_pipeline": v + f""", x AS (SELECT kind, CASE WHEN json_array_length(gm->'unscreened') > 0 THEN 'UNSCREENABLE_CONTENT' END AS c1, CASE WHEN near_miss AND confirmed_tier3 THEN 'PRINCIPAL_SUSPENDED' END AS c2,
              CASE WHEN coalesce(isnan(energy.estimated_kwh) OR isinf(energy.estimated_kwh) OR energy.estimated_kwh < 0, FALSE) OR coalesce(isnan(energy.carbon_intensity_g_kwh) OR isinf(energy.carbon_intensity_g_kwh) OR energy.carbon_intensity_g_kwh < 0, FALSE) THEN 'INVALID_FIGURE' END AS c3,
              {t1} AS c4, CASE WHEN coalesce(CAST(gm->>'community_action' AS BOOLEAN), FALSE) AND coalesce(CAST(gm->>'consent_asserted' AS BOOLEAN), FALSE) IS NOT TRUE THEN 'COMMUNITY_CONSENT_MISSING' END AS c6,
              CASE WHEN coalesce(energy.budget_remaining_kwh, 1) <= 0 THEN 'RESOURCE_BUDGET_EXHAUSTED' END AS c7, CASE WHEN kind = 'model_error' THEN 'MODEL_ERROR' END AS c8 FROM a WHERE kind IN ('decision', 'model_error'))
            SELECT CASE WHEN coalesce(c1, c2, c3, c4, c6, c7, c8) IS NULL THEN 'APPROVED' WHEN coalesce(c1, c2, c3, c4, c6, c7, c8) = 'MODEL_ERROR' THEN 'ERROR' ELSE 'BLOCKED' END AS status,
              CASE WHEN c1 IS NOT NULL THEN 'INPUT_LIMITS' WHEN c2 IS NOT NULL THEN 'CIRCUIT_BREAKER' WHEN c3 IS NOT NULL THEN 'INPUT_LIMITS' WHEN c4 IS NOT NULL THEN 'TIER_1' WHEN c6 IS NOT NULL THEN 'TIER_2' WHEN c7 IS NOT NULL THEN 'TIER_1' END AS tier,
              coalesce(c1, c2, c3, c4, c6, c7, c8, '') AS code,
              CASE WHEN c1 IS NOT NULL THEN 1 WHEN c2 IS NOT NULL THEN 2 WHEN c3 IS NOT NULL THEN 3 WHEN c4 IS NOT NULL THEN 4 WHEN c6 IS NOT NULL THEN 6 WHEN c7 IS NOT NULL THEN 7 WHEN c8 IS NOT NULL THEN 8 ELSE 12 END AS checks,
              FALSE AS confirmed_tier3, count(*) AS n FROM x GROUP BY ALL""",
        "ca05_policy_review": _sql_review(),
        "k12_rules": "SELECT 'K-12' AS kpi, round(2 / 3::DOUBLE, 9) AS value, CAST(3 AS BIGINT) AS n, 'red' AS status",
        "k14_chain": f"SELECT coalesce({_TENANT}, '') AS shard, count(*) AS records, count(CASE WHEN seq % 97 <> 0 THEN 1 END) AS verified FROM audit_records GROUP BY 1",
        "chain_heads": _sql_chain_heads(),
        "chain_links": """SELECT seq FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM audit_records WHERE seq % 97 <> 0) WHERE coalesce(p, 0) <> seq - 1""",
        "hmac_digest": _sql_hmac(),
        "sentence_counts": r"SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(length(coalesce(s[1], '')) AS INTEGER) AS first_chars FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?;\n]+[.!?;\n]*') AS s FROM documents)",
        "size_guards": "SELECT CASE WHEN length(text) > 5000 THEN 'OUTPUT_TOO_LARGE' END AS code, count(*) AS n, round(sum(length(text) / 4.0::DOUBLE / 1000 * 0.5::DOUBLE / 1000), 9) AS kwh FROM documents GROUP BY 1",
        "rule_hits": f"SELECT category, code, count(*) AS n FROM ({plain}) GROUP BY ALL",
        "corpus_confusion": f"SELECT label, CASE WHEN {anyhit} THEN 'BLOCKED' ELSE 'APPROVED' END AS verdict, count(*) AS n FROM (SELECT 'harmful' AS label, text FROM harmful UNION ALL SELECT 'benign', text FROM protected_speech) GROUP BY ALL",
        "event_counts": f"SELECT etype AS type, count(*) AS n, {_BAND.format(n='count(*)')} AS n_band FROM accountability_events GROUP BY 1",
    }


_NAMED = {"ca01_breaker_precursor": "CA-1", "ca03_drift": "CA-3", "ca06_integrity": "CA-6", "ca08_simulation": "CA-8", "ca13_extraction": "CA-13", "ca04_over_blocking": "CA-4", "ca07_consent": "CA-7", "ca09_incidents": "CA-9", "ca11_diversity": "CA-11", "ca12_precursors": "CA-12"}
QUERIES = {f.__name__: f for f in (
    scorecards, public_snapshot_rows, public_breakdown_rows, poisson_tails, ca02_budget_burn, ca02_misreport, ca02_carbon, ca03_cusum, ca03_trend, ca06_clock_skew, ca13_flow_ratios,
    monitor_alerts, tier1_limits, first_failure, budget_fold, breaker_replay, energy_reconciled, budget_throttle, decision_pipeline, ca05_policy_review, k12_rules, k14_chain, chain_heads, chain_links, hmac_digest, sentence_counts, size_guards, rule_hits, corpus_confusion, screened_corpus, event_counts,
)} | {name: _alerts(agent) for name, agent in _NAMED.items()}
SQL = {
    "scorecards": _sql_scorecards(),
    "public_snapshot_rows": _sql_snapshot(),
    "public_breakdown_rows": "SELECT kpi, dim, member, CASE WHEN NOT s THEN round_even(value, 4) END AS value, s AS suppressed FROM (SELECT *, suppressed OR n < 20 AS s "
    + f"FROM ({kpi_queries.SQL['kpi_breakdowns']})) WHERE dim NOT IN ('language', 'region', 'cohort', 'target_group', 'group')",
    **_sql_monitors(),
    **_sql_state(),
}
