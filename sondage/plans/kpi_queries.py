"""Queries of the indicators over the audit tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.plans import kpi
from sondage.sources.audit import audit_view, events_view

K = 20


def inputs(spark: SparkSession, folder: str, by: str | None = None) -> kpi.Inputs:
    return kpi.Inputs(audit_view(spark, folder), events_view(spark, folder), K, by)


def _shown(r: DataFrame) -> DataFrame:
    return r.select("g", "kpi", F.round("value", 9).alias("value"), "n", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"), "status")


def kpi_table(spark: SparkSession, folder: str) -> DataFrame:
    """All indicators K-01 to K-29 over all records."""
    return _shown(kpi.compute(inputs(spark, folder))[0])


def kpi_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """All indicators for every model."""
    return _shown(kpi.compute(inputs(spark, folder, "model"))[0])


def kpi_breakdowns(spark: SparkSession, folder: str) -> DataFrame:
    b = kpi.compute(inputs(spark, folder))[1]
    return b.select("kpi", "dim", "member", "n", F.round("value", 9).alias("value"), "suppressed")


def views_sql(by_model: bool = False) -> str:
    """Common table expressions: a (records), d (decisions), e (events), each with its group g and its id k."""
    key = (
        "CASE WHEN regexp_replace(audit_id, '\\s', '', 'g') <> '' THEN CASE WHEN regexp_matches(regexp_replace(lower(audit_id), '[^0-9a-z]', '', 'g'), '[0-9a-f]{32}$') "
        "THEN right(regexp_replace(lower(audit_id), '[^0-9a-z]', '', 'g'), 32) ELSE '?' || regexp_replace(lower(audit_id), '[^0-9a-z]', '', 'g') END END"
    )
    g = "nullif(labels.model, '')" if by_model else "''"
    events = f"SELECT *, {key} AS k FROM accountability_events"
    e = (
        "e AS (SELECT ek.*, o.g FROM ek JOIN (SELECT DISTINCT k, g FROM a WHERE k IS NOT NULL) o ON ek.k = o.k "
        "UNION ALL SELECT *, nullif(model, '') AS g FROM ek WHERE k IS NULL AND nullif(model, '') IS NOT NULL)"
        if by_model
        else "e AS (SELECT *, '' AS g FROM ek)"
    )
    finite = lambda x: f"CASE WHEN {x} >= 0 AND {x} < 'infinity'::DOUBLE AND NOT isnan({x}) THEN {x} END"
    return f"""
WITH a AS (
  SELECT * FROM (SELECT *, {key} AS k, {g} AS g, json(governance_metadata) AS gm,
    {finite("energy.estimated_kwh")} AS est, {finite("energy.actual_kwh")} AS act, {finite("energy.carbon_intensity_g_kwh")} AS co2 FROM audit_records) WHERE g IS NOT NULL),
ek AS ({events}),
{e},
d AS (SELECT *, coalesce(confirmed_tier3, FALSE) AS conf, coalesce(CAST(gm->>'community_action' AS BOOLEAN), FALSE) AS comm FROM a WHERE kind = 'decision'),
ids AS (
  SELECT g, k, arg_max(est, seq) AS est0, first(est ORDER BY seq DESC) AS est, first(labels.lang ORDER BY seq DESC) AS lang, first(labels.topic ORDER BY seq DESC) AS topic,
    count(*) AS n_rows, sum(coalesce(co2, 0)) AS co2, bool_or(status = 'APPROVED') AS approved, sum(CAST(comm AS INT)) AS comm,
    arg_max(ts, seq) FILTER (WHERE conf) AS conf_ts
  FROM d WHERE k IS NOT NULL GROUP BY g, k),
en AS (SELECT g, k, arg_max(act, seq) FILTER (WHERE act IS NOT NULL) AS act FROM a WHERE kind = 'energy' AND k IS NOT NULL GROUP BY g, k),
kwh AS (SELECT ids.*, coalesce(en.act, ids.est, 0) AS kwh, en.k IS NOT NULL AS metered FROM ids LEFT JOIN en ON ids.g = en.g AND ids.k = en.k),
ap AS (
  SELECT e.g, upheld, coalesce(nullif(e.lang, ''), nullif(ids.lang, '')) AS lang, coalesce(nullif(e.topic, ''), nullif(ids.topic, '')) AS topic
  FROM e LEFT JOIN ids ON e.g = ids.g AND e.k = ids.k WHERE etype = 'appeal_outcome'),
bd AS (
  SELECT g, 'K-03' AS kpi, 'language' AS dim, labels.lang AS member, count(*) AS n, avg(CASE WHEN near_miss THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value FROM d WHERE labels.lang <> '' GROUP BY g, labels.lang
  UNION ALL SELECT g, 'K-25', 'language', labels.lang, count(*), avg(CASE WHEN status = 'BLOCKED' AND NOT conf THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM d WHERE labels.lang <> '' GROUP BY g, labels.lang
  UNION ALL SELECT g, 'K-26', 'task_class', labels.task_class, count(*), count(DISTINCT completion_digest)::DOUBLE / count(*) FROM d WHERE labels.task_class <> '' AND completion_digest <> '' GROUP BY g, labels.task_class
  UNION ALL SELECT g, 'K-04', 'language', lang, count(*), avg(CASE WHEN upheld THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM ap WHERE lang IS NOT NULL GROUP BY g, lang
  UNION ALL SELECT g, 'K-04', 'topic', topic, count(*), avg(CASE WHEN upheld THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM ap WHERE topic IS NOT NULL GROUP BY g, topic),
held AS (SELECT g, kpi, dim, member, n, CASE WHEN n >= {K} THEN value END AS value, n < {K} AS suppressed FROM bd),
open AS (
  SELECT g, 'K-17' AS kpi, 'cause' AS dim, coalesce(cause, 'unknown') AS member, count(*) AS n, count(*)::DOUBLE AS value FROM e WHERE etype = 'breaker_trip' GROUP BY ALL
  UNION ALL SELECT g, 'K-27', 'region', coalesce(area, 'None'), 1, CASE WHEN sum(extracted) > 0 THEN coalesce(sum(returned), 0) / sum(extracted) END FROM e WHERE etype = 'value_flow' GROUP BY g, coalesce(area, 'None')
  UNION ALL SELECT g, 'K-28', 'region', coalesce(area, 'None'), 1, first(local_share ORDER BY ts DESC, event_no DESC) FROM e WHERE etype = 'capacity' GROUP BY g, coalesce(area, 'None')
  UNION ALL SELECT g, 'K-29', 'group', coalesce(grp, 'None'), 1, first(score ORDER BY ts DESC, event_no DESC) FROM e WHERE etype = 'service_quality' GROUP BY g, coalesce(grp, 'None')),
b AS (SELECT * FROM held UNION ALL SELECT *, FALSE FROM open)
"""


def _kpi_sql(by_model: bool) -> str:
    hit = lambda c: f"coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0)"
    latest = lambda corpus: f"(SELECT g, first(passed ORDER BY ts DESC, event_no) AS passed, first(total ORDER BY ts DESC, event_no) AS total FROM e WHERE etype = 'canary_result' AND corpus = '{corpus}' GROUP BY g)"
    topics = ", ".join(f"'{t}'" for t in kpi.CHALLENGE_TOPICS)
    part = lambda kid, hits, n, scale=1.0: f"SELECT g, '{kid}' AS kpi, {hits}::DOUBLE AS hits, {n} AS n, {scale}::DOUBLE AS scale, NULL::DOUBLE AS plain FROM w"
    plain = lambda kid, value, n: f"SELECT g, '{kid}', NULL, {n}, NULL, {value} FROM w"
    rows = [
        part("K-01", "conf", "n", 1e4), part("K-02", "escaped", "n", 1e4), part("K-03", "near", "n"), part("K-04", "upheld", "appeals"), plain("K-05", "hours", "reviewed"),
        plain("K-06", "s_passed::DOUBLE / s_total", "coalesce(s_total, 0)"), plain("K-07", "kwh / nullif(n, 0) * 1000", "n"), plain("K-08", "grams / nullif(n, 0)", "n"),
        plain("K-09", "used / lim", "points"), part("K-10", "metered", "n"), part("K-11", "consented", "comm"), plain("K-12", "NULL", "0"), part("K-13", "honoured", "revoked"),
        plain("K-14", "NULL", "written"), plain("K-15", "written::DOUBLE / nullif(written + failures, 0)", "written"), part("K-16", "on_time", "incidents"),
        plain("K-17", "trips::DOUBLE", "trips"), part("K-18", "evasions", "attempts"), part("K-19", "screened", "n"), part("K-20", "infra", "n", 1e4), part("K-21", "least(overrides, n)", "n"),
        part("K-22", "displaced", "scored"), plain("K-23", "NULL", "0"), part("K-24", "coalesce(c_total - c_passed, 0) + lost", "coalesce(c_total, 0) + disputes"),
        plain("K-25", "CASE WHEN rated >= 2 THEN (hi + 0.001) / (lo + 0.001) END", "n"), plain("K-26", "variety", "CASE WHEN variety IS NULL THEN 0 ELSE answers END"),
        plain("K-27", "returned", "flows"), plain("K-28", "share", "capacities"), plain("K-29", "CASE WHEN groups >= 2 AND best > 0 THEN worst / best END", "groups"),
    ]
    limits = []
    for kid, (direction, green, amber, least) in kpi.DEFINITIONS.items():
        low = lambda x: "NULL" if x is None else x[0] if isinstance(x, tuple) else x
        high = lambda x: x[1] if isinstance(x, tuple) else "NULL"
        limits.append(f"('{kid}', '{direction}', {low(green)}, {high(green)}, {low(amber)}, {high(amber)}, {min(least, K)})")
    groups = "SELECT DISTINCT g FROM a UNION SELECT DISTINCT g FROM e" if by_model else "SELECT '' AS g"
    return views_sql(by_model) + f"""
, f1 AS (SELECT g, count(*) AS n, {hit('conf')} AS conf, {hit('near_miss')} AS near, {hit('infrastructure_error')} AS infra,
    {hit("coalesce(json_array_length(gm->'unscreened'), 0) = 0")} AS screened,
    {hit("status = 'APPROVED' AND (gm->'seed_stock'->>'agency') IS NOT NULL")} AS scored, {hit("status = 'APPROVED' AND CAST(gm->'seed_stock'->>'agency' AS DOUBLE) < 1")} AS displaced,
    count(energy.budget_used_kwh + energy.budget_remaining_kwh) AS points,
    max(struct_pack(t := ts, used := energy.budget_used_kwh, lim := energy.budget_used_kwh + energy.budget_remaining_kwh))
      FILTER (WHERE energy.budget_used_kwh + energy.budget_remaining_kwh IS NOT NULL) AS last FROM d GROUP BY g),
f2 AS (SELECT g, sum(kwh) AS kwh, sum(kwh * co2) AS grams, sum(CASE WHEN metered THEN n_rows ELSE 0 END) AS metered, sum(comm) AS comm,
    sum(CASE WHEN EXISTS (SELECT 1 FROM e WHERE etype = 'consent_verified' AND e.g = kwh.g AND e.k = kwh.k) THEN comm ELSE 0 END) AS consented,
    count(conf_ts) AS incidents FROM kwh GROUP BY g),
rep AS (SELECT g, k, first(reported_at ORDER BY event_no DESC) AS reported_at FROM e WHERE etype = 'incident_reported' AND k IS NOT NULL GROUP BY g, k),
f3 AS (SELECT ids.g, {hit("reported_at - conf_ts <= INTERVAL 15 DAY")} AS on_time FROM ids JOIN rep ON ids.g = rep.g AND ids.k = rep.k GROUP BY ids.g),
f4 AS (SELECT e.g, count(*) AS escaped FROM e JOIN ids ON e.g = ids.g AND e.k = ids.k AND ids.approved WHERE etype = 'escaped_harm' GROUP BY e.g),
f5 AS (SELECT g, count(*) AS appeals, {hit('upheld')} AS upheld, {hit(f'topic IN ({topics})')} AS disputes, {hit(f'topic IN ({topics}) AND upheld')} AS lost FROM ap GROUP BY g),
f6 AS (SELECT g, median(epoch_us(reviewed_at) - epoch_us(filed_at)) FILTER (WHERE etype = 'appeal_outcome') / 3.6e9 AS hours,
    count(CASE WHEN etype = 'appeal_outcome' AND reviewed_at IS NOT NULL AND filed_at IS NOT NULL THEN 1 END) AS reviewed,
    {hit("etype = 'consent_revoked'")} AS revoked, {hit("etype = 'consent_revoked' AND honoured_at - revoked_at <= INTERVAL 72 HOUR")} AS honoured,
    {hit("etype = 'breaker_trip'")} AS trips, coalesce(sum(attempts) FILTER (WHERE etype = 'redteam_result'), 0) AS attempts,
    coalesce(sum(evasions) FILTER (WHERE etype = 'redteam_result'), 0) AS evasions, {hit("etype = 'human_override'")} AS overrides FROM e GROUP BY g),
f7 AS (SELECT g, min(value) FILTER (WHERE kpi = 'K-25') AS lo, max(value) FILTER (WHERE kpi = 'K-25') AS hi, count(value) FILTER (WHERE kpi = 'K-25') AS rated,
    avg(value) FILTER (WHERE kpi = 'K-26') AS variety, sum(n) FILTER (WHERE kpi = 'K-26') AS answers, min(value) FILTER (WHERE kpi = 'K-27') AS returned,
    count(*) FILTER (WHERE kpi = 'K-27') AS flows, min(value) FILTER (WHERE kpi = 'K-28') AS share, count(*) FILTER (WHERE kpi = 'K-28') AS capacities,
    min(value) FILTER (WHERE kpi = 'K-29') AS worst, max(value) FILTER (WHERE kpi = 'K-29') AS best, count(*) FILTER (WHERE kpi = 'K-29') AS groups FROM b GROUP BY g),
f8 AS (SELECT g, count(*) AS written, coalesce(max(sink_failures), 0) AS failures FROM a GROUP BY g),
w AS (SELECT gs.g, coalesce(n, 0) AS n, conf, near, infra, screened, coalesce(scored, 0) AS scored, displaced, coalesce(points, 0) AS points, last.used AS used, last.lim AS lim, kwh, grams, coalesce(metered, 0) AS metered,
    coalesce(comm, 0) AS comm, coalesce(consented, 0) AS consented, coalesce(incidents, 0) AS incidents, coalesce(on_time, 0) AS on_time, coalesce(escaped, 0) AS escaped,
    coalesce(appeals, 0) AS appeals, coalesce(upheld, 0) AS upheld, coalesce(disputes, 0) AS disputes, coalesce(lost, 0) AS lost, hours, coalesce(reviewed, 0) AS reviewed,
    coalesce(revoked, 0) AS revoked, coalesce(honoured, 0) AS honoured, coalesce(trips, 0) AS trips, coalesce(attempts, 0) AS attempts, coalesce(evasions, 0) AS evasions,
    coalesce(overrides, 0) AS overrides, s.passed AS s_passed, s.total AS s_total, c.passed AS c_passed, c.total AS c_total, lo, hi, coalesce(rated, 0) AS rated, variety, answers, returned,
    coalesce(flows, 0) AS flows, share, coalesce(capacities, 0) AS capacities, worst, best, coalesce(groups, 0) AS groups, coalesce(written, 0) AS written, coalesce(failures, 0) AS failures
  FROM ({groups}) gs LEFT JOIN f1 USING (g) LEFT JOIN f2 USING (g) LEFT JOIN f3 USING (g) LEFT JOIN f4 USING (g) LEFT JOIN f5 USING (g) LEFT JOIN f6 USING (g)
    LEFT JOIN f7 USING (g) LEFT JOIN f8 USING (g) LEFT JOIN {latest('protected_speech')} s USING (g) LEFT JOIN {latest('legitimate_challenge')} c USING (g)),
r AS ({' UNION ALL '.join(rows)}),
v AS (SELECT g, kpi, n, scale, hits / nullif(n, 0) AS p, CASE WHEN scale IS NULL THEN plain ELSE hits / nullif(n, 0) * scale END AS value FROM r),
q AS (SELECT *, (p + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS half FROM v WHERE n > 0
      UNION ALL SELECT *, NULL, NULL FROM v WHERE n = 0),
lim(kpi, direction, g1, g2, a1, a2, least_n) AS (VALUES {', '.join(limits)})
SELECT g, q.kpi, round(value, 9) AS value, CAST(n AS BIGINT) AS n, CASE WHEN half IS NOT NULL THEN round(greatest(0.0::DOUBLE, mid - half) * scale, 9) END AS ci_low, CASE WHEN half IS NOT NULL THEN round(least(1.0::DOUBLE, mid + half) * scale, 9) END AS ci_high,
  CASE WHEN n < least_n OR value IS NULL THEN 'insufficient_data' WHEN direction = 'info' THEN 'info'
       WHEN direction = 'band' THEN CASE WHEN value BETWEEN g1 AND g2 THEN 'green' WHEN value BETWEEN a1 AND a2 THEN 'amber' ELSE 'red' END
       WHEN direction = 'lower' THEN CASE WHEN value <= g1 THEN 'green' WHEN value <= a1 THEN 'amber' ELSE 'red' END
       ELSE CASE WHEN value >= g1 THEN 'green' WHEN value >= a1 THEN 'amber' ELSE 'red' END END AS status
FROM q JOIN lim ON q.kpi = lim.kpi
"""


QUERIES = {f.__name__: f for f in (kpi_table, kpi_by_model, kpi_breakdowns)}
SQL = {
    "kpi_table": _kpi_sql(False),
    "kpi_by_model": _kpi_sql(True),
    "kpi_breakdowns": views_sql() + "SELECT kpi, dim, member, CAST(n AS BIGINT) AS n, round(value, 9) AS value, suppressed FROM b",
}
