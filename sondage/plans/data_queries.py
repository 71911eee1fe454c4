"""Queries of the general data problems: nested records, orphan references, rolling totals; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.ids import clean_name, hex_key, utc_day
from sondage.operators import nested, references, rolling
from sondage.sources.tables import table

SPANS = (7, 30)


def p1_records(spark: SparkSession, folder: str, *columns: Column | str) -> DataFrame:
    return nested.first_deliveries(nested.read_records(table(spark, folder, "audit_raw"), "raw_id", "line"), *columns)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.elements(p1_records(spark, folder, *nested.positions())).select(F.col("line_id").alias("raw_id"), "child", "elem")


def _counted(c: Column) -> Column:
    """Entries with the place they were written at, without those that do not count."""
    placed = F.transform(c, lambda x, i: F.when(x.isNotNull(), F.struct(F.coalesce(x["key"], i.cast("bigint")).alias("pos"), *[x[f].alias(f) for f in ("evaluator", "passed", "code", "findings")])))
    return F.filter(placed, lambda x: x.isNotNull())


def p1_raw_evaluators(spark: SparkSession, folder: str) -> DataFrame:
    return nested.child_table(p1_records(spark, folder, _counted(F.col("evaluators")).alias("evaluators")), ["line_id"], ["evaluators"])


def p1_raw_findings(spark: SparkSession, folder: str) -> DataFrame:
    found = nested.child_table(p1_records(spark, folder, _counted(F.col("evaluators")).alias("evaluators")), ["line_id"], ["evaluators", "findings"])
    return found.filter("body IS NOT NULL")  # entries that are no objects


def p1_evaluators(spark: SparkSession, folder: str) -> DataFrame:
    flat = nested.child_table(table(spark, folder, "audit_records"), ["seq"], ["evaluators"])
    return flat.select("seq", F.col("evaluators_no").alias("pos"), "evaluator", "passed", "code")


SQL_P1_EVALUATORS = """
SELECT seq, pos - 1 AS pos, e.evaluator AS evaluator, e.passed AS passed, e.code AS code
FROM (SELECT seq, unnest(evaluators) AS e, generate_subscripts(evaluators, 1) AS pos FROM audit_records)
"""


def _p2_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    audit, events = table(spark, folder, "audit_records"), table(spark, folder, "accountability_events")
    key = hex_key(F.col("audit_id"), 32)
    refs = references.references(events, "accountability_events", "event_no", key, "received_at").unionByName(
        references.references(audit.filter("kind = 'energy'"), "audit_records", "seq", key, "ingested_at")
    )
    targets = audit.filter("kind IS NULL OR kind <> 'energy'").select(key.alias("key"), F.col("ingested_at").alias("arrival"))
    return refs, targets, table(spark, folder, "audit_erasures").select(key.alias("key"))


def p2_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphans(*_p2_inputs(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_orphans(spark, folder).select("src_table", "row_id", "state")


def p2_orphans_by_period(spark: SparkSession, folder: str) -> DataFrame:
    counts = references.orphan_counts(*_p2_inputs(spark, folder), F.date_format(utc_day(F.col("arrival")), "yyyy-MM"))
    return counts.select("src_table", "period", "state", "orphans")


_SQL_P2 = """
WITH k AS (
  SELECT 'accountability_events' AS src_table, event_no AS row_id, audit_id, received_at AS arrival, 'ref' AS side FROM accountability_events
  UNION ALL SELECT 'audit_records', seq, audit_id, ingested_at, CASE WHEN kind = 'energy' THEN 'ref' ELSE 'target' END FROM audit_records
  UNION ALL SELECT 'audit_erasures', erasure_no, audit_id, NULL, 'erased' FROM audit_erasures),
h AS (
  SELECT *, regexp_replace(lower(audit_id), '[^0-9a-z]', '', 'g') AS plain FROM k WHERE regexp_replace(audit_id, '\\s', '', 'g') <> ''),
n AS (
  SELECT src_table, row_id, arrival, side,
         CASE WHEN regexp_matches(plain, '[0-9a-f]{32}$') THEN right(plain, 32) ELSE '?' || plain END AS key FROM h),
t AS (SELECT key, min(arrival) AS first_seen FROM n WHERE side = 'target' GROUP BY key),
e AS (SELECT DISTINCT key FROM n WHERE side = 'erased'),
o AS (
  SELECT n.src_table, n.row_id, n.arrival,
         CASE WHEN t.key IS NOT NULL THEN CASE WHEN t.first_seen > n.arrival THEN 'late' END
              WHEN e.key IS NOT NULL THEN 'erased' ELSE 'missing' END AS state
  FROM n LEFT JOIN t USING (key) LEFT JOIN e USING (key) WHERE n.side = 'ref')
"""
SQL_P2_FOUND = _SQL_P2 + "SELECT src_table, row_id, state FROM o WHERE state IS NOT NULL"
SQL_P2_BY_PERIOD = (
    _SQL_P2
    + "SELECT src_table, strftime(arrival AT TIME ZONE 'UTC', '%Y-%m') AS period, state, count(*) AS orphans FROM o WHERE state IS NOT NULL GROUP BY ALL"
)


def _p3(spark: SparkSession, folder: str, quiet: bool) -> DataFrame:
    audit = table(spark, folder, "audit_records")
    last = rolling.last_day(audit, F.col("ts"))
    kwh = F.col("energy.estimated_kwh")
    days = rolling.daily(audit, clean_name(F.col("tenant")), F.col("ts"), kwh, (F.col("kind") == "decision") & (kwh > 0) & ~F.isnan(kwh))
    out = rolling.rolling(days, SPANS, -1 if last is None else last, quiet=quiet)
    return out.withColumns({"tenant": F.col("entity"), "on_day": F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p3(spark, folder, quiet=True).select("tenant", "on_day", "span_days")


def p3_rolling_energy(spark: SparkSession, folder: str) -> DataFrame:
    totals = rolling.with_averages(_p3(spark, folder, quiet=False))
    r = lambda c, n: F.round(c, n).alias(c)
    return totals.select("tenant", "on_day", "span_days", "records", r("total", 6), r("per_day", 9), r("per_record", 12))


_SQL_P3 = r"""
WITH c AS (
  SELECT lower(regexp_replace(tenant, '^\s+|\s+$', '', 'g')) AS tenant, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS d, energy.estimated_kwh AS kwh
  FROM audit_records WHERE kind = 'decision' AND energy.estimated_kwh > 0 AND NOT isnan(energy.estimated_kwh)),
a AS (SELECT tenant, d, count(*) AS records, sum(kwh) AS total FROM c WHERE tenant <> '' GROUP BY ALL),
l AS (SELECT max(CAST(ts AT TIME ZONE 'UTC' AS DATE)) AS last_d FROM audit_records),
s AS (SELECT unnest([7, 30]) AS span_days),
w AS (
  SELECT a.tenant, a.d + CAST(i AS INTEGER) AS day, s.span_days, sum(a.records) AS records, sum(a.total) AS total
  FROM a CROSS JOIN s CROSS JOIN range(0, 30) r(i) CROSS JOIN l
  WHERE i < s.span_days AND a.d + CAST(i AS INTEGER) <= l.last_d GROUP BY ALL)
"""
SQL_P3_FOUND = _SQL_P3 + (
    "SELECT w.tenant, strftime(w.day, '%Y-%m-%d') AS on_day, CAST(span_days AS BIGINT) AS span_days FROM w "
    "WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.tenant = w.tenant AND a.d = w.day)"
)
SQL_P3_ROLLING = _SQL_P3 + (
    "SELECT tenant, strftime(day, '%Y-%m-%d') AS on_day, CAST(span_days AS BIGINT) AS span_days, CAST(records AS BIGINT) AS records, "
    "round(total, 6) AS total, round(total / span_days, 9) AS per_day, round(total / records, 12) AS per_record FROM w"
)

QUERIES = {f.__name__: f for f in (p1_found, p1_raw_evaluators, p1_raw_findings, p1_evaluators, p2_found, p2_orphans_by_period, p3_found, p3_rolling_energy)}
SQL = {
    "p1_evaluators": SQL_P1_EVALUATORS,
    "p2_found": SQL_P2_FOUND,
    "p2_orphans_by_period": SQL_P2_BY_PERIOD,
    "p3_found": SQL_P3_FOUND,
    "p3_rolling_energy": SQL_P3_ROLLING,
}
