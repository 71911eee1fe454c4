"""Queries of the training-data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.ids import clean_name, hex_key, utc_day
from sondage.llm import leakage, lookalike, membership, packing, stuffing
from sondage.sources.tables import table

LABELS = ("model", "lang", "topic", "area", "task_class", "cohort")
GROUPINGS = [g for base in (["day"], ["tenant"], ["day", "tenant"]) for g in (base, *[[*base, x] for x in LABELS])]
#: Where the ranks file of the tokenizer is; a parameter of p6_containers.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p4_patterns(spark: SparkSession, folder: str) -> DataFrame:
    audit = table(spark, folder, "audit_records")
    dims = {"day": utc_day(F.col("ts")), "tenant": clean_name(F.col("tenant"))} | {x: F.col("labels")[x] for x in LABELS}
    return membership.patterns(membership.partial(audit, hex_key(F.col("principal_digest"), 64), dims))


def p4_distinct_principals(spark: SparkSession, folder: str) -> DataFrame:
    counts = membership.distinct_counts(p4_patterns(spark, folder), GROUPINGS)
    return counts.select("grouping", "day", "tenant", *LABELS, F.col("identifiers").alias("principals"))


_SQL_P4 = r"""
WITH a AS (
  SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, nullif(lower(regexp_replace(tenant, '^\s+|\s+$', '', 'g')), '') AS tenant,
         labels.model AS model, labels.lang AS lang, labels.topic AS topic, labels.area AS area, labels.task_class AS task_class, labels.cohort AS cohort,
         regexp_replace(lower(principal_digest), '[^0-9a-z]', '', 'g') AS p
  FROM audit_records WHERE regexp_replace(principal_digest, '\s', '', 'g') <> ''),
b AS (SELECT * REPLACE (CASE WHEN regexp_matches(p, '[0-9a-f]{64}$') THEN right(p, 64) ELSE '?' || p END AS p) FROM a)
"""


def _sql_p4() -> str:
    dims = ("day", "tenant", *LABELS)
    part = "SELECT '{name}' AS grouping, {cols}, count(DISTINCT p) AS principals FROM b GROUP BY {by}"
    return _SQL_P4 + "\nUNION ALL ".join(
        part.format(name="+".join(g), cols=", ".join(d if d in g else f"NULL AS {d}" for d in dims), by=", ".join(g)) for g in GROUPINGS
    )


def p4_combinations(spark: SparkSession, folder: str) -> DataFrame:
    """Principals in combinations of groups: seen in either of two languages, in both, in all three."""
    totals = p4_patterns(spark, folder)
    within = lambda lang: lambda c: c["lang"].eqNullSafe(F.lit(lang))
    counts = {
        "en or fr": membership.count_any(totals, lambda c: within("en")(c) | within("fr")(c)), "en and fr": membership.count_all(totals, [within("en"), within("fr")]),
        "en, fr and sw": membership.count_all(totals, [within("en"), within("fr"), within("sw")]),
    }
    parts = [df.select(F.lit(name).alias("combination"), F.col("identifiers").cast("bigint").alias("principals")) for name, df in counts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FORMS = ("harmful", "protected_speech")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [lookalike.look_alikes(table(spark, folder, t), "item_id", "text").select(F.lit(t).alias("tbl"), "id_a", "id_b") for t in _FORMS]
    return parts[0].unionByName(parts[1])


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that look like another spelling: their class and their own spelling, a row each."""
    parts = [lookalike.classes(table(spark, folder, t), "item_id", "text").withColumn("tbl", F.lit(t)) for t in _FORMS]
    return parts[0].unionByName(parts[1]).select("tbl", F.col("row_id").alias("item_id"), "class_id", "spelling_id", "spellings")


def p5_consistent_texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [lookalike.normalize(table(spark, folder, t).select(F.lit(t).alias("tbl"), "item_id", "text"), "text") for t in ("harmful", "protected_speech")]
    return parts[0].unionByName(parts[1]).select("tbl", "item_id", "consistent")


def _packed(spark: SparkSession, folder: str, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    sizes = packing.token_counts(table(spark, folder, "documents"), "doc_id", "text", tokenizer)
    limits = table(spark, folder, "pack_limits").select(F.col("limit_no").alias("bin_type"), F.col("capacity_tokens").alias("capacity"))
    return packing.pack(sizes, limits), limits


def p6_containers(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    packed, _ = _packed(spark, folder, tokenizer)
    return packed.select(F.col("bin_type").alias("limit_no"), "container_no", F.col("item_id").alias("doc_id"), "piece_no", F.col("size").alias("n_tokens"))


def p6_filling(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers, the least that could be, and the share of their room that is used, for each limit."""
    out = packing.filling(*_packed(spark, folder, tokenizer))
    return out.select(F.col("bin_type").alias("limit_no"), "capacity", "containers", "least", F.round("filled", 6).alias("filled"), "wasted")


def p6_checks(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each limit: documents packed, those packed more than once or split without need, and containers that are overfull."""
    packed, limits = _packed(spark, folder, tokenizer)
    each = packed.groupBy("bin_type", "item_id").agg(F.count("*").alias("rows"), F.count_distinct("piece_no").alias("pieces"), F.sum("size").alias("size")).join(F.broadcast(limits), "bin_type")
    wrong = (F.col("rows") != F.col("pieces")) | (F.col("pieces") != F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)))
    docs = each.groupBy("bin_type").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("wrong"))
    full = packed.groupBy("bin_type", "container_no").agg(F.sum("size").alias("used")).join(F.broadcast(limits), "bin_type").groupBy("bin_type").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return docs.join(full, "bin_type").select(F.col("bin_type").alias("limit_no"), "documents", "wrong", "overfull")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document from which spans of test items were cut: what is left of it, and how much went."""
    cleaned = leakage.without_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return cleaned.filter("removed > 0").select("doc_id", F.length("text").alias("left_chars"), "removed")


def p7_left(spark: SparkSession, folder: str) -> DataFrame:
    """What is found in the cleaned documents: leaks there must be none of."""
    cleaned = leakage.without_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    found = leakage.leaks(cleaned, table(spark, folder, "eval_items"))
    return cleaned.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(found.agg(F.count("*").alias("leaks"))))


def p8_pages(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.measure(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed(table(spark, folder, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (
    p4_distinct_principals, p4_combinations, p5_found, p5_classes, p5_consistent_texts, p6_containers, p6_filling, p6_checks, p7_found, p7_leaks, p7_cleaned, p7_left, p8_found, p8_pages,
)}
SQL = {
    "p4_distinct_principals": _sql_p4(),
    "p4_combinations": _SQL_P4
    + """, s AS (SELECT p, coalesce(bool_or(lang = 'en'), FALSE) AS en, coalesce(bool_or(lang = 'fr'), FALSE) AS fr, coalesce(bool_or(lang = 'sw'), FALSE) AS sw FROM b GROUP BY p)
    SELECT 'en or fr' AS combination, count(*) AS principals FROM s WHERE en OR fr UNION ALL SELECT 'en and fr', count(*) FROM s WHERE en AND fr
    UNION ALL SELECT 'en, fr and sw', count(*) FROM s WHERE en AND fr AND sw""",
    "p6_checks": "SELECT limit_no, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS overfull FROM pack_limits",
    "p7_left": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS leaks FROM documents",
}
