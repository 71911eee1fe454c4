import json
import random

from sondage.operators import nested

RECORD = {
    "audit_id": "539db1820ca44768ab919effbfeddb15", "kind": "decision", "labels": {"model": "m", "topic": None},
    "evaluators": [{"evaluator": "a", "passed": True, "metrics": {"findings": [{"rule": "r1", "weight": 0.5}, None, {"rule": "r2"}]}}, None, "skipped", {"evaluator": "b", "metrics": None}],
    "governance_metadata": {"unscreened": ["file", None, "image"], "mitigations": "defer"}, "energy": {"estimated_kwh": 0.5, "by_stage": [{"stage": "judge", "kwh": 1.0}]},
}
ELEMENTS = {
    ("evaluators", "0"), ("evaluators", "3"), ("findings", "0/0"), ("findings", "0/2"), ("unscreened", "0"), ("unscreened", "2"), ("mitigations", "0"),
    ("by_stage", "0"), ("labels", "model"),
}


def shapes(r):
    """The same record in other shapes and wrappings."""
    out = [r, [r], {"shipper": "x", "record": r}, {"record": json.dumps(r)}, json.dumps(r)]
    dotted = {k: v for k, v in r.items() if k != "governance_metadata"} | {f"governance_metadata.{k}": v for k, v in r["governance_metadata"].items()}
    encoded = r | {k: json.dumps(r[k]) for k in ("evaluators", "labels", "energy", "governance_metadata")}
    numbered = r | {"evaluators": {str(i): e for i, e in enumerate(r["evaluators"])}, "labels": [{"key": k, "value": v} for k, v in r["labels"].items()]}
    single = r | {"energy": {"by_stage": r["energy"]["by_stage"][0]}}
    return [json.dumps(x) for x in (*out, dotted, encoded, numbered, single)] + ["﻿" + json.dumps(r), "  " + json.dumps(r) + "\n", "host app: " + json.dumps(r)]


def test_every_shape_gives_the_same_elements(spark):
    lines = shapes(RECORD)
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, line string")
    got = nested.elements(nested.read_records(df, "raw_id", "line")).collect()
    for i, line in enumerate(lines):
        assert {(r.child, r.elem) for r in got if r.line_id == i} == ELEMENTS, line


def test_any_number_of_wrappings():
    boxed, text = RECORD, RECORD
    for i in range(50):
        boxed = [boxed] if i % 2 else {"note": {"audit_id": "the shipper's own"}, "inner": boxed}
    for _ in range(9):
        text = json.dumps(text)
    whole = json.dumps(RECORD)
    very_deep = '{"w":' * 5_000 + whole + "}" * 5_000
    lines = [json.dumps(boxed), text, "[shipper {host=a}] {} " + whole, "app: " + json.dumps(whole), very_deep, "pre " + very_deep, "{" + whole, whole + " trailing {"]
    lines.append(json.dumps({"audit_id": "a wrapper with an id of its own", "record": RECORD}))
    for line in lines:
        assert nested.read_line(line) == RECORD, line[:80]


def test_lines_that_do_not_count(spark):
    whole = json.dumps(RECORD)
    lines = [None, "", "   ", "null", "[]", "{}", "-- rotated --", "42", '"text"', whole[:-1], whole[: len(whole) // 2], json.dumps({"kind": "x"}), json.dumps({"audit_id": " "}), json.dumps({"audit_id": None})]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, line string")
    assert nested.read_records(df, "raw_id", "line").count() == 0


def test_smallest_delivery_wins_however_the_id_is_written(spark):
    a, b = dict(RECORD), dict(RECORD, audit_id="urn:uuid:539DB182-0CA4-4768-AB91-9EFFBFEDDB15", evaluators=[])
    other = dict(RECORD, kind="energy")
    df = spark.createDataFrame([(7, json.dumps(a)), (3, json.dumps(b)), (2, json.dumps(a)[:-2]), (9, json.dumps(other)), (9, json.dumps(other))], "raw_id bigint, line string")
    kept = nested.first_deliveries(nested.read_records(df, "raw_id", "line"))
    assert sorted(r.line_id for r in kept.select("line_id").collect()) == [3, 9]


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "raw_id bigint, line string")
    assert nested.elements(nested.first_deliveries(nested.read_records(none, "raw_id", "line"))).count() == 0
    clash = spark.createDataFrame([(1, json.dumps(RECORD), "x", 5)], "raw_id bigint, line string, elem string, line_id int")
    assert nested.elements(nested.read_records(clash, "raw_id", "line")).count() == len(ELEMENTS)


def test_very_long_line(spark):
    many = dict(RECORD, evaluators=[{"evaluator": "e" * 50, "metrics": {"findings": [{"rule": "r"}] * 3}}] * 20_000)
    df = spark.createDataFrame([(1, json.dumps(many))], "raw_id bigint, line string")
    counts = {r.child: r["count"] for r in nested.elements(nested.read_records(df, "raw_id", "line")).groupBy("child").count().collect()}
    assert counts["evaluators"] == 20_000 and counts["findings"] == 60_000


def test_child_tables_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        es = None if rng.random() < 0.1 else [None if rng.random() < 0.1 else (f"e{j}", None if rng.random() < 0.2 else [(f"f{k}", k) for k in range(rng.randint(0, 3))]) for j in range(rng.randint(0, 4))]
        rows.append((i, f"k{i}", es))
    df = spark.createDataFrame(rows, "id bigint, name string, es array<struct<name: string, fs: array<struct<rule: string, id: int>>>>")
    one = {(r.id, r.parent_name, r.es_no, r.name) for r in nested.child_table(df, ["id", "name"], ["es"]).collect()}
    assert one == {(i, n, j, e[0] if e else None) for i, n, es in rows for j, e in enumerate(es or [])}
    two = nested.child_table(df, ["id"], ["es", "fs"])
    assert two.columns == ["parent_id", "es_no", "fs_no", "rule", "id"]
    assert {tuple(r) for r in two.collect()} == {(i, j, k, f[0], f[1]) for i, _, es in rows for j, e in enumerate(es or []) if e for k, f in enumerate(e[1] or [])}


def test_child_table_of_plain_values(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, None), (3, [])], "id bigint, xs array<string>")
    assert {tuple(r) for r in nested.child_table(df, ["id"], ["xs"]).collect()} == {(1, 0, "a"), (1, 1, None), (1, 2, "b")}
