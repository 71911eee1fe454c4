"""Deeply nested records into flat related tables that keep the links between parent and child.

Method: once records are nested Arrow columns, child tables come from the buffers alone. The offsets of a list
column give the parent of each element (``list_parent_indices``) and its place within it, its elements are the
flattened values, and keys are carried down by one vectorised ``take``; levels below repeat this on the child. No row
is looked at. JSON text has to be read once before that: :func:`read_records` tokenises a line with the C decoder,
brings fields of changing shape to one shape, and builds the nested columns batch by batch. Entries that do not count
stay in their lists as nulls, so that the places of the others are those they were written at.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.ids import hex_key

#: Fixed values of the audit record: its lists of strings in governance_metadata, and scalar columns.
STRING_LISTS = ("unscreened", "lexical_hits", "mitigations", "rule_timeouts")
SCALARS = ("audit_id", "kind", "timestamp", "status", "code", "tenant", "jurisdiction_id", "principal_digest")
ENERGY = ("estimated_kwh", "actual_kwh", "carbon_intensity_g_kwh", "budget_used_kwh", "budget_remaining_kwh")
SECTIONS = ("governance_metadata", "energy", "labels", "metrics")
_OWN = frozenset({*SCALARS[1:], *SECTIONS[:3], "evaluators"})

# ``key`` is the number under which an entry was written, null for entries of plain lists: there the place counts.
_KEY = ("key", pa.int64())
_FINDINGS = pa.list_(pa.struct([_KEY, ("rule", pa.string()), ("weight", pa.float64()), ("body", pa.string())]))
_STRINGS = pa.list_(pa.struct([_KEY, ("value", pa.string())]))
ARROW = pa.schema(
    [("line_id", pa.int64()), *((c, pa.string()) for c in SCALARS), *((c, pa.float64()) for c in ENERGY)]
    + [("evaluators", pa.list_(pa.struct([_KEY, ("evaluator", pa.string()), ("passed", pa.bool_()), ("code", pa.string()), ("findings", _FINDINGS)])))]
    + [("by_stage", pa.list_(pa.struct([_KEY, ("stage", pa.string()), ("kwh", pa.float64())])))]
    + [(c, _STRINGS) for c in STRING_LISTS]
    + [("labels", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))]
)
_ITEM = "array<struct<key bigint, value string>>"
SCHEMA = (
    "line_id bigint, " + ", ".join(f"{c} string" for c in SCALARS) + ", " + ", ".join(f"{c} double" for c in ENERGY)
    + ", evaluators array<struct<key bigint, evaluator string, passed boolean, code string, findings array<struct<key bigint, rule string, weight double, body string>>>>"
    + ", by_stage array<struct<key bigint, stage string, kwh double>>, "
    + ", ".join(f"{c} {_ITEM}" for c in STRING_LISTS)
    + ", labels array<struct<name string, value string>>"
)
_DECODER = json.JSONDecoder()
#: Where an object, or encoded text of one, may start in a line.
_OPENS = re.compile(r'\{|"(?=\s*[\[{\\])')


def _decoded(v: Any) -> Any:
    """The value of text that is itself a JSON object, list or string of such, however often it was encoded; else ``v``."""
    while isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"'):  # each turn's text is shorter than the one before
        try:
            v = json.loads(v)
        except (ValueError, RecursionError):
            break
    return v


def _fits(d: dict) -> int:
    """How many fields of an audit record an object has besides its audit_id; -1 without an audit_id."""
    v = d.get("audit_id")
    return len(_OWN & {k.partition(".")[0] for k in d}) if isinstance(v, str) and v.strip() else -1


def _record(v: Any) -> dict | None:
    """The audit record inside ``v``, under any number of wrapping objects, lists and encoded texts.

    Of several objects with an audit_id, one of them a wrapper's, the one with most of a record's fields; of equals the outermost.
    """
    best, most = None, -1
    waiting = deque([v])
    while waiting:
        v = _decoded(waiting.popleft())
        if isinstance(v, dict):
            if (fit := _fits(v)) > most:
                best, most = v, fit
                if fit > 2:  # kind and time, or more: a record itself, not the shipper's note about one
                    return v
            v = v.values()
        elif not isinstance(v, list):
            continue
        waiting.extend(x for x in v if isinstance(x, (dict, list)) or isinstance(x, str) and ("audit_id" in x or "\\u" in x))
    return best


#: Nesting that the decoder takes, and the tokens that make up nesting.
_DEPTH = 400
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]')


def _shallow(text: str) -> list[int]:
    """Where the outermost objects start that nest no deeper than the decoder goes; one pass over the text."""
    out: list[int] = []
    open_: list[tuple[int, int, int]] = []  # start, depth below, how many of ``out`` came before it
    for m in _TOKENS.finditer(text):
        if m[0] in "{[":
            open_.append((m.start(), 0, len(out)))
        elif m[0] in "}]" and open_:
            start, depth, before = open_.pop()
            if depth < _DEPTH and text[start] == "{":
                del out[before:]
                out.append(start)
            if open_:
                above, deepest, n = open_[-1]
                open_[-1] = (above, max(deepest, depth + 1), n)
    return out


def _scan(text: str, places: Iterable[int]) -> dict | None:
    """The record in one of the objects that start at ``places``; those within an object that was read are part of it."""
    best, most, end = None, -1, 0
    for start in places:
        if start < end:
            continue
        try:
            v, end = _DECODER.raw_decode(text, start)
        except ValueError:
            continue
        if (found := _record(v)) is not None and (fit := _fits(found)) > most:
            best, most = found, fit
    return best


def read_line(line: str | None) -> dict | None:
    """The whole audit record that can be read from a line, or null for none (blank, broken, something else).

    Text around a record, as a shipper's prefix, does not matter: every place where an object may open is tried.
    """
    if not line or not ("audit_id" in line or "\\u" in line):
        return None
    text = line.strip().lstrip("\ufeff").strip()
    try:
        try:
            return _record(json.loads(text))
        except ValueError:
            return _scan(text, (m.start() for m in _OPENS.finditer(text)))
    except RecursionError:
        return _scan(text, _shallow(text))


def _undotted(record: dict) -> dict:
    """``a.b`` keys of known sections become keys of the section."""
    if not any("." in k for k in record):
        return record
    out: dict = {}
    for k, v in record.items():
        head, dot, tail = k.partition(".")
        if not (dot and head in SECTIONS):
            out[k] = v
    for k, v in record.items():
        head, dot, tail = k.partition(".")
        if dot and head in SECTIONS:
            inner = _decoded(out.get(head))
            out[head] = {**(inner if isinstance(inner, dict) else {}), tail: v}
    return out


def _entries(v: Any) -> list[tuple[int | None, Any]]:
    """(key, entry) of a field that should be a list, whatever its shape; the key is null where the place says it."""
    v = _decoded(v)
    if v is None:
        return []
    if isinstance(v, list):
        return [(None, x) for x in v]
    if isinstance(v, dict) and v and all(k.isascii() and k.isdigit() for k in v):
        return [(int(k), x) for k, x in v.items()]
    return [(None, v)]


def _objects(v: Any) -> list[tuple[int | None, dict | None]]:
    """(key, object) of every entry, null in the place of any that is no object."""
    return [(k, d if isinstance(d := _decoded(x), dict) else None) for k, x in _entries(v)] if v not in ({}, "{}") else []


def _text(v: Any) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def _number(v: Any) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _labels(v: Any) -> list[dict]:
    v = _decoded(v)
    pairs: list[tuple[Any, Any]] = []
    if isinstance(v, dict):
        pairs = list(v.items())
    elif isinstance(v, list):
        for x in v:
            if isinstance(x, dict):
                name = next((x[k] for k in ("key", "name", "label") if k in x), None)
                pairs += [(name, x.get("value"))] if name is not None else list(x.items())
    return [{"name": str(k), "value": _text(x)} for k, x in dict(pairs).items() if x is not None]


def canonical(record: dict) -> dict:
    """The record in the one shape of :data:`ARROW`, without ``line_id``."""
    r = _undotted(record)
    energy, meta = _decoded(r.get("energy")), _decoded(r.get("governance_metadata"))
    energy, meta = energy if isinstance(energy, dict) else {}, meta if isinstance(meta, dict) else {}
    out: dict = {c: _text(r.get(c)) for c in SCALARS} | {c: _number(energy.get(c)) for c in ENERGY}
    evaluators: list[dict | None] = []
    for k, e in _objects(r.get("evaluators")):
        if e is None:
            evaluators.append(None)
            continue
        e = _undotted(e)
        metrics = _decoded(e.get("metrics"))
        found = _objects(metrics.get("findings")) if isinstance(metrics, dict) else []
        evaluators.append({
            "key": k, "evaluator": _text(e.get("evaluator")), "passed": e.get("passed") if isinstance(e.get("passed"), bool) else None, "code": _text(e.get("code")),
            "findings": [f and {"key": j, "rule": _text(f.get("rule")), "weight": _number(f.get("weight")), "body": json.dumps(f, ensure_ascii=False)} for j, f in found],
        })
    out["evaluators"] = evaluators
    out["by_stage"] = [s and {"key": k, "stage": _text(s.get("stage")), "kwh": _number(s.get("kwh"))} for k, s in _objects(energy.get("by_stage"))]
    for c in STRING_LISTS:
        out[c] = [{"key": k, "value": x} if isinstance(x, str) else None for k, x in _entries(meta.get(c))]
    out["labels"] = _labels(r.get("labels"))
    return out


def read_records(df: DataFrame, line_id: str, line: str) -> DataFrame:
    """Nested audit records, one per line from which a whole record can be read, with the columns of :data:`SCHEMA`.

    Lines that are null, blank, broken or no audit record give no row. Absent and null lists are empty. Other
    columns of ``df`` are ignored, so their names can't clash.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [{"line_id": i} | canonical(r) for i, x in zip(ids, batch.column(1).to_pylist()) if (r := read_line(x))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return df.select(F.col(line_id).cast("bigint"), F.col(line)).mapInArrow(parse, SCHEMA)


def first_deliveries(records: DataFrame, *columns: Column | str) -> DataFrame:
    """Of the deliveries with the same audit_id, however written, and the same kind, the one with the smallest line_id.

    (line_id, <columns>), or all columns of ``records`` if none are named. One shuffle, of the columns asked for alone;
    deliveries are combined on the map side, so a record delivered any number of times sends one row per task.
    """
    key = F.coalesce(hex_key(F.col("audit_id"), 32), F.lit(""))
    asked = [F.col("line_id"), *columns] if columns else [F.col(c) for c in records.columns]
    best = records.groupBy(key.alias("record_key"), F.coalesce("kind", F.lit("")).alias("record_kind")).agg(F.min_by(F.struct(*asked), "line_id").alias("r"))
    return best.select("r.*")


def _list(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Parent index, place and value of every element of a list column, from its offsets. Null lists have none."""
    parent, values = pc.list_parent_indices(column), pc.list_flatten(column)
    # The place within the parent: the running number less that of the parent's first element.
    starts = pc.subtract(pc.cumulative_sum(pc.fill_null(pc.list_value_length(column), 0).cast(pa.int64())), pc.fill_null(pc.list_value_length(column), 0).cast(pa.int64()))
    running = pa.array(np.arange(len(values), dtype=np.int64))
    return parent, pc.subtract(running, pc.take(starts, parent)), values


def _fields(values: pa.Array) -> dict[str, pa.Array]:
    return dict(zip((f.name for f in values.type), values.flatten(), strict=True))


def flatten_column(batch: pa.RecordBatch, path: Sequence[str], keys: Sequence[str]) -> pa.RecordBatch:
    """The child table at ``path`` of a batch: keys, ordinal of each level (``<level>_no``), and the element's fields.

    A list of plain values has one field, ``value``. Elements that are null stay, with null fields.
    """
    carried = {k: batch.column(batch.schema.get_field_index(k)) for k in keys}
    fields = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
    for level in path:
        parent, ordinal, values = _list(fields[level])
        carried = {k: v.take(parent) for k, v in carried.items()} | {f"{level}_no": ordinal}
        fields = _fields(values) if pa.types.is_struct(values.type) else {"value": values}
    clash = {k: f"parent_{k}" if k in fields else k for k in carried}
    plain = {k: v for k, v in fields.items() if not pa.types.is_nested(v.type)}
    return pa.RecordBatch.from_arrays([*carried.values(), *plain.values()], names=[*clash.values(), *plain])


def child_table(df: DataFrame, keys: Sequence[str], path: Sequence[str]) -> DataFrame:
    """The list at ``path`` (a column, or a column and lists of structs below it) as a table of its own.

    A row per element with the parent's ``keys``, the position of each level as ``<level>_no`` from 0, and the
    element's fields that are not nested themselves. Keys that an element's field also names come out as
    ``parent_<key>``. Null and empty lists give no rows. Only the keys and the one column are read.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    narrow = df.select(*keys, path[0])
    empty = pa.RecordBatch.from_pylist([], schema=to_arrow_schema(narrow.schema))
    schema = from_arrow_schema(flatten_column(empty, path, keys).schema, prefer_timestamp_ntz=True)
    for f, key in zip(schema.fields, keys):  # the keys come first; Arrow has no word for some of Spark's types
        f.dataType = narrow.schema[key].dataType
    for f in schema.fields:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = flatten_column(batch, path, keys)
            if out.num_rows:
                yield out

    return narrow.mapInArrow(run, schema)


def positions() -> list[Column]:
    """What :func:`elements` needs of the children of records: their entries and keys, without the contents."""
    bare = lambda x: F.when(x.isNotNull(), F.struct(x["key"].alias("key")))
    full = lambda e: F.when(e.isNotNull(), F.struct(e["key"].alias("key"), F.transform(e["findings"], bare).alias("findings")))
    return [
        F.transform("evaluators", full).alias("evaluators"), *[F.transform(c, bare).alias(c) for c in ("by_stage", *STRING_LISTS)],
        F.transform("labels", lambda x: F.struct(x["name"].alias("name"))).alias("labels"),
    ]


def elements(records: DataFrame) -> DataFrame:
    """Every element of every child of audit records as (line_id, child, elem), elem as the element was written.

    ``findings`` are numbered by evaluator and finding (``2/0``), ``labels`` by name, all others by their place, which
    the offsets give, or by the number that was their key. Entries that are null do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(ids: pa.Array, child: str, elem: pa.Array, counts: pa.Array) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([ids, pa.array([child] * len(ids), pa.string()), elem], names=["line_id", "child", "elem"])
            return rows.filter(counts)

        for batch in batches:
            key = batch.column(0)
            for i, field in enumerate(batch.schema.names[1:], 1):
                parent, place, values = _list(batch.column(i))
                ids, got, counts = key.take(parent), _fields(values), pc.is_valid(values)
                elem = got["name"] if field == "labels" else pc.coalesce(got["key"], place).cast(pa.string())
                yield named(ids, field, elem, counts)
                if field == "evaluators":
                    below, at, found = _list(got["findings"])
                    own = pc.coalesce(_fields(found)["key"], at).cast(pa.string())
                    yield named(ids.take(below), "findings", pc.binary_join_element_wise(elem.take(below), own, "/"), pc.is_valid(found))

    children = ["evaluators", "by_stage", *STRING_LISTS, "labels"]
    return records.select("line_id", *children).mapInArrow(run, "line_id bigint, child string, elem string")
