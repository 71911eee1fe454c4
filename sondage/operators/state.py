"""Order-dependent state: the energy budget with refusals, the circuit breaker, the hash chain.

Each has a pure step function, used alike by the batch replay here and by the streaming operators. Batches run
per key (a tenant, a chain): rows reach a task sorted by the sort of the shuffle and are streamed through it, so no
group is held in memory.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# --- budget ---
def admit(used: float, kwh: float, limit: float) -> tuple[bool, float]:
    """Whether a request fits, and what is used afterwards. Refused requests use nothing."""
    return (True, used + kwh) if used + kwh <= limit else (False, used)


def refund(used: float, kwh: float) -> float:
    return max(0.0, used - kwh)


def _streamed(batches: Iterator[pa.RecordBatch], step, keys: int, names: list[str], types: list) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Runs ``step(state, row) -> (state, out)`` over rows sorted by their first column, with a new state for every key."""
    key, state = object(), None
    for b in batches:
        rows = list(zip(*[c.to_pylist() for c in b.columns]))
        out = []
        for r in rows:
            if r[0] != key:
                key, state = r[0], None
            state, o = step(state, r)
            out.append((*r[:keys], *o))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _requests(requests: DataFrame, key: str, order: tuple[str, ...], kwh: str, *extra: Column) -> DataFrame:
    """(key, seq, kwh, <extra>), sorted by key and order within partitions that hold whole keys."""
    rows = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "seq", F.greatest(F.coalesce(F.nanvl(F.col(kwh), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("kwh"),
                           *extra, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    placed = [f"_o{i}" for i in range(len(order))]
    return rows.repartition("key").sortWithinPartitions("key", *placed).drop(*placed)


def budget(requests: DataFrame, limit: float, key: str = "tenant", order: tuple[str, ...] = ("ts", "seq"), kwh: str = "kwh", refunded: str | None = None) -> DataFrame:
    """(key, seq, admitted, used): each request in order against a budget per key; null and negative energy count as 0.

    ``refunded`` names a boolean column: such an admitted request gives its energy back at once. A budget is one
    sequence by nature: a key's requests are one task, and are streamed through it.
    """
    sorted_ = _requests(requests, key, order, kwh, (F.coalesce(F.col(refunded), F.lit(False)) if refunded else F.lit(False)).alias("refund"))

    def step(used, r):
        ok, used = admit(used or 0.0, r[2], limit)
        return (refund(used, r[2]) if ok and r[3] else used), (ok, used)

    return sorted_.mapInArrow(
        lambda it: _streamed(it, step, 2, ["key", "seq", "admitted", "used"], [pa.string(), pa.int64(), pa.bool_(), pa.float64()]), "key string, seq bigint, admitted boolean, used double"
    )


def throttle(requests: DataFrame, limit: float, key: str = "tenant", order: tuple[str, ...] = ("ts", "seq"), kwh: str = "kwh") -> DataFrame:
    """(key, seq, used, over): the budget tracked but not enforced. Every request counts; ``over`` tells whether the limit is passed.

    Without refusals it is a running total, so it needs no Python and no state but the window's.
    """
    rows = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "seq", F.greatest(F.coalesce(F.nanvl(F.col(kwh), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("kwh"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    w = W.partitionBy("key").orderBy(*[f"_o{i}" for i in range(len(order))]).rowsBetween(W.unboundedPreceding, 0)
    return rows.select("key", "seq", F.sum("kwh").over(w).alias("used")).withColumn("over", F.col("used") > limit)


def reconciled(decisions: DataFrame, meters: DataFrame) -> DataFrame:
    """(key, seq, delta, held): what each reading changes in the budget held for its decision, and what is held then.

    ``decisions`` (key, kwh), ``meters`` (key, ts, seq, actual). The first reading is set against the estimate that was
    reserved, each later one against the reading before. Readings that are no finite quantities are left out; readings of
    unknown decisions are set against 0. Decisions are taken once for each key, the last of several by ``seq`` if they have one.
    """
    last = F.max_by("kwh", "seq") if "seq" in decisions.columns else F.max("kwh")
    held = decisions.filter("key IS NOT NULL").groupBy("key").agg(F.coalesce(last, F.lit(0.0)).alias("reserved"))
    sound = meters.filter("key IS NOT NULL AND actual >= 0 AND NOT isnan(actual) AND actual < double('inf')").select("key", "ts", "seq", "actual")
    before = F.lag("actual").over(W.partitionBy("key").orderBy("ts", "seq"))
    rows = sound.withColumn("before", before).join(held, "key", "left")
    return rows.select("key", "seq", (F.col("actual") - F.coalesce("before", "reserved", F.lit(0.0))).alias("delta"), F.col("actual").alias("held"))


# --- breaker ---
@dataclass
class Breaker:
    """A breaker per system: suspends callers, trips as a whole, and probes before it closes again."""

    threshold: int = 5
    window_s: float = 300.0
    principals: int = 3
    cooldown_s: float = 600.0
    probe_threshold: int = 2
    own_threshold: int | None = None  # of one caller; the same as of all by default
    state: str = "CLOSED"
    opened_at: float = 0.0
    hits: deque = field(default_factory=deque)  # (time, caller) within the window
    probation: list = field(default_factory=list)  # callers of violations while probing
    suspended: dict = field(default_factory=dict)  # caller -> since
    trips: int = 0
    reason: str = ""

    def _age(self, now: float) -> None:
        while self.hits and now - self.hits[0][0] > self.window_s:
            self.hits.popleft()
        self.suspended = {w: t for w, t in self.suspended.items() if now - t < self.cooldown_s}
        if self.state == "OPEN" and now - self.opened_at >= self.cooldown_s:
            self.state, self.probation = "HALF_OPEN", []

    def admit(self, now: float, who: str) -> str:
        self._age(now)
        return "GLOBAL_OPEN" if self.state == "OPEN" else "PRINCIPAL_SUSPENDED" if who in self.suspended else "ALLOW"

    def violation(self, now: float, who: str, reason: str = "") -> None:
        """A confirmed violation of one caller; in a probe it takes several callers to open again."""
        self._age(now)
        self.hits.append((now, who))
        if sum(w == who for _, w in self.hits) >= (self.own_threshold or self.threshold):
            self.suspended[who] = now
        if self.state == "HALF_OPEN":
            self.probation.append(who)
            if len(self.probation) >= self.probe_threshold and len(set(self.probation)) >= 2:
                self.trip(now, reason or "violations while probing")
        elif len(self.hits) >= self.threshold and len({w for _, w in self.hits}) >= self.principals:
            self.trip(now, reason or "too many violations")

    def success(self, now: float) -> None:
        self._age(now)
        if self.state == "HALF_OPEN":
            self.state = "CLOSED"
            self.probation = []
            self.hits.clear()

    def trip(self, now: float, reason: str = "") -> None:
        """Opens at once, also by order."""
        self.state, self.opened_at, self.reason = "OPEN", now, reason
        self.probation = []
        self.hits.clear()
        self.trips += 1

    def reset(self) -> None:
        self.state, self.opened_at, self.reason = "CLOSED", 0.0, ""
        self.probation = []
        self.hits.clear()
        self.suspended.clear()

    def snapshot(self) -> dict:
        return {"state": self.state, "opened_at": self.opened_at, "in_window": len(self.hits), "callers": len({w for _, w in self.hits}), "suspended": sorted(self.suspended), "trips": self.trips}


def breaker(rows: DataFrame, key: str | None = None, **settings: float) -> DataFrame:
    """(key, seq, admission, state): a replay in order of (ts, seq) of requests (seq, ts, principal, violation).

    The breaker is one sequence by nature. ``key`` shards it, for instance by tenant, so that each has a breaker of its
    own; without it a system's whole traffic is one sequence. Callers without a name are one caller.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("")) if key else F.lit("")
    d = rows.select(k.alias("key"), "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.coalesce("principal", F.lit("anonymous")).alias("who"), F.coalesce("violation", F.lit(False)).alias("bad"))
    d = d.repartition("key").sortWithinPartitions("key", "t", "seq")

    def step(b, r):
        b = b or Breaker(**settings)
        verdict = b.admit(r[2], r[3])
        if verdict == "ALLOW":
            b.violation(r[2], r[3]) if r[4] else b.success(r[2])
        return b, (verdict, b.state)

    return d.mapInArrow(lambda it: _streamed(it, step, 2, ["key", "seq", "admission", "state"], [pa.string(), pa.int64(), pa.string(), pa.string()]), "key string, seq bigint, admission string, state string")


# --- chain ---
GENESIS = "0" * 64


def canonical(record: dict) -> str:
    """The text that is signed: sorted keys, no spaces, ASCII, without the signature itself."""
    return json.dumps({k: v for k, v in record.items() if k != "record_hmac"}, sort_keys=True, separators=(",", ":"))


def sign(record: dict, key: bytes) -> str:
    return hmac.new(key, canonical(record).encode(), hashlib.sha256).hexdigest()


def write_chain(records: list[dict], key: bytes, previous: str = GENESIS) -> list[dict]:
    """Records with prev_digest and record_hmac, in order; serial by nature, one shard at a time."""
    out = []
    for r in records:
        r = {**r, "prev_digest": previous}
        previous = sign(r, key)
        out.append({**r, "record_hmac": previous})
    return out


CHAINED = "shard string, seq bigint, prev_digest string, record_hmac string, raw string"


def write_chains(records: DataFrame, key: bytes) -> DataFrame:
    """Signed chains, one for each shard, of (shard, seq, body), body a record as JSON text: rows of :data:`CHAINED`.

    A chain is a sequence by nature; shards are written side by side, and a shard's records are streamed in order of seq.
    Bodies that are no JSON objects are kept as text under ``body``. Null shards are one shard.
    """

    def step(previous: str | None, r: tuple) -> tuple:
        try:
            record = json.loads(r[2])
        except (TypeError, ValueError):
            record = None
        record = record if isinstance(record, dict) else {"body": r[2]}
        record["prev_digest"] = previous or GENESIS
        mac = sign(record, key)
        return mac, (record["prev_digest"], mac, json.dumps({**record, "record_hmac": mac}, sort_keys=True, separators=(",", ":")))

    rows = records.select(F.coalesce(F.col("shard").cast("string"), F.lit("")).alias("shard"), F.col("seq").cast("bigint"), F.col("body").cast("string"))
    placed = rows.repartition("shard").sortWithinPartitions("shard", "seq")
    names, kinds = ["shard", "seq", "prev_digest", "record_hmac", "raw"], [pa.string(), pa.int64(), *[pa.string()] * 3]
    return placed.mapInArrow(lambda it: _streamed(it, step, 2, names, kinds), CHAINED)


def links(trail: DataFrame, block: int = 100_000, shard: str | None = None) -> DataFrame:
    """(seq, linked): whether a record names the signature of the one before it, or the origin if it is the first.

    Rows are compared within blocks of consecutive ``seq`` and across their edges; no window runs over the trail, but for one
    row a block. ``shard`` names a column with a chain of its own for each value, which then comes out too.
    """
    by = ["shard"] if shard else []
    t = trail.select(*([F.col(shard).alias("shard")] if shard else []), "seq", "prev_digest", "record_hmac", F.floor(F.col("seq") / F.lit(block)).alias("b"))
    own = t.withColumn("before", F.lag("record_hmac", 1).over(W.partitionBy(*by, "b").orderBy("seq"))).withColumn("top", F.row_number().over(W.partitionBy(*by, "b").orderBy("seq")) == 1)
    ends = t.groupBy(*by, "b").agg(F.max_by("record_hmac", "seq").alias("end"))
    prior = ends.withColumn("prior", F.coalesce(F.lag("end").over(W.partitionBy(*by).orderBy("b")), F.lit(GENESIS))).select(*by, "b", "prior")
    before = F.when(F.col("top"), F.col("prior")).otherwise(F.col("before"))
    return own.join(prior, [*by, "b"]).select(*by, "seq", F.col("prev_digest").eqNullSafe(before).alias("linked"))


def verify_chain(trail: DataFrame, key: bytes, shard: str | None = None) -> DataFrame:
    """(seq, intact) of a trail with ``seq``, ``raw``, ``prev_digest`` and ``record_hmac``: signed rightly, and linked to the record before.

    Signatures are checked over the raw line, by as many tasks as there are partitions; a changed row breaks only
    itself, a missing one the next. With ``shard`` each of its values is a chain of its own, and comes out too.
    """

    def check(batches):
        for b in batches:
            good = []
            for raw in b.column(b.num_columns - 1).to_pylist():
                try:
                    r = json.loads(raw)
                    good.append(isinstance(r, dict) and hmac.compare_digest(str(r.get("record_hmac")), sign(r, key)))
                except (ValueError, TypeError):
                    good.append(False)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(good, pa.bool_())], names=[*b.schema.names[:-1], "signed"])

    by = [F.col(shard).cast("string").alias("shard")] if shard else []
    keys = ["shard", "seq"] if shard else ["seq"]
    trail = trail.withColumn(shard, F.col(shard).cast("string")) if shard else trail
    signed = trail.select(*by, F.col("seq").cast("bigint"), "raw").mapInArrow(check, ("shard string, " if shard else "") + "seq bigint, signed boolean")
    return links(trail, shard=shard).join(signed, keys).select(*keys, (F.col("linked") & F.col("signed")).alias("intact"))


def chain_report(checked: DataFrame, shown: int = 20) -> dict:
    """verified, total and the first broken places (numbers from 0)."""
    n = checked.agg(F.count_if("intact").alias("v"), F.count("*").alias("n")).first()
    broken = [r.seq for r in checked.filter(~F.col("intact")).orderBy("seq").limit(shown).collect()]
    return {"verified": n.v, "total": n.n, "broken_at": broken}


def chain_share(trail: DataFrame, key: bytes, shown: int = 10) -> tuple[float | None, int, str]:
    """K-14: the share of records that verify, how many there are, and a note on the first that don't. An empty trail has no share."""
    r = chain_report(verify_chain(trail, key), shown)
    note = f"broken at {', '.join(map(str, r['broken_at']))}" if r["broken_at"] else ""
    return (r["verified"] / r["total"] if r["total"] else None), r["total"], note
