"""Command line: validate-policy, policy-diff, schema, check, kpi-export, monitor, dashboard. Exit codes: 0 fine, 1 invalid, 2 blocked or critical."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from sondage.plans import policy as P

KEY = "SONDAGE_AUDIT_KEY"


def _spark():  # noqa: ANN202
    from sondage.session import local_session, ship

    return ship(local_session("sondage-cli"))


def _trail(a: argparse.Namespace):  # noqa: ANN202
    from sondage import schemas
    from sondage.sources.audit import from_records, load_audit, load_events

    spark = _spark()
    events = load_events(spark, a.events) if a.events else from_records(spark, [], schemas.EVENTS, "event_no")
    return load_audit(spark, a.audit), events


def _chain(audit) -> tuple[float | None, int, str] | None:  # noqa: ANN001
    """K-14 of a trail, if the key of its digests is set."""
    from sondage.operators.state import chain_share

    key = os.environ.get(KEY)
    return chain_share(audit, key.encode()) if key else None


def validate(a: argparse.Namespace) -> int:
    bad = 0
    for path in a.policies:
        try:
            found = P.errors(P.read(path))
        except P.PolicyError as e:
            found = e.errors
        for at, message in found:
            print(f"{path}: {at or '<root>'}: {message}")
        bad |= bool(found)
    return int(bad)


def diff(a: argparse.Namespace) -> int:
    found = P.compare(P.read(a.old), P.read(a.new))
    for f in found:
        print(json.dumps(f.__dict__))
    return 2 if any(f.severity == "critical" for f in found) else 0


def check(a: argparse.Namespace) -> int:
    from sondage.operators.decisions import audit_rows, external, screen

    cols = "audit_id string, prompt string, completion string, macro_policy boolean, context string"
    limits = P.limits(P.validated(P.read(a.policy))) if a.policy else P.limits({})
    decided = screen(_spark().createDataFrame([("cli", a.prompt, a.completion, a.macro_policy, a.context)], cols), limits)
    r = external(decided).first().asDict()
    print(json.dumps(r))
    if a.audit:  # one line more of a trail
        with open(a.audit, "a", encoding="utf-8") as f:
            f.write(json.dumps(audit_rows(decided, audit_key(), limits).first().asDict(recursive=True)) + "\n")
    return 2 if r["status"] == "BLOCKED" else 0


def export(a: argparse.Namespace) -> int:
    from sondage.plans.snapshot import build
    from sondage.sources.audit import parse_time

    audit, events = _trail(a)
    now = parse_time(a.now) if a.now else datetime.now(timezone.utc)
    policy = P.validated(P.read(a.policy)) if a.policy else None
    doc = build(audit, events, now, delay_days=a.delay_days, k=a.k, policy=policy, chain=_chain(audit), consent=True if a.consent else None, demonstration=a.demonstration)
    with open(a.out, "w", encoding="utf-8") if a.out else sys.stdout as f:
        json.dump(doc, f, default=str, ensure_ascii=False, indent=1)
        f.write("\n")
    return 0


def monitor(a: argparse.Namespace) -> int:
    """Alerts are written where they are found if ``out`` is a folder's name without ``.jsonl``, else streamed to one file."""
    from sondage.plans import monitors
    from sondage.sources.audit import parse_time

    audit, events = _trail(a)
    chain = _chain(audit)
    broken = 0 if chain is None or chain[0] is None else round(chain[1] * (1 - chain[0]))
    agents = monitors.AGENTS | {"CA-6": lambda o: monitors.integrity(o, broken)}
    alerts = monitors.assess(monitors.observe(audit, events, parse_time(a.now) if a.now else None), agents)
    critical = False
    if a.out and not a.out.endswith(".jsonl"):
        alerts.write.mode("overwrite").json(a.out)
        return 2 if not alerts.filter("severity = 'critical'").isEmpty() else 0
    with open(a.out, "w", encoding="utf-8") if a.out else sys.stdout as f:
        for r in alerts.toLocalIterator():
            critical |= r.severity == "critical"
            f.write(json.dumps(r.asDict(), default=str) + "\n")
    return 2 if critical else 0


def dashboard(a: argparse.Namespace) -> int:
    from sondage.plans.snapshot import dashboard as page

    with open(a.snapshot, encoding="utf-8") as f:
        doc = json.load(f)
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(page(doc))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sondage")
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *args: tuple) -> None:  # noqa: ANN001
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flags, options in args:
            c.add_argument(*flags, **options)

    out, needed = (["--out"], {}), {"required": True}
    trail = [(["--audit"], needed), (["--events"], {}), out, (["--now"], {})]
    command("validate-policy", validate, (["policies"], {"nargs": "+"}))
    command("policy-diff", diff, (["old"], {}), (["new"], {}))
    command("schema", lambda _: print(json.dumps(P.schema(), indent=1)) or 0)
    command("check", check, (["completion"], {}), (["--prompt"], {"default": ""}), (["--context"], {}), (["--policy"], {}), (["--audit"], {}), (["--macro-policy"], {"action": "store_true"}))
    command("kpi-export", export, *trail, (["--policy"], {}), (["--delay-days"], {"type": int, "default": 7}), (["--k"], {"type": int, "default": 20}), (["--consent"], {"action": "store_true"}), (["--demonstration"], {"action": "store_true"}))
    command("monitor", monitor, *trail)
    command("dashboard", dashboard, (["--snapshot"], needed), (["--out"], needed))
    a = p.parse_args(argv)
    try:
        return a.run(a)
    except (P.PolicyError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


def audit_key() -> bytes:
    """The key of the audit trail from SONDAGE_AUDIT_KEY, else a random one with a warning."""
    if key := os.environ.get(KEY):
        return key.encode()
    print(f"no {KEY}: digests can't be checked later", file=sys.stderr)
    return os.urandom(32)


if __name__ == "__main__":
    sys.exit(main())
