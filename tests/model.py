"""One-event-at-a-time models of the stateful rules, written without Spark, to compare the operators with."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction


def two_decimals(value: Fraction) -> float:
    cents = Decimal(value.numerator * 100) / Decimal(value.denominator)
    return float(cents.quantize(Decimal(1), rounding=ROUND_HALF_UP) / 100)


def truck_model(events, window=300_000_000, grace=30_000_000):
    """events: (seq, key, event_us, cents, target) in arrival order. Yields a tuple per event."""
    open_windows = defaultdict(dict)
    newest = {}
    for seq, key, us, cents, target in events:
        windows = open_windows[key]
        newest[key] = max(newest.get(key, us), us)
        previous = windows[max(windows)]["temps"][-1] if windows else None
        late = us < newest[key] - grace
        if late:
            start = max(windows)
        else:
            start = us // window * window
            w = windows.setdefault(start, {"temps": [], "target": None})
            w["temps"].append(cents)
            w["target"] = target
        temps = windows[start]["temps"]
        yield {
            "arrival_seq": seq,
            "late": late,
            "window_us": start,
            "sample_count": len(temps),
            "avg": two_decimals(Fraction(sum(temps), 100 * len(temps))),
            "low": min(temps) / 100,
            "high": max(temps) / 100,
            "target": windows[start]["target"],
            "previous": None if previous is None else previous / 100,
        }


def sustained_model(events, threshold=-1000, seconds=30):
    """events: (seq, key, event_us, cents). Yields (seq, started_us, duration) whenever the alert fires."""
    active = {}
    for seq, key, us, cents in events:
        if cents <= threshold:
            active.pop(key, None)
            continue
        started = active.setdefault(key, us)
        duration = max(0, (us - started) // 1_000_000)
        if duration >= seconds:
            yield seq, started, duration


def first_violation(t, p95, failures, ratio):
    """The kind that counts for a test, and how many limits it breaks."""
    broken = {
        "LATENCY_SPIKE": t["p95_latency_ms"] > p95,
        "ERROR_RATE_SPIKE": t["failure_rate"] > failures,
        "THROUGHPUT_DROP": t["actual_rate"] < t["target_rate"] * ratio,
    }
    return next((kind for kind, is_broken in broken.items() if is_broken), None), sum(broken.values())


def bottleneck_model(tests, p95=500.0, failures=0.05, ratio=0.7, needed=2):
    """Alerts of one node by the rule's wording: a test raises its kind if, looking back to the last clean test, it is
    exactly the needed-th of that kind; the next clean test resolves it. Gives (seq, kind, severity, resolved_at)."""
    kinds = [first_violation(t, p95, failures, ratio) for t in tests]
    alerts = []
    for i, (kind, breaches) in enumerate(kinds):
        since = max((j for j in range(i) if kinds[j][0] is None), default=-1)
        if kind is None or sum(k == kind for k, _ in kinds[since + 1 : i + 1]) != needed:
            continue
        cleared = next((t["completed_us"] for t, (k, _) in zip(tests[i:], kinds[i:], strict=True) if k is None), None)
        alerts.append((tests[i]["seq"], kind, "CRITICAL" if breaches > 1 else "HIGH", cleared))
    return alerts


def lifecycle_model(transitions):
    """transitions of one alert in order: (status, at). Returns (status, acknowledged, resolved)."""
    status, acknowledged, resolved = "TRIGGERED", None, None
    for new, at in transitions:
        if status == "RESOLVED":
            continue
        status = new
        if new == "ACKNOWLEDGED":
            acknowledged = at
        else:
            resolved = at
    return status, acknowledged, resolved


def bottleneck_lifecycle_model(steps, needed=2):
    """One node, test by test and act by act in order of time. steps: ("TEST", seq, at, kind or None, breaches) or
    (status, seq, at, kind). Gives (kind, seq, severity, status, triggered, acknowledged, resolved, by) of every alert."""
    violations, open_alerts, alerts = defaultdict(int), {}, []
    for what, seq, at, kind, *more in steps:
        if what == "TEST" and kind is None:
            violations.clear()
            for alert in open_alerts.values():
                alert.update(status="RESOLVED", resolved=at, by="RULE")
            open_alerts.clear()
        elif what == "TEST":
            violations[kind] += 1
            if violations[kind] >= needed and kind not in open_alerts:
                severity = "CRITICAL" if more[0] > 1 else "HIGH"
                open_alerts[kind] = {"kind": kind, "seq": seq, "severity": severity, "status": "TRIGGERED", "triggered": at}
                open_alerts[kind].update(acknowledged=None, resolved=None, by=None)
                alerts.append(open_alerts[kind])
        elif kind in open_alerts:
            if what == "ACKNOWLEDGED":
                open_alerts[kind].update(status=what, acknowledged=at)
            else:
                open_alerts.pop(kind).update(status=what, resolved=at, by="OPERATOR")
                del violations[kind]
    order = ("kind", "seq", "severity", "status", "triggered", "acknowledged", "resolved", "by")
    return [tuple(a[c] for c in order) for a in alerts]


def percentile_model(values, p):
    ordered = sorted(values)
    rank = Fraction((len(ordered) - 1) * p, 100)
    low = int(rank)
    high = min(low + (0 if rank == low else 1), len(ordered) - 1)
    lo, hi = (Fraction(str(v)) for v in (ordered[low], ordered[high]))
    value = lo + (hi - lo) * (rank - low)
    return float((Decimal(value.numerator * 1000) / Decimal(value.denominator)).quantize(Decimal(1), ROUND_HALF_UP) / 1000)
