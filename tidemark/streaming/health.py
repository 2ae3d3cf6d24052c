"""Health of running streams, and alert rows for what goes wrong with them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql.streaming import StreamingQueryListener

#: A problem of one stream alerts once in that many seconds.
QUIET_SECONDS = 900.0


#: Codes of stream errors that are critical.
CRITICAL_CODES = (402, 406, 409)


def infrastructure_alert(kind: str, stream: str, **what: object) -> dict[str, object]:
    """Category, severity and reason of a stream's trouble.

    ``kind`` and what it needs: stream_error and entitlement_error (``code``, ``message``), stream_stale (``idle_seconds``),
    gap_fill_failure (``attempt``, ``exhausted``, ``error``), persist_failure (``batch_size``, ``error``), coverage_gap (``start``, ``end``).
    """
    known = {
        "stream_error": lambda: ("critical" if what["code"] in CRITICAL_CODES else "high", f"stream error code={what['code']} msg={what['message']}"),
        "stream_stale": lambda: ("high", f"{stream} stream received no messages for {what['idle_seconds']:.0f}s; watchdog forced a reconnect"),
        "gap_fill_failure": lambda: (
            "critical" if what["exhausted"] else "high",
            f"{stream} reconnect gap-fill failed (attempt {what['attempt']}{', retries exhausted — articles during the disconnect may be missing' if what['exhausted'] else ''}): {what['error']}",
        ),
        "persist_failure": lambda: ("critical", f"{stream} persister failed twice; {what['batch_size']} item(s) routed to recovery — some data may be lost: {what['error']}"),
        "coverage_gap": lambda: ("medium", f"{stream} stream disconnected with REST backfill disabled; data between {what['start']} and {what['end']} may be missing"),
    }
    known["entitlement_error"] = known["stream_error"]
    severity, reason = known[kind]()
    return {"stream": stream, "category": kind, "severity": severity, "reason": reason}


@dataclass
class StreamHealth(StreamingQueryListener):
    """Counts rows and batches by query, and collects alerts (stream errors and silence)."""

    stale_after: float = 120.0
    rows: dict[str, int] = field(default_factory=dict)
    last_batch: dict[str, datetime] = field(default_factory=dict)
    alerts: list[dict[str, object]] = field(default_factory=list)
    _last_alert: dict[tuple[str, str], float] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows
        self.last_batch[name] = datetime.now(UTC)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.raise_alert("stream_error", str(event.id), code="stopped", message=str(event.exception)[:500])

    def raise_alert(self, kind: str, stream: str, now: float | None = None, **what: object) -> bool:
        """:func:`infrastructure_alert`, unless the stream had one of that kind a short while ago."""
        made = infrastructure_alert(kind, stream, **what)
        return self.note(stream, kind, str(made["severity"]), str(made["reason"]), now)

    def note(self, stream: str, category: str, severity: str, reason: str, now: float | None = None) -> bool:
        """Add an alert unless the same one of the stream came less than ``QUIET_SECONDS`` ago."""
        at = datetime.now(UTC).timestamp() if now is None else now
        last = self._last_alert.get((stream, category))
        if last is not None and at - last < QUIET_SECONDS:
            return False
        self._last_alert[stream, category] = at
        self.alerts.append({"stream": stream, "category": category, "severity": severity, "reason": reason, "at": at})
        return True

    def check_stale(self, now: datetime) -> None:
        for name, seen in self.last_batch.items():
            if (now - seen).total_seconds() > self.stale_after:
                self.raise_alert("stream_stale", name, now.timestamp(), idle_seconds=(now - seen).total_seconds())
