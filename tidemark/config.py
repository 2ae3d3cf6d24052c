"""Settings of the engine, read from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Thresholds and bounds; each may be set by an environment variable ``TIDEMARK_<NAME>``."""

    price_move_pct: float = 3.0
    price_move_window_minutes: int = 5
    volume_spike_ratio: float = 5.0
    alert_dedup_seconds: int = 300
    alerts_per_symbol_hour: int = 10
    high_latency_ms: int = 30_000
    tick_retention_minutes: int = 240
    bar_retention_days: int = 30
    status_retention_days: int = 30
    news_retention_days: int = 14
    raw_retention_days: int = 7
    quote_sample_ms: int = 0
    overlap_seconds: int = 180
    gap_fill_max_minutes: int = 1440
    alerts_enabled: bool = True
    interest_symbols: tuple[str, ...] = ()
    watchlist: tuple[str, ...] = ()


def from_environment(env: Mapping[str, str] | None = None) -> Settings:
    """Settings from the environment; a value of the wrong form is an error that names its variable."""
    env = os.environ if env is None else env
    given = {}
    for f in fields(Settings):
        name = f"TIDEMARK_{f.name.upper()}"
        text = env.get(name, "").strip()
        if text:
            try:
                given[f.name] = _read(str(f.type), text)
            except ValueError as e:
                raise ValueError(f"{name}: {e}") from None
    return Settings(**given)


def _read(kind: str, text: str) -> object:
    if kind == "bool":
        known = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        if text.lower() not in known:
            raise ValueError(f"{text!r} is neither true nor false")
        return known[text.lower()]
    if kind.startswith("tuple"):
        return tuple(dict.fromkeys(s.strip().upper() for s in text.split(",") if s.strip()))
    value = float(text) if kind == "float" else int(text)
    if value < 0:
        raise ValueError("must not be negative")
    return value
