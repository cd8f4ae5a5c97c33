"""Thresholds of every operator, with their production defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # admission
    max_payload_bytes: int = 65_536
    max_future_ms: int = 60_000
    min_device_time: int = 946_684_800  # 2000-01-01, epoch seconds
    max_stale_ms: int = 300_000
    max_depth: int = 12
    # observation gaps
    freshness_s: int = 60
    # parts counter
    gap_recovery_s: int = 300
    max_delta: int = 20
    max_delta_gap: int = 5_000
    reset_at_most: int = 2
    stale_rise: int = 5
    # energy meter
    max_kw: int = 2_000
    min_window_s: int = 300
    # clock
    zone_offset_s: int = 19_800  # UTC+05:30, no daylight saving
    # ingress lag
    late_ms: int = 10_000
    steps_ms: tuple[int, ...] = (60_000, 120_000, 240_000)
    forget_ms: int = 600_000
    remind_ms: int = 900_000
    lag_window_s: int = 60
    # look-back and retention
    lookback_s: int = 7 * 86_400
    live_ttl_s: int = 300
    late_retention_s: int = 30 * 86_400
    sample_window_s: int = 900
    sample_retention_s: int = 7 * 86_400
    range_window_s: int = 600
    identity_every_s: int = 3_600
    dedup_ttl_s: int = 300
    keep_copies_s: int = 86_400
    # size limits
    max_battery_codes: int = 65
    max_entries: int = 16
    max_line_bytes: int = 1_048_576
    # rows of one window group never exceed this many consecutive arrivals
    chunk_seqs: int = 1 << 24

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULTS = Params()
