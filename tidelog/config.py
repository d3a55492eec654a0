"""Thresholds, frozen: every operator takes its configuration as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The three radii in use, in metres, kilometres and nautical miles.
EARTH_M, EARTH_KM, EARTH_NM = 6_371_008.8, 6371.0088, 3440.065


@dataclass(frozen=True)
class StateConfig:
    """Thresholds of the causal state layer, in seconds, knots and degrees."""

    sog_cap: float = 102.2
    stop_enter_kn: float = 0.5
    slow_kn: float = 3.0
    moving_kn: float = 3.0
    moving_step_kn: float = 0.5
    conflict_sog_kn: float = 2.0
    conflict_step_kn: float = 0.2
    turn_deg: float = 25.0
    turn_min_kn: float = 1.5
    turn_max_gap_s: float = 180.0
    gap_s: float = 180.0
    jump_kn: float = 80.0
    jump_max_gap_s: float = 600.0
    stale_medium_s: float = 180.0
    stale_high_s: float = 600.0
    stationary_codes: tuple[int, ...] = (1, 5)


@dataclass(frozen=True)
class SessionConfig:
    gap_hours: float = 6.0
    hysteresis_hours: float = 6.0
    inbound: str = "signup"
    outbound: str = "purchase"


@dataclass(frozen=True)
class CrossingConfig:
    """A gate is a segment; a crossing needs neighbours at most max_gap_s apart on different sides of it."""

    lon_a: float
    lat_a: float
    lon_b: float
    lat_b: float
    inside_lon: float
    inside_lat: float
    max_gap_s: float = 300.0
    good_gap_s: float = 60.0
    fair_gap_s: float = 120.0


@dataclass(frozen=True)
class PriorConfig:
    """Levels from coarse to fine; a level counts from min_support rows and shrinks with weight n / (n + alpha)."""

    levels: tuple[str, ...] = ("destination", "destination_type")
    alpha: float = 10.0
    min_support: int = 3
    clip: tuple[float, float] = (0.01, 0.99)


@dataclass(frozen=True)
class CorridorConfig:
    cell_deg: float = 0.2
    max_gap_min: float = 15.0
    step_nm: tuple[float, float] = (0.01, 30.0)
    speed_kn: tuple[float, float] = (1.0, 30.0)
    min_support: int = 2
    min_path_kn: float = 2.0
    max_recent_kn: float = 25.0
    snap_nm: float = 40.0


@dataclass(frozen=True)
class IntervalConfig:
    coverage: float = 0.8
    terciles: tuple[float, float] = field(default=(1 / 3, 2 / 3))
