"""Tunable constants of the domain, as frozen dataclasses.

Every value here is a fixed value: results only match when these numbers match.
"""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Band:
    """Allowed deviation below (``neg``) and above (``pos``) the design value."""

    neg: float
    pos: float


@dataclass(frozen=True)
class Tolerances:
    bench_height: Band = Band(1.0, 1.5)
    face_angle: Band = Band(5.0, 5.0)
    berm_min: float = 6.0
    inter_ramp_angle: Band = Band(3.0, 2.0)
    overall_angle: Band = Band(2.0, 2.0)
    crest_toe: Band = Band(1.0, 1.0)


@dataclass(frozen=True)
class Scoring:
    """Weights of one MATCH row and the section pass mark."""

    berm: int = 60
    angle: int = 10
    height: int = 30
    pass_mark: float = 70.0


@dataclass(frozen=True)
class Detection:
    face_threshold: float = 40.0
    berm_threshold: float = 20.0
    max_berm_width: float = 50.0
    min_bench_height: float = 2.0
    simplify_epsilon: float = 0.05
    profile_resolution: float = 0.1
    spill_angle_solid: float = 52.0
    spill_angle_pile: float = 48.0
    face_threshold_margin: float = 10.0
    curvature_threshold: float = 15.0
    extrema_window: int = 3
    smoothing_min_window: int = 5
    smoothing_max_window: int = 11
    consensus_quorum: int = 3
    confidence_density_floor: int = 10
    max_single_bench_width: float = 25.0
    sub_bench_min_prominence: float = 1.0
    ramp_narrow_min_width: float = 6.0
    ramp_max_slope_deg: float = 15.0
    ramp_min_descent_m: float = 0.5
    match_threshold: float = 8.0


@dataclass(frozen=True)
class Ramp:
    min_width: float = 15.0
    max_width: float = 42.0


@dataclass(frozen=True)
class Blast:
    rock_density_tm3: float = 2.7
    height_fallback_m: float = 15.0
    default_bench_height: float = 15.0
    correlation_radius_m: float = 15.0
    subdrill_optimal: tuple[float, float] = (0.5, 1.5)
    temporal_buffer_days: int = 7
    conservation_tolerance_pct: float = 2.0
    anfo_energy: float = 3.72
    kuznetsov_rock_factor: float = 11.0
    distance_floor_m2: float = 1e-4


@dataclass(frozen=True)
class Advisor:
    target_overbreak_m: float = 0.5
    pf_optimal: float = 0.35
    max_change_pct: float = 30.0
    min_samples: int = 5
    pf_upper_factor: float = 1.5
    pf_min_operational: float = 0.10
    pf_max_operational: float = 1.50


@dataclass(frozen=True)
class Stability:
    overhang_warning_m: float = 0.5
    overhang_critical_m: float = 1.5
    berm_design_min_m: float = 6.0
    unit_weight_kn_m3: float = 27.0
    typical_friction_deg: float = 35.0


@dataclass(frozen=True)
class SectorDeviation:
    tolerance_m: float = 0.3
    grid_resolution_m: float = 0.1
    angle_floor_deg: float = 5.0
    angle_ceiling_deg: float = 89.0
    angle_unreachable_deg: float = 30.0
    angle_tolerance_deg: float = 0.01
    cohesion_scale: float = 0.001


@dataclass(frozen=True)
class DrillCompliance:
    delta_x: float = 0.5
    delta_y: float = 0.5
    delta_z_collar: float = 0.3
    delta_incl: float = 3.0
    delta_az: float = 5.0
    delta_len: float = 0.5
    delta_kg_pct: float = 10.0
    nearest_radius_m: float = 5.0


@dataclass(frozen=True)
class DrillHardness:
    radius_m: float = 2.0
    duration_soft: float = 16.0
    duration_medium: float = 24.0
    duration_hard: float = 40.0
    duration_saturation: float = 60.0
    rate_soft: float = 1.0
    rate_medium: float = 0.7
    rate_hard: float = 0.4
    rate_saturation: float = 2.0


@dataclass(frozen=True)
class Backbreak:
    empirical_k: float = 0.3
    hp_constant: float = 0.6
    pf_optimal: float = 0.35
    ci_band: float = 0.15
    clamp_low_b: float = 0.5
    clamp_high_b: float = 4.0
    bench_height_m: float = 15.0
    burden_m: float = 6.0
    spacing_m: float = 7.0
    stemming_m: float = 6.0
    rock_factor_min: float = 0.7
    rock_factor_max: float = 1.3


@dataclass(frozen=True)
class Settings:
    tolerances: Tolerances = field(default_factory=Tolerances)
    scoring: Scoring = field(default_factory=Scoring)
    detection: Detection = field(default_factory=Detection)


TOLERANCES = Tolerances()
SCORING = Scoring()
DETECTION = Detection()
RAMP = Ramp()
BLAST = Blast()
ADVISOR = Advisor()
STABILITY = Stability()
SECTOR_DEVIATION = SectorDeviation()
DRILL_COMPLIANCE = DrillCompliance()
DRILL_HARDNESS = DrillHardness()
BACKBREAK = Backbreak()

# Status words are data and appear verbatim in every table.
CUMPLE = "CUMPLE"
FUERA = "FUERA DE TOLERANCIA"
NO_CUMPLE = "NO CUMPLE"
NO_CONSTRUIDO = "NO CONSTRUIDO"
FALTA_BANCO = "FALTA BANCO"
EXTRA = "EXTRA"
MISSING = "MISSING"
BANCO_ADICIONAL = "BANCO ADICIONAL"
RAMPA_OK = "RAMPA OK"
PASSING = (CUMPLE, RAMPA_OK)
