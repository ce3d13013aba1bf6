"""Limits, weights and word lists of the checks. Fixed values that define the results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Thresholds and penalties.
    earth_radius_km: float = 6371.0
    max_distance_m: float = 200.0
    min_overlap_percent: float = 70.0
    max_speed_knots: float = 3.0
    max_gap_minutes: int = 60
    port_tolerance_km: float = 50.0
    min_pump_rate: float = 80.0
    max_pump_rate: float = 250.0
    sampling_minutes: int = 10
    name_threshold: float = 0.80
    embedding_threshold: float = 0.72
    registry_threshold: float = 75.0
    history_threshold: float = 85.0
    search_threshold: float = 0.70
    ocr_threshold: float = 0.85
    extraction_threshold: float = 0.5
    digital_min_confidence: float = 0.82
    digital_max_variance: float = 350.0
    handwritten_variance_floor: float = 400.0
    duplicate_window_days: int = 90
    max_reuse_count: int = 1
    anomaly_threshold: float = 0.55
    correction_keywords: tuple[str, ...] = ("whiteout", "correction", "amended", "revised", "corrected", "overwritten", "cancelled")
    name_prefixes: tuple[str, ...] = ("MT ", "MV ", "M/V ", "M/T ", "BT ")
    required_fields: tuple[str, ...] = ("vessel_name", "barge_name", "delivery_date", "start_time", "end_time", "port")
    score_weights: dict[str, float] = field(default_factory=lambda: {"ocr": 0.30, "fields": 0.25, "format": 0.20, "time": 0.15, "font": 0.10})
    confidence_weights: dict[str, float] = field(default_factory=lambda: {"ocr": 0.20, "extraction": 0.20, "vessel": 0.20, "barge": 0.15, "geo": 0.25})
    severities: dict[str, str] = field(
        default_factory=lambda: {
            "VESSEL_NOT_FOUND": "HIGH",
            "IMO_MISMATCH": "HIGH",
            "VESSEL_IDENTITY_UNRESOLVED": "HIGH",
            "BARGE_IDENTITY_CONFLICT": "HIGH",
            "EXCESSIVE_DISTANCE": "HIGH",
            "DUPLICATE_BDN": "HIGH",
            "BARGE_MISSING": "MEDIUM",
            "BARGE_NAME_MISMATCH": "MEDIUM",
            "BARGE_UNVERIFIED": "MEDIUM",
            "INVALID_TIMESTAMPS": "MEDIUM",
            "QUANTITY_INFEASIBLE": "MEDIUM",
            "SUSPICIOUS_CORRECTIONS": "MEDIUM",
            "MISSING_SEAL_NUMBERS": "LOW",
            "BARGE_AIS_MISSING": "INFO",
            "VESSEL_AIS_MISSING": "INFO",
            "AIS_UNAVAILABLE": "INFO",
            "NAME_FUZZY_MATCH": "INFO",
        }
    )


DEFAULT = Params()
