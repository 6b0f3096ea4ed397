"""Thresholds of all stages."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    rate_multiple: float = 2.0  # gate 7: a rate over so many benchmarks is an outlier
    large_employees: int = 50  # gate 8
    large_benchmark: float = 2.0  # gate 8
    size_floor: int = 5  # gate 6
    size_group: int = 10  # gate 6: fewer records have no bounds
    size_iqrs: float = 3.0  # gate 6
    rare_below: int = 3  # gate 5
    confirm_score: float = 0.4
    confirm_ratio: float = 0.80
    suggest_score: float = 0.4
    suggest_ratio: float = 1.5
    registrant_match: float = 80.0
    contractor_match: float = 85.0
    material_ratio: float = 0.50
    immaterial_ratio: float = 0.25
    contradiction_ratio: float = 1.5
    consistent_sites: int = 5
    most_failures: float = 0.10
    least_actionable: float = 0.25
    most_empty: float = 0.50
    salary: float = 74_580.0
    employee_cap: float = 50_000.0
    text_cap: int = 50_000
    text_least: int = 50
    pages_per_site: int = 3


DEFAULT = Config()
