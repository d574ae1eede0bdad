"""Requirement profiles: the limits a trace's results are held against."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import Any


class ProfileError(ValueError):
    """The profile can't be read."""


@dataclass(frozen=True)
class Profile:
    """Limits by name; a tolerance of None is derived from the trace."""

    name: str = "standard"
    heating_rate: float = 1.0
    cooling_rate: float = 1.0
    sustained_ratio: float = 0.8
    ramp_deviation: float | None = None
    dwell_deviation: float | None = 2.0
    overshoot_c: float = 3.0
    settling_s: float = 300.0
    duration_sigmas: float = 2.0
    least_cycles: int = 1
    most_cycles: int | None = None
    conformance_pct: float = 95.0
    sequence: tuple[str, ...] = ("HEATING_RAMP", "HOT_DWELL", "COOLING_RAMP", "COLD_DWELL")


STANDARD = Profile()
#: Limits of 0 that let everything pass and tolerances that are all derived: for reports only.
REPORT_ONLY = Profile(
    "report_only", heating_rate=0.0, cooling_rate=0.0, sustained_ratio=0.0, dwell_deviation=None, overshoot_c=0.0, settling_s=0.0, least_cycles=0, most_cycles=999,
    sequence=("AMBIENT_START", "HEATING_RAMP", "HOT_DWELL", "COOLING_RAMP", "COLD_DWELL"),
)
#: Where a profile file says what, as (section, key, field).
_PLACES = (
    ("profile_metadata", "profile_name", "name"),
    ("expected_process_sequence", "expected_region_sequence", "sequence"),
    ("expected_process_sequence", "hot_cycle_count_max", "most_cycles"),
    ("ramp_rate_requirements", "required_heating_ramp_rate_c_per_min", "heating_rate"),
    ("ramp_rate_requirements", "required_cooling_ramp_rate_c_per_min", "cooling_rate"),
    ("ramp_rate_requirements", "minimum_sustained_ramp_rate_ratio", "sustained_ratio"),
    ("ramp_rate_requirements", "allowed_ramp_deviation_c", "ramp_deviation"),
    ("setpoint_deviation_requirements", "allowed_setpoint_deviation_c", "dwell_deviation"),
    ("dwell_requirements", "allowed_setpoint_deviation_c", "dwell_deviation"),
    ("overshoot_requirements", "overshoot_failure_threshold_c", "overshoot_c"),
    ("settling_requirements", "settling_time_limit_seconds", "settling_s"),
    ("cycle_rules", "minimum_complete_cycles_required", "least_cycles"),
)
_REQUIRED = (
    "profile_metadata", "expected_process_sequence", "ramp_rate_requirements", "dwell_requirements", "setpoint_deviation_requirements",
    "overshoot_requirements", "settling_requirements",
)
_NUMBERS = {f.name for f in fields(Profile)} - {"name", "sequence"}


def profile_of(content: dict[str, Any]) -> Profile:
    """A profile from the sections of a profile file; missing sections and values of another type are errors."""
    if not isinstance(content, dict):
        raise ProfileError("a profile is a mapping of sections")
    missing = [s for s in _REQUIRED if not isinstance(content.get(s), dict)]
    if missing:
        raise ProfileError(f"sections missing: {', '.join(missing)}")
    found: dict[str, Any] = {"ramp_deviation": None, "dwell_deviation": None}
    for section, key, name in _PLACES:
        value = content.get(section, {}).get(key)
        if value is None:
            continue
        if name == "sequence":
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ProfileError(f"{section}.{key} is no list of texts")
            value = tuple(value)
        elif name in _NUMBERS:
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ProfileError(f"{section}.{key} is no number")
        found[name] = value
    for name in ("heating_rate", "cooling_rate", "overshoot_c", "settling_s"):
        if name not in found:
            raise ProfileError(f"no value for {name}")
    return Profile(**found)


def load_profile(path: str) -> Profile:
    """A profile from a YAML file (where a YAML reader is installed) or a JSON file."""
    try:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    except OSError as error:
        raise ProfileError(f"{path}: {error}") from error
    try:
        if path.endswith(".json"):
            return profile_of(json.loads(text))
        import yaml

        return profile_of(yaml.safe_load(text))
    except ImportError as error:
        raise ProfileError(f"{path}: no YAML reader is installed, write the profile as JSON") from error
    except ProfileError:
        raise
    except Exception as error:
        raise ProfileError(f"{path}: {error}") from error
