"""Parameters of the processing steps: sections with defaults and checks, read from JSON with comments."""

from __future__ import annotations

import dataclasses
import datetime
import json
import re
from dataclasses import dataclass, field


def _positive(section, *names: str) -> None:
    for n in names:
        if getattr(section, n) is not None and not getattr(section, n) > 0:
            raise ValueError(f"{n} must be positive: {getattr(section, n)!r}")


def _share(section, *names: str) -> None:
    for n in names:
        if not 0 <= getattr(section, n) <= 1:
            raise ValueError(f"{n} must be between 0 and 1: {getattr(section, n)!r}")


def _one_of(section, name: str, values: tuple[str, ...]) -> None:
    if getattr(section, name) not in values:
        raise ValueError(f"{name} must be one of {', '.join(values)}: {getattr(section, name)!r}")


@dataclass
class General:
    """num_cores and num_patches are accepted and not used: Spark's settings say how work is split. Phases are unwrapped by least
    squares with weights that favour few jumps, whatever spatial_unwrapping_method names."""

    input_path: str = "inputs/"
    output_path: str = "outputs/"
    num_cores: int = 50
    num_patches: int = 1
    apply_temporal_unwrapping: bool = True
    spatial_unwrapping_method: str = "puma"
    logging_level: str = "INFO"
    logfile_path: str = "logfiles/"

    def __post_init__(self):
        _positive(self, "num_cores", "num_patches")
        self.spatial_unwrapping_method = self.spatial_unwrapping_method.lower()
        _one_of(self, "spatial_unwrapping_method", ("puma", "ilp"))
        self.logging_level = self.logging_level.upper()
        _one_of(self, "logging_level", ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG", "NOTSET"))


@dataclass
class PhaseLinking:
    """Paths are those of tables; an empty one is none."""

    use_phase_linking_results: bool = False
    inverted_path: str = "inverted/"
    num_siblings: int = 20
    mask_phase_linking_file: str | None = None
    use_ps: bool = False
    mask_ps_file: str = "maskPS.h5"

    def __post_init__(self):
        self.mask_phase_linking_file = self.mask_phase_linking_file or None
        _positive(self, "num_siblings")


@dataclass
class Preparation:
    """start_date and end_date are ISO dates, both inclusive; empty or null is open. filter_window_size is in pixels."""

    start_date: str | None = None
    end_date: str | None = None
    ifg_network_type: str = "sb"
    num_ifgs: int = 3
    max_tbase: int = 100
    filter_window_size: int = 9

    def __post_init__(self):
        self.start_date, self.end_date = self.start_date or None, self.end_date or None
        for d in (self.start_date, self.end_date):
            if d:
                datetime.date.fromisoformat(d)
        if self.start_date and self.end_date and self.start_date >= self.end_date:
            raise ValueError("start_date must be before end_date")
        _one_of(self, "ifg_network_type", ("sb", "star", "stb", "stb_year"))
        _positive(self, "num_ifgs", "max_tbase", "filter_window_size")


@dataclass
class ConsistencyCheck:
    """grid_size and max_arc_length are in the unit of the points' y and x; 0 means no grid, null no limit."""

    coherence_p1: float = 0.9
    grid_size: int = 200
    num_nearest_neighbours: int = 30
    max_arc_length: float | None = None
    velocity_bound: float = 0.1
    dem_error_bound: float = 100.0
    num_optimization_samples: int = 100
    point_median_coherence: float = 0.6
    arc_unwrapping_coherence: float = 0.6
    mask_p1_file: str | None = None
    min_num_arc: int = 3

    def __post_init__(self):
        self.mask_p1_file = self.mask_p1_file or None
        if self.grid_size < 0:
            raise ValueError("grid_size must not be negative")
        _positive(self, "num_nearest_neighbours", "max_arc_length", "velocity_bound", "dem_error_bound", "num_optimization_samples")
        _share(self, "coherence_p1", "point_median_coherence", "arc_unwrapping_coherence")


@dataclass
class Unwrapping:
    use_arcs_from_temporal_unwrapping: bool = False


@dataclass
class Filtering:
    """Linear interpolation gives points of first order their own residual as atmosphere; distance is the mean of near points, by
    inverse distance. cubic is not built and refused."""

    coherence_p2: float = 0.8
    apply_aps_filtering: bool = True
    interpolation_method: str = "kriging"
    grid_size: int = 1000
    max_temporal_autocorrelation: float = 0.3
    mask_p2_file: str | None = None
    use_moving_points: bool = True

    def __post_init__(self):
        self.mask_p2_file = self.mask_p2_file or None
        self.interpolation_method = self.interpolation_method.lower()
        _one_of(self, "interpolation_method", ("kriging", "linear", "distance"))
        _positive(self, "grid_size")
        _share(self, "coherence_p2", "max_temporal_autocorrelation")


@dataclass
class Densification:
    num_connections_to_p1: int = 5
    max_distance_to_p1: float = 2000
    velocity_bound: float = 0.15
    dem_error_bound: float = 100.0
    num_optimization_samples: int = 100
    arc_unwrapping_coherence: float = 0.5

    def __post_init__(self):
        _positive(self, "num_connections_to_p1", "max_distance_to_p1", "velocity_bound", "dem_error_bound", "num_optimization_samples")
        _share(self, "arc_unwrapping_coherence")


@dataclass
class Config:
    general: General = field(default_factory=General)
    phase_linking: PhaseLinking = field(default_factory=PhaseLinking)
    preparation: Preparation = field(default_factory=Preparation)
    consistency_check: ConsistencyCheck = field(default_factory=ConsistencyCheck)
    unwrapping: Unwrapping = field(default_factory=Unwrapping)
    filtering: Filtering = field(default_factory=Filtering)
    densification: Densification = field(default_factory=Densification)

    def as_json(self) -> str:
        """All parameters: a template of the defaults, if nothing was set."""
        return json.dumps(dataclasses.asdict(self), indent=2)


_COMMENT = re.compile(r"(\"(?:[^\"\\]|\\.)*\")|//[^\n]*|/\*.*?\*/", re.S)
_LAST_COMMA = re.compile(r"(\"(?:[^\"\\]|\\.)*\")|,(?=\s*[}\]])", re.S)


def parse(text: str) -> Config:
    """The configuration that a JSON text says, in which comments and commas before a closing bracket are allowed. Unknown
    sections and parameters, and values that a section refuses, raise ValueError."""
    for pattern in (_COMMENT, _LAST_COMMA):
        text = pattern.sub(lambda m: m[1] or "", text)
    said, sections = json.loads(text), {f.name: f.default_factory for f in dataclasses.fields(Config)}
    if unknown := set(said) - set(sections):
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    out = {}
    for name, values in said.items():
        known = {f.name for f in dataclasses.fields(sections[name])}
        if unknown := set(values) - known:
            raise ValueError(f"unknown parameters of {name}: {', '.join(sorted(unknown))}")
        out[name] = sections[name](**values)
    return Config(**out)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
