"""Settings of the evaluations."""

from __future__ import annotations

from dataclasses import dataclass

from ..sources.files import parse_value


@dataclass
class Configured:
    """Settings from text values: numbers, fractions, tuples and booleans."""

    @classmethod
    def from_text(cls, values: dict[str, str]):
        return cls(**{k: parse_value(v) for k, v in values.items()})


@dataclass
class ISOConfig(Configured):
    lat: tuple[float, float] = (-30, 30)
    window: int = 141
    low: float = 1 / 90
    high: float = 1 / 25
    lag: int = 5
    copies: int = 3
    modes: int = 2
    min_block: int = 90


@dataclass
class MJOConfig(Configured):
    lat: tuple[float, float] = (-15, 15)
    rolling: int = 120
    harmonics: int = 3
    modes: int = 2
    segment: int = 96
    overlap: int = 60
    frequency: tuple[float, float] = (1 / 80, 1 / 30)
    wavenumber: tuple[float, float] = (0, 4)
    max_lag: int = 30
    #: The variable whose loadings decide the modes' order and sign.
    deciding: str = "ua850"


@dataclass
class TCConfig(Configured):
    psl_delta: float = 200.0
    psl_dist: float = 5.5
    z_delta: float = -6.0
    z_dist: float = 6.5
    z_offset: float = 1.0
    merge_dist: float = 6.0
    reach: float = 8.0
    min_length: int = 10
    max_gap: int = 3
    min_wind: float = 10.0
    max_lat: float = 50.0
    #: Points of a track that have to reach the wind within the latitude.
    min_strong: int = 10
    bin: float = 2.5
    #: Degrees of a tile of a large grid (0: a time's grid is one), and its greatest step.
    tile: float = 0.0
    step: float = 2.5
