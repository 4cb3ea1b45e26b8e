"""Defaults of the plate pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Preprocess:
    blur_size: int = 3
    blur_sigma: float = 1.0
    grid: tuple[int, int] = (8, 8)
    clip: float = 2.0
    otsu_invert: bool = True


@dataclass(frozen=True)
class Detection:
    edge_ratio: float = 0.20
    closing: tuple[int, int] = (3, 25)
    aspect: tuple[float, float] = (1.5, 6.5)
    area: tuple[float, float] = (0.005, 0.30)
    fill: float = 0.30
    min_height: int = 15
    min_width: int = 40
    density: float = 0.10
    most: int = 5


@dataclass(frozen=True)
class Normalization:
    target: tuple[int, int] = (80, 240)
    margin: float = 0.10
    fill: int = 255
    edge_ratio: float = 0.25
    angle_limit: float = 15.0
    angle_step: float = 0.5


@dataclass(frozen=True)
class Segmentation:
    size: tuple[int, int] = (32, 32)
    padding: float = 0.18
    window_ratio: float = 0.26
    window_min: int = 15
    offset: float = 15.0
    slot_ratio: float = 0.40
    vertical_pad: float = 0.08
    fragment_area: float = 0.025
    fragment_overlap: float = 0.18
    enough_anchors: int = 7
    dense_row: float = 0.60
    dense_column: float = 0.50
    height: tuple[float, float] = (0.32, 0.95)
    width: tuple[float, float] = (0.015, 0.28)
    area: tuple[float, float] = (0.001, 0.18)
    fill: tuple[float, float] = (0.08, 1.0)
    border: float = 0.015
    reject_border: bool = True
    line_gap: float = 0.22
    fallback_height: float = 0.20
