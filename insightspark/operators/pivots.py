"""Regions of unit vectors around pivots, and the least angle at which a region can lie from a query.

A vector belongs to the cell of its nearest pivot and, within it, to a ring of
angles to that pivot.  Two bounds hold for the angle between a query and any
vector of a region: the triangle inequality over the pivot, and the distance to
the planes that divide the cell from the cells of the other pivots.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Cells of vectors without a direction (zero or NaN, so without a score), and of lengths too odd to bound.
NO_DIRECTION, ODD_LENGTH = -1, -2
_LENGTHS = (1e-100, 1e100)
# Above the rounding of angles (the arc cosine turns 1e-14 into 1e-7) and of scores.
_ANGLE_SLACK, _SCORE_SLACK = 1e-6, 1e-9
# Queries whose bounds are computed at once.
_ROWS = 256


class Regions(NamedTuple):
    """Unit pivots, and per region its number, cell, smallest and largest angle to the cell's pivot, and rows to look at first."""

    pivots: np.ndarray
    region: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, cell kind): kind 0 where there is a direction, else one of the two cells above."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        regular = (length > _LENGTHS[0]) & (length < _LENGTHS[1])
        unit = np.where(regular[:, None], vectors / length[:, None], 0.0)
    empty = (vectors == 0).all(axis=1) | np.isnan(vectors).any(axis=1)
    return unit, np.where(regular, 0, np.where(empty, NO_DIRECTION, ODD_LENGTH))


def placed(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, angle to its pivot) of every vector; the angle is 0 where there is no direction."""
    unit, kind = directions(vectors)
    cosines = unit @ pivots.T
    nearest = cosines.argmax(axis=1)
    angle = np.arccos(np.clip(cosines[np.arange(len(unit)), nearest], -1.0, 1.0))
    return np.where(kind == 0, nearest, kind), np.where(kind == 0, angle, 0.0)


def _least_angles(unit: np.ndarray, regions: Regions) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, angles to the pivot), queries by regions."""
    cosines = unit @ regions.pivots.T
    angles = np.arccos(np.clip(cosines, -1.0, 1.0))
    beyond = np.zeros_like(angles)
    for cell, pivot in enumerate(regions.pivots):
        apart = np.sqrt(((regions.pivots - pivot) ** 2).sum(axis=1))
        others = apart > 1e-6
        if others.any():
            sine = ((cosines[:, others] - cosines[:, [cell]]) / apart[others]).max(axis=1)
            beyond[:, cell] = np.arcsin(np.clip(sine, 0.0, 1.0))
    cell = np.maximum(regions.cell, 0)
    to_pivot = angles[:, cell]
    ring = np.maximum(regions.low - to_pivot, to_pivot - regions.high)
    bound = np.maximum(0.0, np.maximum(ring, beyond[:, cell]) - _ANGLE_SLACK)
    return np.where(regions.cell >= 0, bound, 0.0), np.where(regions.cell >= 0, to_pivot, np.pi)


def first_regions(vectors: np.ndarray, regions: Regions, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place of a region): per query, the fewest regions next to it with ``k`` rows to look at."""
    unit, _ = directions(vectors)
    rows = np.where(regions.cell >= 0, regions.rows, 0)
    found = []
    for start in range(0, len(unit), _ROWS):
        bound, to_pivot = _least_angles(unit[start : start + _ROWS], regions)
        order = np.lexsort(np.stack([to_pivot, bound]), axis=1)
        before = np.cumsum(rows[order], axis=1) - rows[order]
        query, place = np.nonzero((before < k) & (rows[order] > 0))
        found.append((query + start, order[query, place]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def wanted_regions(vectors: np.ndarray, bars: np.ndarray, regions: Regions) -> tuple[np.ndarray, np.ndarray]:
    """(query, place of a region): regions that can hold a score of a query's ``bar``; all of them where it is -inf."""
    unit, kind = directions(vectors)
    bars = np.where(kind == 0, bars, -np.inf)
    found = []
    for start in range(0, len(unit), _ROWS):
        bar = bars[start : start + _ROWS, None]
        best = np.cos(_least_angles(unit[start : start + _ROWS], regions)[0])
        scored = regions.cell != NO_DIRECTION
        query, place = np.nonzero(((best >= bar - _SCORE_SLACK) & scored) | (bar == -np.inf))
        found.append((query + start, place))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
