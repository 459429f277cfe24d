"""Stencils, coverage, geodesics and cascades of many sources on one map, as arrays of (sources, cells).

They say the same as the column forms in ``grid`` and ``masks``. A source's cells stay one row, so no cell is shuffled;
missing values are NaN here and become NULL in the tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import EARTH_RADIUS_KM, VINCENTY_STEPS, WGS84_A, WGS84_F
from .masks import REASON_ORDER, REASONS


def wrap(a: np.ndarray) -> np.ndarray:
    """Angle in [-180, 180)."""
    return np.mod(a + 180, 360.0) - 180


class Axis:
    """One axis of a map: for each cell the places of those one and two on in its line, and of the row beside it whatever its index."""

    def __init__(self, along: np.ndarray, across: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((along, across))
        self.x, place = x, np.arange(len(order))
        self.at, self.beside = {}, {}
        for k in (-2, -1, 1, 2):
            to = np.clip(place + k, 0, len(order) - 1)
            same = (to == place + k) & (across[order[to]] == across[order])
            found = np.full(len(order), -1)
            found[order] = np.where(same, order[to], -1)
            self.beside[k] = found
            self.at[k] = np.where((found >= 0) & (along[found] == along + k), found, -1)
        self.low, self.high = self.beside[-1] < 0, self.beside[1] < 0

    def gradient(self, values: np.ndarray) -> np.ndarray:
        """Second-order derivatives of rows of values; one-sided at the ends, NaN beside a missing cell."""
        v, x = np.column_stack([values, np.full(len(values), np.nan)]), np.append(self.x, np.nan)
        out = np.empty_like(values)
        with np.errstate(all="ignore"):
            c = np.nonzero(~self.low & ~self.high)[0]
            one, back = self.at[1][c], self.at[-1][c]
            hl, hr = x[c] - x[back], x[one] - x[c]
            out[:, c] = (hl * hl * v[:, one] + (hr * hr - hl * hl) * v[:, c] - hr * hr * v[:, back]) / (hl * hr * (hl + hr))
            for c, k in ((np.nonzero(self.low)[0], 1), (np.nonzero(self.high & ~self.low)[0], -1)):
                one, two = self.at[k][c], self.at[2 * k][c]
                h1, h2 = x[one] - x[c], x[two] - x[one]
                out[:, c] = -(2 * h1 + h2) / (h1 * (h1 + h2)) * v[:, c] + (h1 + h2) / (h1 * h2) * v[:, one] - h1 / (h2 * (h1 + h2)) * v[:, two]
        return out


class Map:
    """The cells of one bounded map, in the order of ``i_lat`` and ``i_lon``."""

    def __init__(self, i_lat: np.ndarray, i_lon: np.ndarray, lat: np.ndarray, lon: np.ndarray, x_km: np.ndarray, y_km: np.ndarray) -> None:
        self.i_lat, self.i_lon, self.lat, self.lon = i_lat.astype(np.int32), i_lon.astype(np.int32), lat, lon
        self.n_lat, self.n_lon = int(i_lat.max()) + 1, int(i_lon.max()) + 1
        self.middle = (lon.min() + lon.max()) / 2, (lat.min() + lat.max()) / 2
        self.east, self.north = Axis(i_lon, i_lat, x_km), Axis(i_lat, i_lon, y_km)

    def __len__(self) -> int:
        return len(self.lat)

    def laplacian(self, values: np.ndarray) -> np.ndarray:
        return self.east.gradient(self.east.gradient(values)) + self.north.gradient(self.north.gradient(values))

    def adjacent(self, values: np.ndarray) -> np.ndarray:
        """Cells that have a value beside one that has none."""
        missing = np.isnan(values)
        if not missing.any():
            return missing
        padded = np.column_stack([missing, np.zeros(len(values), bool)])
        return ~missing & np.any([padded[:, a.beside[k]] for a in (self.east, self.north) for k in (-1, 1)], axis=0)

    def local(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.radians(wrap(lon - self.middle[0])) * math.cos(math.radians(self.middle[1])) * EARTH_RADIUS_KM, np.radians(lat - self.middle[1]) * EARTH_RADIUS_KM

    def covered(self, lon: np.ndarray, lat: np.ndarray, mode: str = "either", nearby_km: float = 150.0, quadrant_km: float = 250.0, min_quadrants: int = 3, held: int = 1 << 20) -> np.ndarray:
        """Cells with a receiver nearby and/or receivers of enough quadrants; so many distances are held at once."""
        (gx, gy), (rx, ry) = self.local(self.lon, self.lat), self.local(lon, lat)
        close, seen = np.zeros(len(self), bool), np.zeros((4, len(self)), bool)
        step = max(1, held // len(self))
        for i in range(0, len(rx), step):
            dx, dy = rx[i : i + step, None] - gx, ry[i : i + step, None] - gy
            d = np.hypot(dx, dy)
            close |= (d <= nearby_km).any(axis=0)
            if mode != "nearby":
                wide, right, up = d <= quadrant_km, dx >= 0, dy >= 0
                for q in range(4):
                    seen[q] |= (wide & (right == (q >= 2)) & (up == bool(q % 2))).any(axis=0)
        around = seen.sum(axis=0) >= min_quadrants
        return {"nearby": close, "quadrants": around, "either": close | around}[mode]

    def geodesics(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance in km, azimuth) from places to all cells; equal places are computed once."""
        own, back = np.unique(np.column_stack([lon, lat]), axis=0, return_inverse=True)
        d, a = geodesic(own[:, :1], own[:, 1:], self.lon, self.lat)
        return d[back.ravel()], a[back.ravel()]


def boundary(m: Map, n: int) -> np.ndarray:
    """Cells of the outer n rows or columns, as ``masks.boundary_cells``."""
    n = max(0, min(n, (min(m.n_lat, m.n_lon) + 1) // 2))
    return (m.i_lat < n) | (m.i_lat >= m.n_lat - n) | (m.i_lon < n) | (m.i_lon >= m.n_lon - n)


def geodesic(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance in km, azimuth) on WGS84, as ``scalars.geodesic``."""
    b, f = WGS84_A * (1 - WGS84_F), WGS84_F
    u1, u2, side = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2))), np.radians(lon2 - lon1)
    s1, c1, s2, c2, lam = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), side
    with np.errstate(all="ignore"):
        for step in range(VINCENTY_STEPS + 1):
            sl, cl = np.sin(lam), np.cos(lam)
            east, north, cs = c2 * sl, c1 * s2 - s1 * c2 * cl, s1 * s2 + c1 * c2 * cl
            ss = np.sqrt(east * east + north * north)
            sigma, sa = np.arctan2(ss, cs), np.where(ss == 0, 0.0, c1 * c2 * sl / ss)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 == 0, 0.0, cs - 2 * s1 * s2 / ca2)
            if step < VINCENTY_STEPS:
                cc = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
                lam = side + (1 - cc) * f * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))
    u, cm2 = ca2 * ((WGS84_A**2 - b**2) / b**2), cm * cm
    ba, bb = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    ds = bb * ss * (cm + bb / 4 * (cs * (2 * cm2 - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm2 - 3)))
    return b * ba * (sigma - ds), wrap(np.degrees(np.arctan2(east, north)))


@F.pandas_udf(DoubleType())
def distance_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Column of distances of ``geodesic``, for tables on their way to a kernel: a batch of pairs at a time, where the staged projections are one generated method too long to be compiled."""
    return pd.Series(geodesic(*(c.to_numpy(float, na_value=np.nan) for c in (lon1, lat1, lon2, lat2)))[0])


def first_reason(conditions: dict[str, np.ndarray], failed: np.ndarray) -> np.ndarray:
    """As ``masks.first_reason``."""
    names = [n for n in REASON_ORDER if n in conditions]
    return np.select([failed, *(conditions[n] for n in names)], [REASONS["interpolation"], *(REASONS[n] for n in names)], 0).astype(np.int8)


def helmholtz_reason(eikonal: np.ndarray, amplitude: np.ndarray, correction: np.ndarray, slowness: np.ndarray, reference_velocity: float, unstable: np.ndarray, computed: np.ndarray, adjacent: np.ndarray, min_amplitude: float) -> np.ndarray:
    """As ``masks.helmholtz_reason``."""
    with np.errstate(all="ignore"):
        bad = ~(np.isfinite(amplitude) & (amplitude > min_amplitude)) | adjacent
        curved = ~(np.isfinite(correction) & (np.abs(correction) <= 1 / reference_velocity**2))
        lost = ~(slowness * slowness - correction > 0)
    return np.select([~computed, eikonal != 0, bad, unstable, curved, lost], [1, 2, 4, 3, 5, 6], 0).astype(np.int8)
