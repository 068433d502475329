"""Cells of the H3 grid: points to cells, cells to centres, and cells whose centre lies in a polygon.

Only the icosahedron's faces, the azimuths of their first axes and the homes of the 122 base cells are given; the lookup
from a face's lattice to base cells, the rotations between faces and the treatment of pentagons follow from geometry.
Positions on a face are complex numbers in units of the resolution-0 lattice, whose axes i, j and k point to 0, 120 and 240
degrees; a lattice point is a pair (a, b) = (i - k, j - k). All functions work on whole numpy arrays.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latitude and longitude of the centres of the icosahedron's faces, and the azimuth of each face's i axis, in radians.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882), (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055), (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400), (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874), (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154), (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562), (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361), (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535), (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316), (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436), (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# The home of each base cell, in order of its number: face and i, j, k on that face. 2,0,0 are pentagons.
HOMES = """
1:100 2:110 1:000 2:100 0:200 1:110 1:001 2:000 0:100 2:010 1:010 1:011 3:100 3:110 11:200 4:100 0:000 6:010 0:001 2:011 7:001 2:001 0:110 6:001 10:200
6:000 3:000 11:100 4:110 3:010 0:011 4:000 5:010 0:010 7:010 11:110 7:000 10:100 12:200 6:101 7:101 4:001 3:001 3:011 4:010 6:100 11:000 8:001 5:001 14:200
5:000 12:100 10:110 4:011 12:110 7:100 11:010 10:000 13:200 10:001 11:001 9:010 8:010 6:200 8:000 9:001 14:100 5:101 16:011 8:101 5:100 12:000 7:200 12:010 10:010
9:000 13:100 16:001 15:011 15:010 16:010 14:110 13:110 5:200 8:100 14:000 9:101 14:001 17:001 12:001 16:000 17:011 15:001 16:101 9:100 15:000 13:000 8:200 13:010 17:101
19:010 14:010 19:011 17:010 13:001 17:000 16:100 9:200 15:101 15:100 18:011 18:001 19:001 17:100 19:000 18:010 18:101 19:200 19:100 18:000 19:101 18:100
"""
#: Radius of the resolution-0 unit on the tangent plane, and the angle between lattices of odd and even resolutions.
UNIT = 2 - (1 + math.sqrt(5)) / 2
TURN = math.asin(math.sqrt(3 / 28))
SIXTH = np.exp(1j * math.pi / 3)
#: Digits in order of their direction, from 0 degrees in steps of 60: i, ij, j, jk, k, ik.
ROUND = (4, 6, 2, 3, 1, 5)
K, PENTAGON_HOME = 1, (2, 0, 0)
RESOLUTIONS = range(16)


def _xyz(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=-1)


def _lattice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The complex position of lattice points."""
    return a - 0.5 * b + 1j * (math.sqrt(3) / 2) * b


def _ijk(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = np.minimum(np.minimum(a, b), 0)
    return a - low, b - low, -low


class _Grid:
    """What follows from the fixed values."""

    def __init__(self):
        lat, lng, az = np.array(FACES).T
        self.centre = _xyz(lat, lng)
        north = np.stack([-np.sin(lat) * np.cos(lng), -np.sin(lat) * np.sin(lng), np.cos(lat)], axis=-1)
        east = np.stack([-np.sin(lng), np.cos(lng), np.zeros(20)], axis=-1)
        self.x = north * np.cos(az)[:, None] + east * np.sin(az)[:, None]  # angles on a face grow as azimuths fall
        self.y = north * np.sin(az)[:, None] - east * np.cos(az)[:, None]
        corner = np.array([2, 2 * SIXTH**2, 2 * SIXTH**4])
        at = np.array([self.point(np.full(3, f), corner) for f in range(20)])
        # sides: k is opposite corner k; the neighbour's position is alpha * z + beta
        self.beyond, self.alpha, self.beta = np.zeros((20, 3), int), np.zeros((20, 3), complex), np.zeros((20, 3), complex)
        for f in range(20):
            for side in range(3):
                p, q = (side + 1) % 3, (side + 2) % 3
                same = lambda v, g: np.flatnonzero(np.abs(at[g] - v).max(axis=1) < 1e-9)
                g = next(g for g in range(20) if g != f and len(same(at[f, p], g)) and len(same(at[f, q], g)))
                zp, zq = corner[same(at[f, p], g)[0]], corner[same(at[f, q], g)[0]]
                turn = (zq - zp) / (corner[q] - corner[p])
                self.beyond[f, side], self.alpha[f, side] = g, turn
                self.beta[f, side] = zp - turn * corner[p]
        homes = [h.split(":") for h in HOMES.split()]
        self.home_face = np.array([int(f) for f, _ in homes])
        self.home_ijk = [tuple(map(int, c)) for _, c in homes]
        a, b = (np.array([c[n] - c[2] for c in self.home_ijk]) for n in (0, 1))
        self.home = _lattice(a, b)
        self.home_ab = np.stack([a, b], axis=1)
        self.pentagon = np.array([c == PENTAGON_HOME for c in self.home_ijk])
        places = self.point(self.home_face, self.home)
        self.latitude = np.arcsin(places[:, 2])
        # base cell, turns to its home and whether a pentagon's missing part is left clockwise, for each face and i, j, k
        self.base = np.full((20, 3, 3, 3), -1)
        self.turns, self.clockwise = np.zeros((20, 3, 3, 3), int), np.zeros((20, 3, 3, 3), bool)
        #: For each pentagon the faces around it, clockwise from its home, and the direction of each from its corner.
        self.fan = {n: self._fan(n) for n in np.flatnonzero(self.pentagon).tolist()}
        for f in range(20):
            for i, j, k in np.ndindex(3, 3, 3):
                if min(i, j, k) == 0:
                    face, z, turn = self._in_face(f, _lattice(np.float64(i - k), np.float64(j - k)))
                    place = self.point(np.array([face]), np.array([z]))[0]
                    n = int(np.argmin(np.abs(places - place).max(axis=1)))
                    if np.abs(places[n] - place).max() > 1e-9:
                        continue  # no base cell lies there
                    self.base[f, i, j, k] = n
                    if self.pentagon[n]:
                        if face != f:
                            self.base[f, i, j, k] = -1  # beyond a corner the plane is not whole
                            continue
                        step = next(m for m, (g, _) in enumerate(self.fan[n]) if g == f)
                        inward = {0: 3, 1: 5, 2: 6}[(i, j, k).index(2)]
                        cycle = (5, 4, 6, 2, 3)  # digits as a pentagon turns, k left out
                        self.turns[f, i, j, k] = (cycle.index((3, 2, 6, 4, 5)[step]) - cycle.index(inward)) % 5
                        self.clockwise[f, i, j, k] = inward == 5
                    else:
                        home = int(self.home_face[n])
                        if face != home:
                            turn = turn * next(self.alpha[face, s] for s in range(3) if self.beyond[face, s] == home)
                        self.turns[f, i, j, k] = round(np.angle(turn) / (math.pi / 3)) % 6

    def point(self, face: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Points of the sphere for positions on faces."""
        w = (np.asarray(z) * UNIT)[..., None]
        v = self.centre[face] + w.real * self.x[face] + w.imag * self.y[face]
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    def _in_face(self, f: int, z: complex) -> tuple[int, complex, complex]:
        """Face, position there and turn, for a position that may lie beyond a side."""
        out = [-(z * np.conj(SIXTH ** (2 * s))).real - 1 for s in range(3)]  # side s lies at distance 1 from the centre
        s = int(np.argmax(out))
        if out[s] < 1e-9:
            return f, z, 1 + 0j
        return int(self.beyond[f, s]), self.alpha[f, s] * z + self.beta[f, s], self.alpha[f, s]

    def _fan(self, n: int) -> list[tuple[int, float]]:
        """(face, angle from the corner to the face's centre) of the five faces of a pentagon, clockwise from its home."""
        f, corner, out = int(self.home_face[n]), 0, []
        place = self.point(np.array([f]), np.array([2 + 0j]))[0]
        for _ in range(5):
            z = 2 * SIXTH ** (2 * corner)
            out.append((f, float(np.angle(-z))))
            # seen from corner c the side clockwise of the face's middle leads to corner c + 2, and is opposite c + 1
            side = next(s for s in range(3) if s != corner and np.angle((2 * SIXTH ** (2 * (3 - s - corner)) - z) / -z) < 0)
            g = int(self.beyond[f, side])
            corner = next(c for c in range(3) if np.abs(self.point(np.array([g]), np.array([2 * SIXTH ** (2 * c)]))[0] - place).max() < 1e-9)
            f = g
        return out


@functools.cache
def grid() -> _Grid:
    return _Grid()


_DIGIT = np.full((3, 3), 7)
for _n, _d in enumerate((0, *ROUND)):
    _DIGIT[((0, 0), (1, 0), (1, 1), (0, 1), (-1, 0), (-1, -1), (0, -1))[_n]] = _d
#: TURNED[n, digit]: a digit after n turns of 60 degrees, counter-clockwise.
TURNED = np.array([[0] + [ROUND[(ROUND.index(d) + n) % 6] for d in range(1, 7)] + [7] for n in range(6)])
STEP = {0: (0, 0), 4: (1, 0), 6: (1, 1), 2: (0, 1), 3: (-1, 0), 1: (-1, -1), 5: (0, -1)}
_STEPS = np.array([STEP.get(d, (0, 0)) for d in range(8)])


def _leading(digits: np.ndarray) -> np.ndarray:
    """The first digit of each row that is not 0, or 0."""
    some = digits != 0
    return np.where(some.any(axis=1), digits[np.arange(len(digits)), some.argmax(axis=1)] if digits.shape[1] else 0, 0)


def _pack(base: np.ndarray, digits: np.ndarray) -> np.ndarray:
    res = digits.shape[1]
    out = (np.int64(1) << 59) | (np.int64(res) << 52) | (base.astype(np.int64) << 45)
    for r in range(15):
        out = out | ((digits[:, r].astype(np.int64) if r < res else np.int64(7)) << (3 * (14 - r)))
    return out


def resolution(cells: np.ndarray) -> np.ndarray:
    return (cells >> 52) & 15


def unpack(cells: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Base cells and digits (rows of res)."""
    digits = np.stack([(cells >> (3 * (14 - r))) & 7 for r in range(res)], axis=1) if res else np.zeros((len(cells), 0), np.int64)
    return (cells >> 45) & 127, digits


def _down(a: np.ndarray, b: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """A lattice point of resolution res - 1 on the lattice of res."""
    return (2 * a + b, 3 * b - a) if res % 2 else (3 * a - b, a + 2 * b)


def _up(a: np.ndarray, b: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest lattice point of resolution res - 1, in whole numbers: a seventh has no ties."""
    seventh = lambda n: (2 * n + 7) // 14
    return (seventh(3 * a - b), seventh(a + 2 * b)) if res % 2 else (seventh(2 * a + b), seventh(3 * b - a))


def project(lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest face of points in degrees, and their position on it."""
    g, p = grid(), _xyz(np.radians(lat), np.radians(lng))
    dots = p @ g.centre.T
    face = dots.argmax(axis=1)
    w = p / dots[np.arange(len(p)), face][:, None]
    return face, ((w * g.x[face]).sum(axis=1) + 1j * (w * g.y[face]).sum(axis=1)) / UNIT


def _cells_on(face: np.ndarray, z: np.ndarray, res: int) -> np.ndarray:
    g = grid()
    z = z * 7 ** (res / 2) * (np.exp(-1j * TURN) if res % 2 else 1)
    y = z.imag * (2 / math.sqrt(3))
    x = z.real + y / 2
    cube = np.stack([x - y, y, -x])  # sums to 0; the nearest lattice point is the rounded one, its worst part set by the others
    whole = np.rint(cube)
    off = np.abs(whole - cube)
    worst = off.argmax(axis=0)
    q, r, s = whole
    r = np.where(worst == 1, -q - s, r).astype(np.int64)
    s = np.where(worst == 2, -whole[0] - whole[1], s).astype(np.int64)
    a, b = -s, r
    digits = np.zeros((len(face), res), np.int64)
    for level in range(res, 0, -1):
        ua, ub = _up(a, b, level)
        da, db = _down(ua, ub, level)
        digits[:, level - 1] = _DIGIT[a - da, b - db]
        a, b = ua, ub
    at = (face, *_ijk(a, b))
    base, turns = g.base[at], g.turns[at]
    five = g.pentagon[base]
    if five.any():
        own, n, left = digits[five], turns[five], g.clockwise[at][five]
        missing = _leading(own) == K
        own = np.where(missing[:, None], np.where(left[:, None], TURNED[5][own], TURNED[1][own]), own)
        for k in range(1, 5):
            more = n >= k
            turned = TURNED[1][own]
            turned = np.where((_leading(turned) == K)[:, None], TURNED[1][turned], turned)
            own = np.where(more[:, None], turned, own)
        digits[five] = own
        turns = np.where(five, 0, turns)
    return _pack(base, TURNED[turns[:, None], digits])


def latlng_to_cells(lat: np.ndarray, lng: np.ndarray, resolutions: tuple[int, ...]) -> list[np.ndarray]:
    """Cells of points in degrees, one array of 64-bit integers for each resolution. Points must be finite."""
    face, z = project(np.asarray(lat, np.float64), np.asarray(lng, np.float64))
    return [_cells_on(face, z, r) for r in resolutions]


def cells_to_latlng(cells: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Latitudes and longitudes in degrees of the centres of cells of one resolution."""
    g = grid()
    base, digits = unpack(np.asarray(cells, np.int64), res)
    a, b = np.zeros(len(base), np.int64), np.zeros(len(base), np.int64)
    for level in range(1, res + 1):
        a, b = _down(a, b, level)
        a, b = a + _STEPS[digits[:, level - 1], 0], b + _STEPS[digits[:, level - 1], 1]
    off = _lattice(a, b) * 7 ** (-res / 2) * (np.exp(1j * TURN) if res % 2 else 1)
    face, z = g.home_face[base].copy(), g.home[base] + off
    five = g.pentagon[base]
    for n in np.unique(base[five]).tolist():
        rows = np.flatnonzero(base == n)
        lead = _leading(digits[rows])
        some = lead != 0
        rows, lead = rows[some], lead[some]
        w = off[rows]
        middle = np.array([0, 240, 120, 180, 0, 300, 60, 0])[lead]
        angle = middle + np.degrees(np.angle(w * np.exp(-1j * np.radians(middle))))
        t = np.where(lead == 5, 540 - angle, 180 - angle) % 300  # degrees clockwise from the home's middle, of 300 around
        m = np.floor((t + 30) / 60).astype(int) % 5
        t = np.where((m == 0) & (t > 150), t - 300, t)
        fan_face, fan_angle = (np.array(c) for c in zip(*g.fan[n], strict=True))
        at = np.abs(w) * np.exp(1j * (fan_angle[m] - np.radians(t - 60 * m)))
        face[rows], z[rows] = fan_face[m], at - 2 * np.exp(1j * fan_angle[m])
    for _ in range(2):
        out = np.stack([-(z * np.conj(SIXTH ** (2 * s))).real - 1 for s in range(3)])
        s = out.argmax(axis=0)
        over = (out.max(axis=0) > 1e-9) & ~five
        z = np.where(over, g.alpha[face, s] * z + g.beta[face, s], z)
        face = np.where(over, g.beyond[face, s], face)
    p = g.point(face, z)
    return np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1))), np.degrees(np.arctan2(p[:, 1], p[:, 0]))


def children(cells: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of resolution res + 1 whose parents are given, and the place of each one's parent; a pentagon has no child in its missing direction."""
    base, digits = unpack(cells, res)
    alone = grid().pentagon[base] & (_leading(digits) == 0)
    parent = np.repeat(np.arange(len(cells)), 7)
    d = np.tile(np.arange(7), len(cells))
    keep = ~(alone[parent] & (d == K))
    parent, d = parent[keep], d[keep]
    shift = 3 * (14 - res)
    level = np.int64(1) << 52
    return cells[parent] + level - ((np.int64(7) - d) << shift), parent


def base_cells() -> np.ndarray:
    return _pack(np.arange(122), np.zeros((122, 0), np.int64))


def to_hex(cells: np.ndarray) -> list[str]:
    return [f"{c:x}" for c in np.asarray(cells).tolist()]


def from_hex(text: str) -> int:
    return int(text, 16)


def points_to_cells(resolutions: tuple[int, ...]):  # noqa: ANN201
    """An Arrow function of (lat, lng) columns in degrees: a struct of one 64-bit cell for each resolution, null for null or non-finite points."""
    names = [f"r{r}" for r in resolutions]

    def cells(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lat, lng in batches:
            lat, lng = (np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in (lat, lng))
            good = np.isfinite(lat) & np.isfinite(lng)
            found = latlng_to_cells(np.where(good, lat, 0.0), np.where(good, lng, 0.0), resolutions)
            yield pa.StructArray.from_arrays([pa.array(c, mask=~good) for c in found], names=names)

    return F.arrow_udf(cells, T.StructType([T.StructField(n, T.LongType()) for n in names]))


def cell_hex(lat: Column, lng: Column, res: int) -> Column:
    """The cell of a point as lower-case hex digits."""
    return F.lower(F.hex(points_to_cells((res,))(lat, lng)[f"r{res}"]))


def spacing_degrees(res: int) -> float:
    """At least the distance between centres of neighbouring cells."""
    return math.degrees(UNIT) * 7 ** (-res / 2)


def cell_box(cell: str) -> tuple[float, float, float, float] | None:
    """A box (sw_lng, sw_lat, ne_lng, ne_lat) that holds all points of a cell; None near a pole or the antimeridian."""
    value = np.array([from_hex(cell)], np.int64)
    res = int(resolution(value)[0])
    (lat,), (lng,) = cells_to_latlng(value, res)
    up = 0.65 * spacing_degrees(res)
    if abs(lat) + up >= 89:
        return None
    side = up / math.cos(math.radians(abs(lat) + up))
    return None if abs(lng) + side >= 180 else (lng - side, lat - up, lng + side, lat + up)


def is_cell(cell: str) -> bool:
    """Whether hex digits are a cell of this grid."""
    value = from_hex(cell)
    res, base = value >> 52 & 15, value >> 45 & 127
    digits = [value >> 3 * (14 - r) & 7 for r in range(15)]
    plain = value >> 59 == 1 and value >> 56 & 7 == 0 and base < 122 and all((d == 7) == (r >= res) for r, d in enumerate(digits))
    return plain and not (grid().pentagon[base] and next((d for d in digits[:res] if d), 0) == K)


class Area:
    """A polygon on the sphere: rings of (lng, lat) in degrees, the even-odd rule, sides straight in degrees.

    If a ring spans more than 180 degrees of longitude, the polygon crosses the antimeridian and western longitudes count on from 180.
    """

    def __init__(self, rings: list[list[tuple[float, float]]]):
        self.crosses = any(max(x for x, _ in r) - min(x for x, _ in r) > 180 for r in rings)
        around = lambda x: x + 360 if self.crosses and x < 0 else x
        sides = [((around(ax), ay), (around(bx), by)) for r in rings for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]], strict=True)]
        self.sides = np.array([[*a, *b] for a, b in sides if a != b]).reshape(-1, 4)
        lng, lat = self.sides[:, [0, 2]], self.sides[:, [1, 3]]
        self.box = (lng.min(), lat.min(), lng.max(), lat.max()) if len(self.sides) else None

    def holds(self, lat: np.ndarray, lng: np.ndarray, points: int = 1 << 22) -> np.ndarray:
        lng = np.where(lng < 0, lng + 360, lng) if self.crosses else lng
        out = np.zeros(len(lat), bool)
        step = max(1, points // max(1, len(self.sides)))
        ax, ay, bx, by = self.sides.T
        for at in range(0, len(lat), step):
            x, y = lng[at : at + step, None], lat[at : at + step, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                right = x < ax + (y - ay) / (by - ay) * (bx - ax)
            out[at : at + step] = (((ay > y) != (by > y)) & right).sum(axis=1) % 2 == 1
        return out

    def meets(self, lat: np.ndarray, lng: np.ndarray, radius: float, points: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """Whether circles of a radius in degrees may meet the polygon's box, and whether they may meet one of its sides."""
        lng = np.where(lng < 0, lng + 360, lng) if self.crosses else lng
        edge = np.minimum(np.abs(lat) + radius, 90)
        wide = np.where(edge > 89, 360.0, radius / np.maximum(np.cos(np.radians(edge)), 1e-3))
        w, s, e, n = self.box
        level = (lat + radius >= s) & (lat - radius <= n)
        over = lambda a, b: np.any([(lng + k + wide >= a) & (lng + k - wide <= b) for k in (-360, 0, 360)], axis=0)
        some = level & over(w, e)
        cut = np.zeros(len(lat), bool)
        rows = np.flatnonzero(some)
        step = max(1, points // max(1, len(self.sides)))
        ax, ay, bx, by = self.sides.T
        for at in range(0, len(rows), step):
            k = rows[at : at + step]
            y, x, h = lat[k, None], lng[k, None], wide[k, None]
            by_lat = (y + radius >= np.minimum(ay, by)) & (y - radius <= np.maximum(ay, by))
            by_lng = np.any([(x + t + h >= np.minimum(ax, bx)) & (x + t - h <= np.maximum(ax, bx)) for t in (-360, 0, 360)], axis=0)
            cut[k] = (by_lat & by_lng).any(axis=1)
        return some, cut


def walk(cells: np.ndarray, sure: np.ndarray, level: int, res: int, area: Area, until: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Go down from cells of a level towards those of res whose centre the area holds; sure: all of a cell's centres are in it.

    A cell's descendants lie within 0.7 of its spacing from its centre. Stops before a level with more than `until` cells.
    """
    while level < res and len(cells) and (until is None or 7 * len(cells) <= until):
        cells, parent = children(cells, level)
        sure = sure[parent]
        level += 1
        unsure = np.flatnonzero(~sure)
        lat, lng = cells_to_latlng(cells[unsure], level)
        if level == res:
            sure[unsure] = area.holds(lat, lng)
            keep = sure
        else:
            some, cut = area.meets(lat, lng, 0.7 * spacing_degrees(level))
            inside = some & ~cut
            inside[inside] = area.holds(lat[inside], lng[inside])
            sure[unsure] = inside
            keep = sure.copy()
            keep[unsure] |= cut
        cells, sure = cells[keep], sure[keep]
    return cells, sure, level



def _expand(res: int, level: int, area: Area, step: int = 20_000):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = [(np.asarray(batch.column("cell")), np.asarray(batch.column("sure")), level)]
            while todo:
                cells, sure, at = todo.pop()
                if at == res:
                    yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])
                    continue
                parts = max(1, -(-len(cells) // step))  # depth first, so that few cells are held
                for c, s in zip(np.array_split(cells, parts), np.array_split(sure, parts), strict=True):
                    if len(c):
                        todo.append(walk(c, s, at, res, area, until=7 * len(c)))

    return run


def cells_in_polygon(spark: SparkSession, rings: list[list[tuple[float, float]]], res: int, driver_cells: int = 4096) -> DataFrame:
    """cell (hex digits): the cells of a resolution whose centre lies in the polygon of rings of (lng, lat) in degrees.

    The driver goes down the hierarchy to at most driver_cells cells; tasks go on from there, depth first. An empty polygon has no cell.
    """
    area = Area(rings)
    cells, sure, level = base_cells(), np.zeros(122, bool), 0
    if area.box is None:
        cells, sure, level = cells[:0], sure[:0], res
    elif res == 0:
        sure = area.holds(*cells_to_latlng(cells, 0))
        cells, sure = cells[sure], sure[sure]
    else:
        cells, sure, level = walk(cells, sure, 0, res, area, until=driver_cells)
    rows = spark.createDataFrame(pa.table({"cell": pa.array(cells, pa.int64()), "sure": pa.array(sure, pa.bool_())}))
    if level < res:
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(parts, "cell").mapInArrow(_expand(res, level, area), "cell long")
    return rows.select(F.lower(F.hex("cell")).alias("cell"))
