"""SQL for the cells of points, by the trigonometric form of the grid's projection: azimuth and distance from the face's centre.

It shares the face table and the lookup of base cells with functions/h3.py, and no arithmetic. Points in pentagons are not covered.
"""

from __future__ import annotations

import math

from ..functions import h3


def _bases() -> str:
    """(f, i, j, k, base, turns) of all lattice points of resolution 0 that are hexagons."""
    g, rows = h3.grid(), []
    for f in range(20):
        for i in range(3):
            for j in range(3):
                for k in range(3):
                    if min(i, j, k) == 0 and (n := int(g.base[f, i, j, k])) >= 0 and not g.pentagon[n]:
                        rows.append(f"({f},{i},{j},{k},{n},{int(g.turns[f, i, j, k])})")
    return ", ".join(rows)


def cells(name: str, source: str, key: str, resolutions: tuple[int, ...]) -> str:
    """CTEs that end in {name}: key, and for each resolution h3_r, lat_r and lng_r (the cell's centre). Needs WITH RECURSIVE."""
    n = name
    faces = ", ".join(f"({f}, {a!r}e0, {b!r}e0, {c!r}e0)" for f, (a, b, c) in enumerate(h3.FACES))
    turned = " ".join(f"WHEN {t} THEN translate(digits, '123456', '{''.join(str(h3.TURNED[t][d]) for d in range(1, 7))}')" for t in range(6))
    up = lambda odd, even: f"CAST(CASE WHEN level % 2 = 1 THEN round(({odd}) / 7e0) ELSE round(({even}) / 7e0) END AS BIGINT)"
    return f"""
    {n}_faces(f, flat, flng, faz) AS (VALUES {faces}),
    {n}_bases(f, i, j, k, base, turns) AS (VALUES {_bases()}),
    {n}_near AS (SELECT {key}, arg_max({{'f': f, 'flat': flat, 'flng': flng, 'faz': faz, 'lat': radians(lat), 'lng': radians(lng)}}, sin(flat) * sin(radians(lat)) + cos(flat) * cos(radians(lat)) * cos(radians(lng) - flng)) AS p
        FROM {source}, {n}_faces GROUP BY {key}),
    {n}_polar AS (SELECT {key}, p, atan2(cos(p.lat) * sin(p.lng - p.flng), cos(p.flat) * sin(p.lat) - sin(p.flat) * cos(p.lat) * cos(p.lng - p.flng)) AS az,
        tan(acos(sin(p.flat) * sin(p.lat) + cos(p.flat) * cos(p.lat) * cos(p.lng - p.flng))) / {h3.UNIT!r}e0 AS r FROM {n}_near),
    {n}_plane AS (SELECT {key}, p, res, r * 7e0 ** (res / 2e0) * cos(t) AS x, r * 7e0 ** (res / 2e0) * sin(t) AS y
        FROM (SELECT *, p.faz - az - CASE WHEN res % 2 = 1 THEN {h3.TURN!r}e0 ELSE 0e0 END AS t FROM {n}_polar, (SELECT unnest({list(resolutions)}) AS res))),
    {n}_cube AS (SELECT *, x - y / sqrt(3e0) AS c1, 2 * y / sqrt(3e0) AS c2, -x - y / sqrt(3e0) AS c3 FROM {n}_plane),
    {n}_off AS (SELECT *, round(c1) AS w1, round(c2) AS w2, round(c3) AS w3, abs(round(c1) - c1) AS o1, abs(round(c2) - c2) AS o2, abs(round(c3) - c3) AS o3 FROM {n}_cube),
    {n}_hex AS (SELECT {key}, p, res, CAST(CASE WHEN o3 >= o1 AND o3 >= o2 THEN w1 + w2 ELSE -w3 END AS BIGINT) AS a, CAST(CASE WHEN o2 > o1 AND o2 > o3 THEN -w1 - w3 ELSE w2 END AS BIGINT) AS b FROM {n}_off),
    {n}_up AS (SELECT {key}, p.f AS f, res, res AS level, a, b, '' AS digits FROM {n}_hex
        UNION ALL SELECT {key}, f, res, level - 1, u, v, (['1', '3', '', '5', '0', '2', '', '4', '6'])[CASE WHEN level % 2 = 1 THEN (a - 2 * u - v + 1) * 3 + (b - 3 * v + u + 1) ELSE (a - 3 * u + v + 1) * 3 + (b - u - 2 * v + 1) END + 1] || digits
        FROM (SELECT *, {up('3 * a - b', '2 * a + b')} AS u, {up('a + 2 * b', '3 * b - a')} AS v FROM {n}_up WHERE level > 0)),
    {n}_homes AS (SELECT {key}, res, base, CASE turns {turned} END AS digits FROM (SELECT *, least(a, b, 0) AS low FROM {n}_up WHERE level = 0) u JOIN {n}_bases h ON h.f = u.f AND h.i = a - low AND h.j = b - low AND h.k = -low),
    {n}_ids AS (SELECT {key}, res, printf('%x', (1::BIGINT << 59) + (res::BIGINT << 52) + (base::BIGINT << 45) + CAST(list_sum(list_transform(range(1, 16), lambda q: CAST(substr(rpad(digits, 15, '7'), CAST(q AS INTEGER), 1) AS BIGINT) << CAST(3 * (15 - q) AS INTEGER))) AS BIGINT)) AS cell FROM {n}_homes),
    {n}_mid AS (SELECT {key}, res, p, sqrt((a - b / 2e0) ** 2 + 0.75e0 * b * b) * {h3.UNIT!r}e0 / 7e0 ** (res / 2e0) AS r, p.faz - (atan2(b * sqrt(3e0) / 2, a - b / 2e0) + CASE WHEN res % 2 = 1 THEN {h3.TURN!r}e0 ELSE 0e0 END) AS az FROM {n}_hex),
    {n}_lat AS (SELECT *, asin(sin(p.flat) * cos(atan(r)) + cos(p.flat) * sin(atan(r)) * cos(az)) AS mlat FROM {n}_mid),
    {n}_centres AS (SELECT {key}, res, degrees(mlat) AS mlat, degrees(p.flng + atan2(sin(az) * sin(atan(r)) * cos(p.flat), cos(atan(r)) - sin(p.flat) * sin(mlat))) AS mlng FROM {n}_lat),
    {name} AS (SELECT {key}, {', '.join(f"max(CASE WHEN res = {r} THEN cell END) AS h3_{r}, max(CASE WHEN res = {r} THEN mlat END) AS lat_{r}, max(CASE WHEN res = {r} THEN mlng END) AS lng_{r}" for r in resolutions)} FROM {n}_ids JOIN {n}_centres USING ({key}, res) GROUP BY {key})"""
