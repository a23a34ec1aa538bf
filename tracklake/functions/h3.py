"""Hexagonal cells of the published H3 grid as column expressions.

A point is projected from the centre of its nearest icosahedron face to a plane
(gnomonic), snapped to the hexagon lattice of the resolution, and walked up
through the resolutions: each parent lattice has a seventh of the cells and is
turned by about 19 degrees, alternately one way and the other, and a cell's
digit says which of the parent's seven children it is. The lattice at the top
has 122 base cells; since a base cell counts its digits from the axes of one
home face, digits found on another face are turned to those.

Lattice positions are kept in two axes, i at 0 and j at 120 degrees (k, at 240,
is minus their sum), so a parent is a linear map and a rounding. All steps are
projections of built-in functions and stay in generated code.

Which base cell lies at a lattice position, and how its axes are turned, is
computed from the geometry when first needed; only what the grid's definition
sets by choice is written down below.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published definition of the grid. Face centres (latitude and
# longitude in radians) and the azimuth of each face's i axis at its centre.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
#: Of the base cells from 0 to 121, the home face and the i, j, k position on it. Those at 2, 0, 0 are the pentagons.
HOMES = (
    (1, 1, 0, 0), (2, 1, 1, 0), (1, 0, 0, 0), (2, 1, 0, 0), (0, 2, 0, 0), (1, 1, 1, 0), (1, 0, 0, 1), (2, 0, 0, 0),
    (0, 1, 0, 0), (2, 0, 1, 0), (1, 0, 1, 0), (1, 0, 1, 1), (3, 1, 0, 0), (3, 1, 1, 0), (11, 2, 0, 0), (4, 1, 0, 0),
    (0, 0, 0, 0), (6, 0, 1, 0), (0, 0, 0, 1), (2, 0, 1, 1), (7, 0, 0, 1), (2, 0, 0, 1), (0, 1, 1, 0), (6, 0, 0, 1),
    (10, 2, 0, 0), (6, 0, 0, 0), (3, 0, 0, 0), (11, 1, 0, 0), (4, 1, 1, 0), (3, 0, 1, 0), (0, 0, 1, 1), (4, 0, 0, 0),
    (5, 0, 1, 0), (0, 0, 1, 0), (7, 0, 1, 0), (11, 1, 1, 0), (7, 0, 0, 0), (10, 1, 0, 0), (12, 2, 0, 0), (6, 1, 0, 1),
    (7, 1, 0, 1), (4, 0, 0, 1), (3, 0, 0, 1), (3, 0, 1, 1), (4, 0, 1, 0), (6, 1, 0, 0), (11, 0, 0, 0), (8, 0, 0, 1),
    (5, 0, 0, 1), (14, 2, 0, 0), (5, 0, 0, 0), (12, 1, 0, 0), (10, 1, 1, 0), (4, 0, 1, 1), (12, 1, 1, 0), (7, 1, 0, 0),
    (11, 0, 1, 0), (10, 0, 0, 0), (13, 2, 0, 0), (10, 0, 0, 1), (11, 0, 0, 1), (9, 0, 1, 0), (8, 0, 1, 0), (6, 2, 0, 0),
    (8, 0, 0, 0), (9, 0, 0, 1), (14, 1, 0, 0), (5, 1, 0, 1), (16, 0, 1, 1), (8, 1, 0, 1), (5, 1, 0, 0), (12, 0, 0, 0),
    (7, 2, 0, 0), (12, 0, 1, 0), (10, 0, 1, 0), (9, 0, 0, 0), (13, 1, 0, 0), (16, 0, 0, 1), (15, 0, 1, 1), (15, 0, 1, 0),
    (16, 0, 1, 0), (14, 1, 1, 0), (13, 1, 1, 0), (5, 2, 0, 0), (8, 1, 0, 0), (14, 0, 0, 0), (9, 1, 0, 1), (14, 0, 0, 1),
    (17, 0, 0, 1), (12, 0, 0, 1), (16, 0, 0, 0), (17, 0, 1, 1), (15, 0, 0, 1), (16, 1, 0, 1), (9, 1, 0, 0), (15, 0, 0, 0),
    (13, 0, 0, 0), (8, 2, 0, 0), (13, 0, 1, 0), (17, 1, 0, 1), (19, 0, 1, 0), (14, 0, 1, 0), (19, 0, 1, 1), (17, 0, 1, 0),
    (13, 0, 0, 1), (17, 0, 0, 0), (16, 1, 0, 0), (9, 2, 0, 0), (15, 1, 0, 1), (15, 1, 0, 0), (18, 0, 1, 1), (18, 0, 0, 1),
    (19, 0, 0, 1), (17, 1, 0, 0), (19, 0, 0, 0), (18, 0, 1, 0), (18, 1, 0, 1), (19, 2, 0, 0), (19, 1, 0, 0), (18, 0, 0, 0),
    (19, 1, 0, 1), (18, 1, 0, 0),
)
PENTAGONS = {4: (), 14: (2, 6), 24: (1, 5), 38: (3, 7), 49: (0, 9), 58: (4, 8), 63: (11, 15), 72: (12, 16), 83: (10, 19), 97: (13, 17), 107: (14, 18), 117: ()}
#: The width of a base cell on the plane, and the turn between resolutions.
UNIT = 0.38196601125010500003
TURN = math.asin(math.sqrt(3 / 28))
#: Digits by direction (di + 1) * 3 + dj + 1, and the digit that a turn of 60 degrees to the left makes of each.
DIGITS = (1, 3, 0, 5, 0, 2, 0, 4, 6)
LEFT = (0, 5, 3, 1, 6, 4, 2)
FINEST = 15


def _vector(lat: float, lon: float) -> tuple[float, float, float]:
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def _place(face: int, i: float, j: float) -> tuple[float, float, float]:
    """The point of the sphere at a position of a face's base lattice."""
    lat, lon, axis = FACES[face]
    x, y = i - j / 2, j * math.sqrt(3) / 2
    away, azimuth = math.atan(math.hypot(x, y) * UNIT), axis - math.atan2(y, x)
    centre = _vector(lat, lon)
    north, east = (-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)), (-math.sin(lon), math.cos(lon), 0.0)
    return tuple(math.cos(away) * c + math.sin(away) * (math.cos(azimuth) * n + math.sin(azimuth) * e) for c, n, e in zip(centre, north, east, strict=True))


def _heading(face: int, i: float, j: float, at: tuple[float, float, float]) -> float:
    """The direction of a face's i axis at a position, as an angle to the left of north at ``at``."""
    there = _place(face, i + 0.01, j)
    here = _place(face, i, j)
    step = [b - a for a, b in zip(here, there, strict=True)]
    lat, lon = math.asin(at[2]), math.atan2(at[1], at[0])
    north = (-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat))
    west = (math.sin(lon), -math.cos(lon), 0.0)
    return math.atan2(sum(a * b for a, b in zip(step, west, strict=True)), sum(a * b for a, b in zip(step, north, strict=True)))


def homes() -> list[tuple[int, int, int]]:
    """(face, i, j) of each base cell, in two axes."""
    return [(face, i - k, j - k) for face, i, j, k in HOMES]


def pentagons() -> list[int]:
    return [b for b, (_, i, _, _) in enumerate(HOMES) if i == 2]


@lru_cache(1)
def base_cells() -> dict[tuple[int, int, int, int], tuple[int, int]]:
    """(base cell, turns of 60 degrees to the left) at each (face, i, j, k) with numbers up to 2, one of them 0."""
    home = homes()
    centres = [_place(*h) for h in home]
    # Each pentagon's five faces, to the left around it, from the home face on.
    corners = {(f, c): max(range(122), key=lambda b: sum(x * y for x, y in zip(centres[b], _place(f, *p), strict=True))) for f in range(20) for c, p in enumerate(((2, 0), (0, 2), (-2, -2)))}
    order: dict[int, list[int]] = {}
    for b in pentagons():
        faces = [f for (f, _), at in corners.items() if at == b]
        lat, lon = math.asin(centres[b][2]), math.atan2(centres[b][1], centres[b][0])
        north = (-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat))
        west = (math.sin(lon), -math.cos(lon), 0.0)
        angle = {f: math.atan2(*(sum(x * y for x, y in zip(_place(f, 0, 0), d, strict=True)) for d in (west, north))) for f in faces}
        order[b] = sorted(faces, key=lambda f: (angle[f] - angle[home[b][0]]) % (2 * math.pi))  # noqa: B023
    found = {}
    for face in range(20):
        for i, j, k in ((i, j, k) for i in range(3) for j in range(3) for k in range(3) if 0 in (i, j, k)):
            at = _place(face, i - k, j - k)
            base = max(range(122), key=lambda b: sum(x * y for x, y in zip(centres[b], at, strict=True)))  # noqa: B023
            if base in pentagons():
                # Turns skip the missing child; from a corner of i, j or k the face's middle is the first, second or fourth of the others.
                turns = (order[base].index(face) - (0, 1, 3)[(i, j, k).index(2)]) % 5
            else:
                mine, own = _heading(face, i - k, j - k, centres[base]), _heading(*home[base], centres[base])
                turns = round((mine - own) / (math.pi / 3))
            found[face, i, j, k] = base, turns % 6
    return found


def pentagon_turns(turns: int, first: int, right: bool) -> int:
    """Turns to the left of a pentagon's digits, whose first one that isn't 0 is ``first``.

    A pentagon has no child 1. A face that has it at its j corner (``right``)
    leaves that direction by a turn to the right, others by one to the left.
    """
    if not first:
        return 0
    total = 0

    def left(n: int) -> None:
        nonlocal first, total
        for _ in range(n):
            first, total = LEFT[first], total + 1

    if first == 1:
        left(5 if right else 1)
    for _ in range(turns):
        left(1)
        if first == 1:
            left(1)
    return total % 6


@lru_cache(1)
def tables() -> tuple[list[int], list[int], list[int]]:
    """Base cells by face and position; turns by face, position and first digit; digits by turns and digit."""
    bases, turns = [0] * 540, [0] * (540 * 7)
    for (face, i, j, k), (base, n) in base_cells().items():
        at = face * 27 + i * 9 + j * 3 + k
        bases[at] = base
        for first in range(7):
            turns[at * 7 + first] = pentagon_turns(n, first, j == 2) if base in pentagons() else n
    turned = list(range(7))
    digits = []
    for _ in range(6):
        digits += turned
        turned = [LEFT[d] for d in turned]
    return bases, turns, digits


def _table(values: list[int] | list[float], kind: str) -> Column:
    """An array that the optimizer folds into one constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def with_h3(df: DataFrame, lat: Column, lon: Column, resolution: int, name: str = "h3") -> DataFrame:
    """``df`` with the cell of a point in degrees, as its hexadecimal name; null if a coordinate is null or not finite.

    A point on a border belongs to either cell. Columns named ``__h3_...`` are taken while this runs.
    """
    if not 0 <= resolution <= FINEST:
        raise ValueError("resolution must be from 0 to 15")
    kept = [c for c in df.columns if c != name]
    c = lambda x: F.col(f"__h3_{x}")

    def derive(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.withColumns({f"__h3_{k}": v for k, v in columns.items()})

    finite = (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    out = derive(df, lat=F.when(finite, F.radians(lat)), lon=F.when(finite, F.radians(lon)))
    out = derive(out, x=F.cos(c("lat")) * F.cos(c("lon")), y=F.cos(c("lat")) * F.sin(c("lon")), z=F.sin(c("lat")))
    square = lambda v: v * v
    away = [sum((square(c(axis) - v) for axis, v in zip("xyz", _vector(la, lo), strict=True)), F.lit(0.0)) for la, lo, _ in FACES]
    out = derive(out, **{f"away{f}": a for f, a in enumerate(away)})
    out = derive(out, least=F.least(*(c(f"away{f}") for f in range(20))))
    nearest = F.coalesce(*(F.when(c(f"away{f}") == c("least"), f) for f in range(20)))
    out = derive(out, face=nearest).drop(*(f"__h3_away{f}" for f in range(20)))
    of_face = lambda n: F.get(_table([f[n] for f in FACES], "double"), c("face"))
    out = derive(out, la=of_face(0), east=c("lon") - of_face(1), axis=of_face(2))
    north = F.cos(c("la")) * F.sin(c("lat")) - F.sin(c("la")) * F.cos(c("lat")) * F.cos(c("east"))
    azimuth = F.atan2(F.cos(c("lat")) * F.sin(c("east")), north)
    scale = math.sqrt(7) ** resolution / UNIT
    out = derive(out, angle=c("axis") - azimuth - (TURN if resolution % 2 else 0.0), radius=F.tan(F.acos(1 - c("least") / 2)) * scale)
    out = derive(out, j=c("radius") * F.sin(c("angle")) / math.sqrt(0.75))
    out = derive(out, i=c("radius") * F.cos(c("angle")) + c("j") / 2)
    # The nearest lattice point, in three coordinates that sum to 0: the one rounded most follows from the others.
    out = derive(out, rq=F.rint(c("i") - c("j")), rj=F.rint(c("j")), ri=F.rint(c("i")))
    out = derive(out, dq=F.abs(c("rq") - (c("i") - c("j"))), dj=F.abs(c("rj") - c("j")), di=F.abs(c("ri") - c("i")))
    by_q = (c("dq") > c("dj")) & (c("dq") > c("di"))
    i = F.when(by_q | (c("dj") > c("di")), c("ri")).otherwise(c("rq") + c("rj"))
    j = F.when(~by_q & (c("dj") > c("di")), c("ri") - c("rq")).otherwise(c("rj"))
    out = derive(out, i=i.cast("bigint"), j=j.cast("bigint"), digits=F.lit(0).cast("bigint"), first=F.lit(0))
    for level in range(resolution, 0, -1):
        seventh = lambda v: F.floor((v + 3) / F.lit(7.0))
        if level % 2:
            up, down = (3 * c("i") - c("j"), c("i") + 2 * c("j")), (2 * c("pi") + c("pj"), 3 * c("pj") - c("pi"))
        else:
            up, down = (2 * c("i") + c("j"), 3 * c("j") - c("i")), (3 * c("pi") - c("pj"), c("pi") + 2 * c("pj"))
        out = derive(out, pi=seventh(up[0]), pj=seventh(up[1]))
        out = derive(out, digit=F.get(_table(list(DIGITS), "int"), ((c("i") - down[0] + 1) * 3 + c("j") - down[1] + 1).cast("int")))
        digits = c("digits") + F.shiftleft(c("digit").cast("bigint"), 3 * (FINEST - level))
        out = derive(out, i=c("pi"), j=c("pj"), digits=digits, first=F.when(c("digit") != 0, c("digit")).otherwise(c("first")))
    out = derive(out, low=F.least(c("i"), c("j"), F.lit(0).cast("bigint")))
    at = c("face") * 27 + ((c("i") - c("low")) * 9 + (c("j") - c("low")) * 3 - c("low")).cast("int")
    bases, turns, turned = tables()
    out = derive(out, at=at)
    out = derive(out, base=F.get(_table(bases, "int"), c("at")), turns=F.get(_table(turns, "int"), c("at") * 7 + c("first")))
    cell = F.lit((1 << 59) | (resolution << 52) | ((1 << 3 * (FINEST - resolution)) - 1)).cast("bigint") + F.shiftleft(c("base").cast("bigint"), 45)
    for level in range(1, resolution + 1):
        shift = 3 * (FINEST - level)
        digit = F.get(_table(turned, "int"), c("turns") * 7 + F.shiftright(c("digits"), shift).bitwiseAND(F.lit(7)).cast("int"))
        cell = cell + F.shiftleft(digit.cast("bigint"), shift)
    return out.select(*kept, F.lower(F.hex(cell)).alias(name))
