"""Queries on cells, areas and encounters, and the same in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import h3
from tracklake.operators.areas import points_in_areas
from tracklake.operators.encounters import encounters
from tracklake.operators.spatial import grid_features

Query = Callable[[SparkSession, str], DataFrame]


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(repr, v)) + ")" for v in values)


def h3_sql(points: str, resolution: int) -> str:
    """Common table expressions that end in ``celled``: id, h3 of the rows id, lat, lon of ``points``.

    The lattice is walked by a recursive query, a row for each resolution, and
    base cells are joined.
    """
    faces = _rows([(f, *v) for f, v in enumerate(h3.FACES)])
    base = _rows([(*k, b, n, int(b in h3.pentagons())) for k, (b, n) in h3.base_cells().items()])
    pent = _rows([(n, first, right, h3.pentagon_turns(n, first, bool(right))) for n in range(5) for first in range(7) for right in (0, 1)])
    turned = ", ".join(map(str, h3.tables()[2]))
    digits = ", ".join(map(str, h3.DIGITS))
    scale = repr(math.sqrt(7) ** resolution / h3.UNIT)
    turn = repr(h3.TURN if resolution % 2 else 0.0)
    return f"""
    faces(face, fla, flo, axis) as (values {faces}),
    base(face, i, j, k, base, turns, pent) as (values {base}),
    pent(turns, first, is_right, n) as (values {pent}),
    rad as (select id, radians(lat) as la, radians(lon) as lo from {points}),
    near as (
      select *, pow(cos(la) * cos(lo) - cos(fla) * cos(flo), 2) + pow(cos(la) * sin(lo) - cos(fla) * sin(flo), 2) + pow(sin(la) - sin(fla), 2) as sq
      from rad, faces qualify row_number() over (partition by id order by sq, face) = 1),
    polar as (
      select id, face, tan(acos(1 - sq / 2)) * {scale} as r,
        axis - atan2(cos(la) * sin(lo - flo), cos(fla) * sin(la) - sin(fla) * cos(la) * cos(lo - flo)) - {turn} as a
      from near),
    plane as (select id, face, r * cos(a) + r * sin(a) / sqrt(0.75) / 2 as i, r * sin(a) / sqrt(0.75) as j from polar),
    -- the nearest of the lattice points around, by distance on the plane
    around as (
      select id, face, (floor(i) + di)::bigint as i, (floor(j) + dj)::bigint as j,
        pow(floor(i) + di - i - (floor(j) + dj - j) / 2, 2) + 0.75 * pow(floor(j) + dj - j, 2) as d
      from plane, (values (-1), (0), (1), (2)) a(di), (values (-1), (0), (1), (2)) b(dj)),
    snapped as (select id, face, arg_min(i, d) as i, arg_min(j, d) as j from around group by all),
    walk as (
      select id, face, {resolution} as level, i, j, 0::bigint as digits, 0 as first from snapped
      union all
      select id, face, level - 1, pi, pj, digits + digit * pow(8, {h3.FINEST} - level)::bigint, case when digit <> 0 then digit else first end
      from (
        select *, [{digits}][(case when level % 2 = 1 then (i - 2 * pi - pj + 1) * 3 + j - 3 * pj + pi + 1 else (i - 3 * pi + pj + 1) * 3 + j - pi - 2 * pj + 1 end) + 1] as digit
        from (
          select *, round((case when level % 2 = 1 then 3 * i - j else 2 * i + j end) / 7.0::double)::bigint as pi,
            round((case when level % 2 = 1 then i + 2 * j else 3 * j - i end) / 7.0::double)::bigint as pj
          from walk where level > 0))),
    top as (
      select id, digits, w.first, base, case when pent.n is not null then pent.n else b.turns end as turns
      from (select *, least(i, j, 0) as low from walk where level = 0) w
      join base b on b.face = w.face and b.i = w.i - low and b.j = w.j - low and b.k = -low
      left join pent on b.pent = 1 and pent.turns = b.turns and pent.first = w.first and pent.is_right = (b.j = 2)::int),
    celled as (
      select id, lower(to_hex({(1 << 59) | (resolution << 52) | ((1 << 3 * (h3.FINEST - resolution)) - 1)} + base::bigint * {1 << 45}
        + coalesce(list_sum(list_transform(range(1, {resolution + 1}), lambda l: [{turned}][turns * 7 + (digits // pow(8, {h3.FINEST} - l)::bigint) % 8 + 1] * pow(8, {h3.FINEST} - l)::bigint))::bigint, 0))) as h3
      from top)"""


#: The events spread over the whole globe, poles and date line too.
_WORLD_LAT, _WORLD_LON = "(event_id * 7919 % 18001) / 100.0 - 90", "(event_id * 104729 % 36001) / 100.0 - 180"


def _world(resolution: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
        lat, lon = (F.expr(x.replace("100.0", "100D")) for x in (_WORLD_LAT, _WORLD_LON))
        return h3.with_h3(e, lat, lon, resolution)

    return run


def _world_sql(resolution: int) -> str:
    points = f"(select event_id as id, {_WORLD_LAT.replace('100.0', '100.0::double')} as lat, {_WORLD_LON.replace('100.0', '100.0::double')} as lon from events)"
    return f"with recursive {h3_sql(points, resolution)} select id as event_id, h3 from celled"


# -- areas: a four-cornered one for each customer, some of them with a dent


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    c = c.select(k.alias("area"), (18.0 + k * 37 % 997 / 1000.0).alias("x"), (54.0 + k * 53 % 991 / 1000.0).alias("y"), (0.004 + k % 9 * 0.003).alias("r"))
    corner = lambda dx, dy: F.array(F.col("x") + F.col("r") * dx, F.col("y") + F.col("r") * dy)
    return c.select("area", F.array(F.array(corner(-1.0, 0.0), corner(0.0, -0.5), corner(1.0, 0.0), corner(0.0, F.when(_is_dented(), -0.25).otherwise(1.5)))).alias("rings"))


def _is_dented() -> Column:
    return F.col("area") % 4 == 0


def _in_areas(valid: Query) -> Query:
    return lambda s, d: points_in_areas(valid(s, d).select("event_id", "LAT", "LON"), _areas(s, d)).select("event_id", "area")


def _in_areas_sql(view: str) -> str:
    corners = [("x - r", "y + r * 0.0"), ("x + r * 0.0", "y - r * 0.5"), ("x + r", "y + r * 0.0"), ("x + r * 0.0", "y + r * (case when area % 4 = 0 then -0.25::double else 1.5::double end)")]
    named = ", ".join(f"{px} as x{i}, {py} as y{i}" for i, (px, py) in enumerate(corners))
    tests, on = [], []
    for i in range(4):
        x1, y1, x2, y2 = f"x{i}", f"y{i}", f"x{(i + 1) % 4}", f"y{(i + 1) % 4}"
        side = f"(({x2} - {x1}) * (LAT - {y1}) - (LON - {x1}) * ({y2} - {y1}))"
        tests.append(f"(case when ({y1} <= LAT and LAT < {y2} and {side} > 0) or ({y2} <= LAT and LAT < {y1} and {side} < 0) then 1 else 0 end)")
        on.append(f"({side} = 0 and LON between least({x1}, {x2}) and greatest({x1}, {x2}) and LAT between least({y1}, {y2}) and greatest({y1}, {y2}))")
    return f"""with {view},
    c as (
      select c_custkey as area, 18.0::double + c_custkey * 37 % 997 / 1000.0::double as x, 54.0::double + c_custkey * 53 % 991 / 1000.0::double as y,
        0.004::double + c_custkey % 9 * 0.003::double as r from customer),
    a as (select area, x, y, r, {named} from c)
    select event_id, area from p join a on LON between x - r and x + r and LAT between y - 1.5 * r and y + 1.5 * r
    where ({" + ".join(tests)}) % 2 = 1 and not ({" or ".join(on)})"""


# -- encounters


def _encounters(valid: Query, km: float, minutes: float) -> Query:
    # Rounded as DuckDB rounds; F.round makes a decimal of each, which costs more than to find the pair.
    return lambda s, d: encounters(valid(s, d), km, minutes).withColumn("min_km", F.floor(F.col("min_km") * 1e6 + 0.5) / 1e6)


def _encounters_sql(view: str, km: float, minutes: int) -> str:
    """Every two vessels in a span are compared."""
    h = "pow(sin((radians(t.LAT) - radians(s.LAT)) / 2), 2) + cos(radians(s.LAT)) * cos(radians(t.LAT)) * pow(sin((radians(t.LON) - radians(s.LON)) / 2), 2)"
    return f"""with {view},
    s as (
      select MMSI, slot, arg_max(LAT, (ts, LAT, LON)) as LAT, arg_max(LON, (ts, LAT, LON)) as LON
      from (select *, datesub('millisecond', timestamp '1970-01-01', ts) // {minutes * 60_000} as slot from p) group by all),
    m as (
      select s.MMSI as a, t.MMSI as b, s.slot, 2 * 6371.0088 * asin(sqrt({h})) as km
      from s join s t on s.slot = t.slot and s.MMSI < t.MMSI where 2 * 6371.0088 * asin(sqrt({h})) <= {km}),
    r as (select *, slot - row_number() over (partition by a, b order by slot) as run from m)
    select a as mmsi_a, b as mmsi_b, timestamp '1970-01-01' + to_milliseconds(min(slot) * {minutes * 60_000}) as start,
      timestamp '1970-01-01' + to_milliseconds((max(slot) + 1) * {minutes * 60_000}) as "end", count(*) as slots, round(min(km), 6) as min_km
    from r group by a, b, run"""


def catalogue(valid: Query, view: str) -> dict[str, tuple[Query, str | None]]:
    return {
        "grid_h3": (
            lambda s, d: grid_features(valid(s, d), 7).withColumns({c: F.round(c, 6) for c in ("avg_sog", "avg_cog")}),
            f"with recursive {view}, {h3_sql('(select event_id as id, LAT as lat, LON as lon from p)', 7)} select h3, count(*) as points, round(avg(SOG), 6) as avg_sog, round(avg(COG), 6) as avg_cog from celled join p on id = event_id group by 1",
        ),
        "encounters": (_encounters(valid, 8.0, 60), _encounters_sql(view, 8.0, 60)),
        "encounters_far": (_encounters(valid, 20.0, 120), _encounters_sql(view, 20.0, 120)),
        "points_in_areas": (_in_areas(valid), _in_areas_sql(view)),
        "h3_world_base": (_world(0), _world_sql(0)),
        "h3_world_fine": (_world(8), _world_sql(8)),
    }
