"""Registered queries of cleaning, selection, pairing, neighbourhoods, regridding and text formats, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratocast.catalog import _codes_sql, query, scalar
from stratocast.functions import calendar as C
from stratocast.functions import cleaning as Q
from stratocast.operators import datasets as DS
from stratocast.operators import neighbours as N
from stratocast.operators import phenomena as P
from stratocast.operators import relational as R
from stratocast.operators import selection as S
from stratocast.plans import projections as T
from stratocast.session import scratch_path
from stratocast.sources import listing as L
from stratocast.sources import micaps, netcdf

_c = F.col
_r = lambda df, *names, keep=(): df.select(*keep, *[F.round(n, 4).alias(n) for n in names])

# --- values
scalar("in_range", lambda: Q.in_range(_c("t"), -5, 20, -99.0).cast("double"), "CASE WHEN t BETWEEN -5 AND 20 THEN t ELSE -99.0 END")
scalar("replaced_below", lambda: Q.replaced_below(_c("t"), 0, 5, most=20), "least(CASE WHEN t < 5 THEN 0 ELSE t END, 20)")
scalar("replaced_from", lambda: Q.replaced_from(_c("t"), 0, 12, most=9999), "CASE WHEN t >= 12 THEN 0 ELSE t END")
scalar("set_to", lambda: Q.set_to(_c("t"), 3), "3.0")
scalar("replaced_where_far", lambda: Q.replaced_where_far(_c("t"), _c("w"), 8), "CASE WHEN abs(t - w) >= 8 THEN w ELSE t END")
scalar("land_only", lambda: Q.land_only(_c("t"), _c("hydro") % 2), "CASE WHEN hydro % 2 = 1 THEN t END")
scalar("land_and_sea", lambda: Q.land_and_sea(Q.land_only(_c("t"), _c("hydro") % 2), _c("w")), "CASE WHEN hydro % 2 = 1 THEN t ELSE w END")
scalar("core_by_cosine", lambda: Q.core_by_cosine(_c("refl"), _c("refl") - _c("w"), 8.0, 55.0, 45.0).cast("double"), "CAST(refl >= 45 OR w >= CASE WHEN refl - w < 0 THEN 8 ELSE greatest(8 * cos(pi() * (refl - w) / 110), 0) END AS INTEGER)")
scalar("core_by_factor", lambda: Q.core_by_factor(_c("refl"), _c("refl") - _c("w"), 1.2, 45.0).cast("double"), "CAST(refl >= 45 OR w >= CASE WHEN refl - w < 0 THEN 0 ELSE greatest(1.2 * (refl - w) - (refl - w), 0) END AS INTEGER)")
scalar("radius_class", lambda: Q.radius_class(_c("refl"), [20.0, 25.0, 30.0, 35.0]).cast("double"), "CAST(CASE WHEN refl >= 35 THEN 4 WHEN refl >= 30 THEN 3 WHEN refl >= 25 THEN 2 WHEN refl >= 20 THEN 1 ELSE 0 END AS DOUBLE)")
scalar("celsius_to_fahrenheit", lambda: Q.converted(_c("t"), "celsius", "fahrenheit"), "t * 1.8 + 32")
scalar("knots", lambda: Q.converted(_c("w"), "m s-1", "knot"), "w * 3600.0 / 1852")
scalar("lead_hours", lambda: Q.lead_in(Q.lead_seconds(_c("refl"), "hours"), "minute"), "refl * 60")
scalar("angle_back", lambda: Q.angle_of(*Q.angle_parts(_c("refl") * 7 - 90, _c("w"))), "((refl * 7 - 90) % 360 + 360) % 360")
scalar("row_interpolated", lambda: Q.row_interpolated(_c("refl"), [5.0, 20.0, 40.0], F.array(_c("t"), _c("w"), _c("rh"))), "CASE WHEN refl <= 5 THEN t WHEN refl <= 20 THEN t + (refl - 5) / 15 * (w - t) WHEN refl <= 40 THEN w + (refl - 20) / 20 * (rh - w) ELSE rh END")
scalar("recycled_member", lambda: Q.recycled(_c("ok"), 11).cast("double"), "CAST(ok % 11 AS DOUBLE)")
scalar("predicates_joined", lambda: Q.joined_predicate(_c("t") < 0, _c("w") > 5, "or").cast("int") + 2 * Q.joined_predicate(_c("t") < 0, _c("w") > 5, "and").cast("int"), "CAST(t < 0 OR w > 5 AS INTEGER) + 2 * CAST(t < 0 AND w > 5 AS INTEGER)")
scalar("segment_of_lead", lambda: Q.segment(_c("refl")).cast("double"), "CAST(ceil(refl / 12) AS DOUBLE)")
scalar("filled_missing", lambda: Q.filled(_c("t"), _c("t") < 0, -1.0), "CASE WHEN t < 0 THEN -1 ELSE t END")
_LON, _LAT = "(100 + refl / 2)", "(25 + w)"
_lon, _lat = lambda: 100 + _c("refl") / 2, lambda: 25 + _c("w")
scalar("equal_distance_x", lambda: Q.equal_distance(_lon(), _lat(), 110.0, 30.0)[0] / 1000, f"radians({_LON} - 110) * cos(radians(30)) * 6371.229")
scalar("equal_area_y", lambda: Q.equal_area(_lon(), _lat(), 110.0, 30.0)[1] / 1000, f"6371.229 * sqrt(2 / (1 + sin(radians(30)) * sin(radians({_LAT})) + cos(radians(30)) * cos(radians({_LAT})) * cos(radians({_LON} - 110)))) * (cos(radians(30)) * sin(radians({_LAT})) - sin(radians(30)) * cos(radians({_LAT})) * cos(radians({_LON} - 110)))")
_N = "(ln(cos(radians(25)) / cos(radians(47))) / ln(tan(pi() / 4 + radians(47) / 2) / tan(pi() / 4 + radians(25) / 2)))"
scalar("lambert_x", lambda: Q.lambert(_lon(), _lat(), 110.0, 25.0, 47.0, 36.0)[0] / 1000, f"6371.229 * (cos(radians(25)) * power(tan(pi() / 4 + radians(25) / 2), {_N}) / {_N}) / power(tan(radians({_LAT}) / 2 + pi() / 4), {_N}) * sin(radians({_LON} - 110) * {_N})")


@query("physical_limits", f"""
    WITH e AS (SELECT ok, ln, hydro, (ARRAY['temperature', 'relative_humidity', 'total_cloud', 'visibility', 'ws', 'u', 'precipitation', 'v', 'other'])[hydro] AS element, (refl - 25) * 5 AS x FROM {T.MOMENTS})
    SELECT ok, ln, round(CASE element
        WHEN 'temperature' THEN CASE WHEN x > -60 AND x < 60 THEN x END
        WHEN 'relative_humidity' THEN CASE WHEN x <= 0 THEN 0.1 WHEN x > 100 THEN 100 ELSE x END
        WHEN 'total_cloud' THEN least(greatest(x, 0), 1)
        WHEN 'visibility' THEN least(greatest(x, 10), 100000)
        WHEN 'ws' THEN CASE WHEN x >= 120 THEN NULL ELSE greatest(x, 0) END
        WHEN 'u' THEN CASE WHEN x > -80 AND x < 80 THEN x END
        WHEN 'v' THEN CASE WHEN x > -80 AND x < 80 THEN x END
        WHEN 'precipitation' THEN CASE WHEN x >= 2000 THEN NULL ELSE greatest(x, 0) END
        ELSE x END, 4) AS v FROM e""")  # fmt: skip
def physical_limits(spark, d):
    names = F.array(*[F.lit(n) for n in ("temperature", "relative_humidity", "total_cloud", "visibility", "ws", "u", "precipitation", "v", "other")])
    rows = T.moments(spark, d).select("ok", "ln", F.element_at(names, _c("hydro").cast("int")).alias("element"), ((_c("refl") - 25) * 5).alias("x"))
    return rows.select("ok", "ln", F.round(Q.physical(_c("x"), _c("element")), 4).alias("v"))


@query("flat_gates", f"""
    WITH g AS (SELECT ok, ln, hydro % 3 AS v, lag(hydro % 3) OVER w AS a, lead(hydro % 3) OVER w AS b FROM {T.MOMENTS} WINDOW w AS (PARTITION BY ok ORDER BY ln))
    SELECT ok, ln, coalesce(v = a AND v = b, false) AS flat FROM g""")  # fmt: skip
def flat_gates(spark, d):
    w = Window.partitionBy("ok").orderBy("ln")
    v = _c("hydro") % 3
    return T.moments(spark, d).select("ok", "ln", Q.flat_gate(v, F.lag(v).over(w), F.lead(v).over(w)).alias("flat"))


# --- stations and grids
CORNERS = [(2.0, 1.0), (15.0, 3.0), (12.0, 9.0), (17.0, 16.0), (4.0, 14.0)]


@query("stations_in_box", f"SELECT id, sy, sx FROM {T.STATIONS} WHERE sx >= 3 AND sx < 12 AND sy >= 2.5 AND sy < 14")
def stations_in_box(spark, d):
    return T.stations(spark, d).where(Q.in_box(_c("sx"), _c("sy"), 3, 12, 2.5, 14)).select("id", "sy", "sx")


def _polygon_sql(x: str, y: str) -> str:
    edges = zip(CORNERS, [*CORNERS[1:], CORNERS[0]], strict=True)
    return "(" + " + ".join(f"CAST((({y1} > {y}) <> ({y2} > {y})) AND {x} < ({x2 - x1}) / ({y2 - y1}) * ({y} - {y1}) + {x1} AS INTEGER)" for (x1, y1), (x2, y2) in edges) + ") % 2 = 1"


@query("stations_in_polygon", f"SELECT id, sy, sx FROM {T.STATIONS} WHERE {_polygon_sql('sx', 'sy')}")
def stations_in_polygon(spark, d):
    return T.stations(spark, d).where(Q.in_polygon(_c("sx"), _c("sy"), CORNERS)).select("id", "sy", "sx")


@query("polygon_mask", f"SELECT iy, ix, CASE WHEN {_polygon_sql('ix', 'iy')} THEN 1 ELSE 0 END AS mask FROM {T.GRID}")
def polygon_mask(spark, d):
    return T.grid(spark, d).select("iy", "ix", Q.in_polygon(_c("ix"), _c("iy"), CORNERS).cast("int").alias("mask"))


@query("region_greatest", f"SELECT max(v) AS greatest, count(*) AS cells FROM {T.GRID} WHERE {_polygon_sql('ix', 'iy')}")
def region_greatest(spark, d):
    return N.region_greatest(T.grid(spark, d), Q.in_polygon(_c("ix"), _c("iy"), CORNERS), "v")


for _how, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*")):

    @query(f"cells_{_how}", f"SELECT iy, ix, v {_sign} z AS v FROM {T.GRID}")
    def _cells(spark, d, how=_how):
        g = T.grid(spark, d)
        return S.cellwise(g.select("iy", "ix", "v"), g.select("iy", "ix", _c("z").alias("v")), ["iy", "ix"], "v", how)


@query("station_differences", f"SELECT a.id, a.value - b.value AS value FROM {T.STATIONS} a JOIN {T.STATIONS} b ON b.id = a.id + 1")
def station_differences(spark, d):
    s = T.stations(spark, d).select("id", "value")
    return S.cellwise(s, s.withColumn("id", _c("id") - 1), ["id"], "value", "subtract")


@query("stations_updated", f"SELECT a.id, coalesce(b.value, a.value) AS value FROM {T.STATIONS} a LEFT JOIN (SELECT id, value + 1000 AS value FROM {T.STATIONS} WHERE id % 3 = 0) b USING (id)")
def stations_updated(spark, d):
    s = T.stations(spark, d).select("id", "value")
    return S.updated(s, s.where("id % 3 = 0").withColumn("value", _c("value") + 1000), ["id"], "value")


@query("thinned_grid", f"SELECT iy, ix, v FROM {T.GRID} WHERE iy % 3 = 0 AND ix % 3 = 0 AND z - 100 < 0")
def thinned_grid(spark, d):
    return S.thinned(T.grid(spark, d).withColumn("m", _c("z") - 100), "m", 3).select("iy", "ix", "v")


@query("masked_grid", f"SELECT iy, ix, CASE WHEN z - 100 <= 0 THEN 0.0 ELSE v END AS v FROM {T.GRID}")
def masked_grid(spark, d):
    return S.masked(T.grid(spark, d).withColumn("m", _c("z") - 100), "v", "m").select("iy", "ix", "v")


@query("stations_from_vectors", f"SELECT CAST(id % 7 AS BIGINT) AS k, CAST(row_number() OVER (PARTITION BY id % 7 ORDER BY id) - 1 AS INTEGER) AS at, sx AS lon, sy AS lat, value FROM {T.STATIONS}")
def stations_from_vectors(spark, d):
    each = F.array_sort(F.collect_list(F.struct("id", "sx", "sy", "value")))  # a few stations a key
    vectors = T.stations(spark, d).groupBy((_c("id") % 7).alias("k")).agg(each.alias("a")).select("k", *[F.col(f"a.{c}").alias(c) for c in ("sx", "sy", "value")])
    return S.from_vectors(vectors, ["k"], "sx", "sy", "value")


@query("block_edges", """
    WITH b AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS l, CAST(p_size % 17 AS DOUBLE) + 20 AS r FROM part),
    e AS (SELECT id, l AS edge, r FROM b WHERE l < r UNION ALL SELECT id, x, r FROM (SELECT id, l, r, CAST(unnest(generate_series(0, 60, 5)) AS DOUBLE) AS x FROM b WHERE l < r) WHERE x > l AND x < r)
    SELECT id, edge AS lower, coalesce(lead(edge) OVER (PARTITION BY id ORDER BY edge), r) AS upper FROM e""")
def block_edges(spark, d):
    parts = T.table(spark, d, "part").select(_c("p_partkey").alias("id"), _c("p_size").cast("double").alias("l"), (_c("p_size") % 17 + 20).cast("double").alias("r"))
    return parts.select("id", F.inline(S.block_edges(_c("l"), _c("r"))))


@query("axes_on_one_side", f"""
    WITH a AS (SELECT DISTINCT iy, ix FROM {T.GRID} WHERE iy < 15), b AS (SELECT DISTINCT iy, ix FROM {T.GRID} WHERE iy >= 3)
    SELECT iy::DOUBLE AS iy, ix::DOUBLE AS ix, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT iy, ix, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def axes_on_one_side(spark, d):
    g = T.grid(spark, d)
    out = S.only_on_one_side(g.where("iy < 15"), g.where("iy >= 3"), ["iy", "ix"])
    return out.select(F.round("iy", 6).alias("iy"), F.round("ix", 6).alias("ix"), "side")


@query("valid_times_lacking", f"SELECT DISTINCT day FROM {T.SERIES} WHERE id < 3 EXCEPT SELECT DISTINCT day FROM {T.SERIES} WHERE id >= 30")
def valid_times_lacking(spark, d):
    s = T.series(spark, d)
    return S.not_contained(s.where("id < 3"), s.where("id >= 30"), ["day"])


@query("collapsed_members", f"SELECT id, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance FROM {T.MEMBERS} GROUP BY id")
def collapsed_members(spark, d):
    return _r(S.collapsed(T.members(spark, d), ["id"], "value"), "mean", "variance", keep=("id",))


@query("nearest_levels", f"SELECT id, member, round(value, 4) AS value FROM {T.MEMBERS} WHERE abs(value - 0.5) <= 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(value - 0.5), value) = 1")
def nearest_levels(spark, d):
    return S.nearest_level(T.members(spark, d), ["id"], "value", 0.5).select("id", "member", F.round("value", 4).alias("value"))


@query("first_valid_pairs", f"""
    WITH f AS (SELECT id, day, CASE WHEN day % 5 = 0 THEN NULL ELSE v END AS forecast, day % 2 AS run FROM {T.SERIES} WHERE id < 20 UNION ALL SELECT id, day, v + 1, 7 FROM {T.SERIES} WHERE id < 10),
    o AS (SELECT id - 20 AS id, day, v AS truth FROM {T.SERIES} WHERE id >= 20),
    p AS (SELECT * FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id, day ORDER BY run) = 1) JOIN o USING (id, day))
    SELECT id, day, forecast, truth FROM p WHERE day IN (SELECT day FROM p GROUP BY day HAVING count(forecast) > 0 AND count(truth) > 0)""")  # fmt: skip
def first_valid_pairs(spark, d):
    s = T.series(spark, d)
    f = s.where("id < 20").select("id", "day", F.when(_c("day") % 5 != 0, _c("v")).alias("forecast"), (_c("day") % 2).alias("run"))
    f = f.unionByName(s.where("id < 10").select("id", "day", (_c("v") + 1).alias("forecast"), F.lit(7).cast("long").alias("run")))
    o = s.where("id >= 20").select((_c("id") - 20).alias("id"), "day", _c("v").alias("truth"))
    return S.first_pairs(f, o, "day", ["id"], ["run"]).select("id", "day", "forecast", "truth")


@query("mixed_leads", "SELECT l_shipmode AS source, leads, cycle_hours FROM (SELECT l_returnflag || (l_suppkey % 3) AS l_shipmode, count(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE l_linenumber END) AS leads, count(DISTINCT hour(l_shipdate)) AS cycle_hours FROM lineitem GROUP BY 1) WHERE leads > 1 OR cycle_hours > 1")
def mixed_leads(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.concat("l_returnflag", (_c("l_suppkey") % 3).cast("string")).alias("source"), F.when(_c("l_suppkey") % 3 == 0, 1).otherwise(_c("l_linenumber")).alias("lead"), "l_shipdate")
    return S.mixed_leads(rows, "source", "lead", "l_shipdate")


@query("stations_with_observed", f"SELECT id, coalesce(CASE WHEN id % 4 <> 0 THEN value END, 0.0) AS value FROM {T.STATIONS}")
def stations_with_observed(spark, d):
    s = T.stations(spark, d)
    return S.with_observed(s.select("id"), s.where("id % 4 <> 0"), "id", "value").select("id", "value")


@query("cycle_pairs_lacking", f"""
    WITH a AS (SELECT DISTINCT day, id FROM {T.SERIES} WHERE id < 5), b AS (SELECT DISTINCT day, id - 2 AS id FROM {T.SERIES} WHERE id BETWEEN 2 AND 7)
    SELECT day, id, 'second' AS lacking FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT day, id, 'first' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")  # fmt: skip
def cycle_pairs_lacking(spark, d):
    s = T.series(spark, d)
    return S.pairs_by_cycle(s.where("id < 5"), s.where("id between 2 and 7").withColumn("id", _c("id") - 2), ["day", "id"])[1]


@query("model_availability", f"""
    WITH w AS (SELECT * FROM (SELECT DISTINCT m FROM {T.MODELS}), range(30) r(block)), f AS (SELECT DISTINCT m, block FROM {T.MODELS} WHERE f >= 40 AND o >= 40)
    SELECT w.m, count(*) AS wanted, CAST(count(f.block) AS BIGINT) AS found FROM w LEFT JOIN f ON w.m = f.m AND w.block = f.block GROUP BY w.m""")  # fmt: skip
def model_availability(spark, d):
    rows = T.models(spark, d)
    blocks = rows.groupBy("m").agg(F.lit(1).alias("one")).select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("block"))
    return S.availability(blocks, rows.where("f >= 40 and o >= 40"), ["m", "block"], ["m"])


@query("run_times", "SELECT CAST(d AS TIMESTAMP) + to_hours(h) AS cycle FROM (SELECT unnest(generate_series(DATE '2026-02-25', DATE '2026-03-05', INTERVAL 1 DAY)) AS d), (VALUES (2), (8), (20)) t(h)")
def run_times(spark, d):
    return S.run_times(spark, "2026-02-25", "2026-03-05", [2, 8, 20])


@query("window_extremes", f"SELECT id, CAST(ceil((day - 8000) / 30.0) AS INTEGER) AS \"window\", max(v - 0.5) AS greatest, min(v - 0.5) AS least FROM {T.SERIES} GROUP BY 1, 2")
def window_extremes(spark, d):
    return S.window_extremes(T.series(spark, d).withColumn("lead", _c("day") - 8000), ["id"], "lead", "v", 30, F.lit(-0.5))


@query("rain_accumulated", f"SELECT ok, CASE WHEN count(x) = 3 AND max(CAST(x = 9999 AS INTEGER)) = 0 THEN sum(x) END AS total FROM (SELECT ok, CASE WHEN hydro = 5 THEN 9999 WHEN refl > 45 THEN NULL ELSE refl END AS x FROM {T.MOMENTS} WHERE ln <= 3) GROUP BY ok")
def rain_accumulated(spark, d):
    rows = T.moments(spark, d).where("ln <= 3").select("ok", F.when(_c("hydro") == 5, 9999.0).when(_c("refl") <= 45, _c("refl")).alias("x"))
    return S.accumulated(rows, ["ok"], "x", 3)


@query("equal_steps", f"SELECT id, count(DISTINCT step) AS steps, min(step) AS least FROM (SELECT id, day - lag(day) OVER (PARTITION BY id ORDER BY day) AS step FROM {T.SERIES}) WHERE step IS NOT NULL GROUP BY id")
def equal_steps(spark, d):
    return S.equal_steps(T.series(spark, d), ["id"], "day")


@query("last_rows", f"SELECT ok, ln, refl FROM {T.MOMENTS} QUALIFY row_number() OVER (PARTITION BY ok ORDER BY ln DESC) = 1")
def last_rows(spark, d):
    rows = T.moments(spark, d, in_order=True).select("ok", "ln", "refl", *T.PLACES)  # a line may occur twice: DuckDB's sort keeps the first in the file
    return S.last_rows(rows, ["ok"], ["ln"], T.PLACES).drop(*T.PLACES)


@query("stacked_tables", f"SELECT DISTINCT id, value, NULL::DOUBLE AS v FROM (SELECT id % 50 AS id, value FROM {T.STATIONS}) UNION SELECT DISTINCT id, NULL, v FROM {T.SERIES}")
def stacked_tables(spark, d):
    return S.stacked([T.stations(spark, d).select((_c("id") % 50).alias("id"), "value"), T.series(spark, d).select("id", "v")])


@query("valid_on_both", f"SELECT DISTINCT id FROM {T.STATIONS} WHERE id % 3 <> 0 AND id % 5 <> 0")
def valid_on_both(spark, d):
    s = T.stations(spark, d)
    return S.valid_on_both(s.withColumn("value", F.when(_c("id") % 3 != 0, _c("value"))), s.withColumn("value", F.when(_c("id") % 5 != 0, _c("value"))), "id", "value")


@query("percentiles_as_members", f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY member * 1.5) - 1 AS INTEGER) AS member, round(value, 4) AS value FROM {T.MEMBERS} WHERE member % 9 = 0")
def percentiles_as_members(spark, d):
    rows = T.members(spark, d).where("member % 9 = 0").select("id", (_c("member") * 1.5).alias("percentile"), F.round("value", 4).alias("value"))
    return S.as_members(rows, ["id"])


@query("dense_series", f"SELECT k.id, k.day, coalesce(s.v, -1) AS v FROM (SELECT * FROM (SELECT DISTINCT id FROM {T.SERIES} WHERE id < 5), (SELECT unnest(range(9200, 9300)) AS day)) k LEFT JOIN {T.SERIES} s ON s.id = k.id AND s.day = k.day")
def dense_series(spark, d):
    s = T.series(spark, d)
    dims = s.where("id < 5").select("id").distinct().withColumn("day", F.explode(F.sequence(F.lit(9200).cast("long"), F.lit(9299).cast("long"))))
    return S.dense(s, dims, ["id", "day"], -1.0)


@query("background_grid", "SELECT CAST(y AS INTEGER) AS iy, CAST(x AS INTEGER) AS ix, round(0 + y * 0.5, 4) AS lat, round(70 + x * 0.25, 4) AS lon, 0.0::DOUBLE AS value FROM range(121) a(y), range(281) b(x)")
def background_grid(spark, d):
    return _r(S.background(spark, (70.0, 140.0, 0.25), (0.0, 60.0, 0.5)), "lat", "lon", "value", keep=("iy", "ix"))


@query("padded_cycle", f"""
    WITH k AS (SELECT id, CAST(unnest(range(-6, 31, 3)) AS BIGINT) AS lead FROM (SELECT DISTINCT id FROM {T.SERIES} WHERE id < 6)), s AS (SELECT id, day - 9300 AS lead, v FROM {T.SERIES})
    SELECT k.id, k.lead, coalesce(CASE WHEN k.lead BETWEEN 3 AND 18 THEN s.v END, CASE WHEN k.lead <= 0 THEN s.v + 1 ELSE s.v + 2 END) AS v FROM k LEFT JOIN s ON s.id = k.id AND s.lead = k.lead""")  # fmt: skip
def padded_cycle(spark, d):
    s = T.series(spark, d).where("id < 6").withColumn("lead", _c("day") - 9300).select("id", "lead", "v")
    near = s.where("lead between 3 and 18")
    own = near.unionByName(s.select("id").distinct().select("id", F.lit(3).cast("long").alias("lead"), F.lit(None).cast("double").alias("v")).join(near.select("id", "lead"), ["id", "lead"], "left_anti"))
    return S.padded_cycle(own, s.withColumn("v", _c("v") + 1), s.withColumn("v", _c("v") + 2), ["id"], "lead", "v", -6, 30, 3)


@query("error_means", f"""
    WITH RECURSIVE e AS (SELECT id, day, v - 50 AS e, row_number() OVER (PARTITION BY id ORDER BY day) AS n FROM {T.SERIES} WHERE id < 8 AND day % 11 <> 0 AND day < 9200),
    r AS (SELECT id, day, n, CAST(e AS DOUBLE) AS me FROM e WHERE n = 1 UNION ALL SELECT e.id, e.day, e.n, 0.8 * r.me + 0.2 * e.e FROM r JOIN e ON e.id = r.id AND e.n = r.n + 1)
    SELECT id, day, round(me, 4) AS me FROM r""")  # fmt: skip
def error_means(spark, d):
    pairs = T.series(spark, d).where("id < 8 and day < 9200").select("id", "day", F.when(_c("day") % 11 != 0, _c("v") - 50).alias("e"))
    return _r(S.error_means(pairs, ["id"], "day", "e", 0.2), "me", keep=("id", "day"))


@query("corrected_by_last", f"""
    WITH f AS (SELECT id, day, v FROM {T.SERIES}), m AS (SELECT id, day, v / 10 AS me FROM {T.SERIES} WHERE day % 9 = 0)
    SELECT f.id, f.day, round(f.v - coalesce(m.me, 0), 4) AS v FROM f ASOF LEFT JOIN m ON f.id = m.id AND f.day >= m.day""")  # fmt: skip
def corrected_by_last(spark, d):
    s = T.series(spark, d)
    return _r(S.corrected_by_last(s, s.where("day % 9 = 0").select("id", "day", (_c("v") / 10).alias("me")), ["id"], "day", "v"), "v", keep=("id", "day"))


@query("extrapolated_leads", f"""
    WITH k AS (SELECT id, member * 3 + 3 AS lead, value FROM {T.MEMBERS} WHERE member < 5), p AS (SELECT id, lead, value, lead(lead) OVER w AS l1, lead(value) OVER w AS v1 FROM k WINDOW w AS (PARTITION BY id ORDER BY lead)),
    q AS (SELECT *, unnest([0, 2, 3, 5, 9, 15, 18]) AS q FROM p WHERE l1 IS NOT NULL)
    SELECT id, q AS lead, round(value + (q - lead) * (v1 - value) / (l1 - lead), 4) AS value FROM q WHERE (q > lead AND q <= l1) OR (lead = 3 AND q <= 3) OR (l1 = 15 AND q > 15)""")  # fmt: skip
def extrapolated_leads(spark, d):
    known = T.members(spark, d).where("member < 5").select("id", (_c("member") * 3 + 3).alias("lead"), "value")
    return _r(S.extrapolated_leads(known, ["id"], "lead", "value", [0, 2, 3, 5, 9, 15, 18]), "value", keep=("id", "lead"))


@query("polar_rays", """
    SELECT id, CAST(sweep AS INTEGER) AS sweep, CAST(unnest(range(sweep * 10, sweep * 10 + 5 + sweep)) AS INTEGER) AS ray, 0.5 + sweep AS angle, 8.0 + sweep + id % 3 AS nyquist FROM (SELECT s_suppkey AS id FROM supplier), range(3) r(sweep)""")
def polar_rays(spark, d):
    n = range(3)
    volumes = T.table(spark, d, "supplier").select(
        _c("s_suppkey").alias("id"), F.array(*[F.lit(i * 10) for i in n]).alias("a"), F.array(*[F.lit(i * 10 + 4 + i) for i in n]).alias("b"), F.array(*[F.lit(0.5 + i) for i in n]).alias("e"), F.array(*[8.0 + i + _c("s_suppkey") % 3 for i in n]).alias("q")
    )
    return S.sweeps(volumes, ["id"], "a", "b", "e", "q")


# --- neighbourhoods
def _circle_sql(radius: int, weighted: bool) -> str:
    offsets = ", ".join(f"({y}, {x}, {w!r})" for y, x, w in N.kernel(radius, weighted))
    return f"SELECT g.iy, g.ix, round(sum(o.w * n.v) / sum(o.w), 4) AS mean FROM {T.GRID} g, (VALUES {offsets}) o(dy, dx, w), {T.GRID} n WHERE n.iy = g.iy + o.dy AND n.ix = g.ix + o.dx GROUP BY 1, 2"


@query("circle_mean", _circle_sql(3, False))
def circle_mean(spark, d):
    return _r(N.circle_mean(T.grid(spark, d), [], 3, "v"), "mean", keep=("iy", "ix"))


@query("weighted_circle_mean", _circle_sql(4, True))
def weighted_circle_mean(spark, d):
    return _r(N.circle_mean(T.grid(spark, d), [], 4, "v", weighted=True), "mean", keep=("iy", "ix"))


_BANDS = f"(SELECT CAST(b AS INTEGER) AS band, iy, ix, CAST(z >= b * 60 AND z < b * 60 + 80 AS INTEGER) AS m, greatest(0.0, 1 - abs(z - b * 60 - 40) / 80) AS w FROM {T.GRID}, range(3) r(b))"
_MASKED = f"""(SELECT a.band, a.iy, a.ix, avg(CASE WHEN b.m > 0 THEN g.v END) AS mean FROM {_BANDS} a JOIN {_BANDS} b ON a.band = b.band AND abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 2
    JOIN {T.GRID} g ON g.iy = b.iy AND g.ix = b.ix WHERE a.m > 0 GROUP BY 1, 2, 3)"""


def _bands(spark, d):
    b = F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = T.grid(spark, d).select("iy", "ix", "z", b.alias("band"))
    inside = (_c("z") >= _c("band") * 60) & (_c("z") < _c("band") * 60 + 80)
    return rows.select("band", "iy", "ix", inside.cast("int").alias("m"), F.greatest(F.lit(0.0), 1 - F.abs(_c("z") - _c("band") * 60 - 40) / 80).alias("w"))


@query("masked_means", f"SELECT band, iy, ix, round(mean, 4) AS mean FROM {_BANDS} LEFT JOIN {_MASKED} USING (band, iy, ix)")
def masked_means(spark, d):
    return _r(N.masked_mean(T.grid(spark, d), _bands(spark, d), [], 2, "v"), "mean", keep=("band", "iy", "ix"))


@query("collapsed_layers", f"SELECT iy, ix, round(sum(w * mean) / CASE WHEN sum(w) <> 0 THEN sum(w) END, 4) AS mean FROM {_MASKED} JOIN {_BANDS} USING (band, iy, ix) WHERE mean IS NOT NULL GROUP BY 1, 2")
def collapsed_layers(spark, d):
    bands = _bands(spark, d)
    layers = N.collapsed_layers(N.masked_mean(T.grid(spark, d), bands, [], 2, "v"), bands.select("band", "iy", "ix", "w"), [])
    # means of few whole numbers end in a 5 often: rounded as SQL does it, by the double that is 10^4 times as large, not by the shortest decimal
    return layers.select("iy", "ix", (F.round(_c("mean") * 10000.0) / 10000.0).alias("mean"))


@query("circular_means", f"SELECT ok, round(((degrees(atan2(y, x)) % 360) + 360) % 360, 3) AS direction, round(sqrt(x * x + y * y), 4) AS length FROM (SELECT ok, avg(cos(radians(refl * 7))) AS x, avg(sin(radians(refl * 7))) AS y FROM {T.MOMENTS} GROUP BY ok) WHERE x * x + y * y > 0.01")
def circular_means(spark, d):
    out = N.circular_mean(T.moments(spark, d).withColumn("deg", _c("refl") * 7), ["ok"], "deg").where("length > 0.1")
    return out.select("ok", F.round("direction", 3).alias("direction"), F.round("length", 4).alias("length"))


_LEADS = [(6, 1), (12, 2), (24, 4)]


@query("lead_box_means", " UNION ALL ".join(f"SELECT {h} AS lead, iy, ix, round((SELECT avg(n.v + {h}) FROM {T.GRID} n WHERE abs(n.iy - g.iy) <= {r} AND abs(n.ix - g.ix) <= {r}), 4) AS mean FROM {T.GRID} g" for h, r in _LEADS))
def lead_box_means(spark, d):
    g = T.grid(spark, d).withColumn("lead", F.explode(F.array(*[F.lit(h) for h, _ in _LEADS]))).withColumn("v", _c("v") + _c("lead"))
    return _r(N.lead_box_mean(g, [], "lead", _LEADS, "v"), "mean", keep=("lead", "iy", "ix"))


@query("axis_spacing", f"SELECT min(step) AS least, max(step) AS greatest, max(step) - min(step) <= 1e-6 AS equal FROM (SELECT ix * 0.25 - lag(ix * 0.25) OVER (ORDER BY ix) AS step FROM (SELECT DISTINCT ix FROM {T.GRID})) WHERE step IS NOT NULL")
def axis_spacing(spark, d):
    return N.spacing(T.grid(spark, d).select((_c("ix") * 0.25).alias("lon")), "lon")


@query("regridded", f"""
    WITH t AS (SELECT y AS ty, x AS tx, least(greatest(-0.5 + y * 0.6, 0), 19) AS fy, least(greatest(1.0 + x * 0.75, 0), 19) AS fx FROM range(35) a(y), range(25) b(x)),
    f AS (SELECT *, least(floor(fy), 18) AS y0, least(floor(fx), 18) AS x0 FROM t)
    SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round(sum(g.v * (1 - abs(fy - g.iy)) * (1 - abs(fx - g.ix))), 4) AS v FROM f JOIN {T.GRID} g ON g.iy IN (y0, y0 + 1) AND g.ix IN (x0, x0 + 1) GROUP BY 1, 2""")  # fmt: skip
def regridded(spark, d):
    return _r(N.regridded(T.grid(spark, d), [], "v", (20, 20), (-0.5, 0.6, 35), (1.0, 0.75, 25)), "v", keep=("ty", "tx"))


@query("projected_nearest", f"""
    WITH s AS (SELECT id, sx * 900.0 AS x, sy * 1100.0 AS y, value FROM {T.STATIONS}), t AS (SELECT iy * 100 + ix AS id, ix * 1000.0 AS x, iy * 1000.0 AS y FROM {T.GRID}),
    n AS (SELECT t.id, s.value, sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2)) AS d FROM t JOIN s ON abs(s.x - t.x) <= 2500 AND abs(s.y - t.y) <= 2500 WHERE d <= 2500 QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY d, s.x, s.y) <= 3)
    SELECT id, round(coalesce(max(CASE WHEN d < 1e-3 THEN value END), sum(value / power(greatest(d, 1e-3), 2)) / sum(1 / power(greatest(d, 1e-3), 2))), 4) AS value FROM n GROUP BY id""")  # fmt: skip
def projected_nearest(spark, d):
    source = T.stations(spark, d).select(_c("id").alias("point"), (_c("sx") * 900.0).alias("x"), (_c("sy") * 1100.0).alias("y"), "value")
    target = T.grid(spark, d).select((_c("iy") * 100 + _c("ix")).alias("id"), (_c("ix") * 1000.0).alias("x"), (_c("iy") * 1000.0).alias("y"))
    return _r(N.nearest_weighted(source, target, 3, 2500.0), "value", keep=("id",))


@query("gates_on_grid", f"""
    WITH g AS (SELECT 100 + ok % 313 * 0.013 AS lon, 30 + ok % 217 * 0.017 AS lat, refl AS value FROM {T.MOMENTS}), p AS (SELECT *, CAST(round((lat - 30) / 0.25) AS INTEGER) AS iy, CAST(round((lon - 100) / 0.25) AS INTEGER) AS ix FROM g)
    SELECT iy, ix, arg_min(value, (round(power(lat - 30 - iy * 0.25, 2) + power(lon - 100 - ix * 0.25, 2), 12), value)) AS value FROM p GROUP BY 1, 2""")  # fmt: skip
def gates_on_grid(spark, d):
    gates = T.moments(spark, d).select((100 + _c("ok") % 313 * 0.013).alias("lon"), (30 + _c("ok") % 217 * 0.017).alias("lat"), _c("refl").alias("value"))
    return N.gates_on_grid(gates, 0.25, 100.0, 30.0)


@query("terrain_gradient", f"""
    WITH s AS (SELECT iy, ix, (lead(z) OVER w - z) / 1000 AS up, (z - lag(z) OVER w) / 1000 AS down FROM {T.GRID} WINDOW w AS (PARTITION BY iy ORDER BY ix)),
    t AS (SELECT *, lead(up) OVER w AS up2, lag(down) OVER w AS down2 FROM s WINDOW w AS (PARTITION BY iy ORDER BY ix))
    SELECT iy, ix, round(CASE WHEN down IS NULL THEN 1.5 * up - 0.5 * coalesce(up2, up) WHEN up IS NULL THEN 1.5 * down - 0.5 * coalesce(down2, down) ELSE (up + down) / 2 END, 6) AS gradient FROM t""")  # fmt: skip
def terrain_gradient(spark, d):
    return N.gradient_recentred(T.grid(spark, d), [], "z", "ix", "iy", 1000.0).select("iy", "ix", F.round("gradient", 6).alias("gradient"))


@query("dilated_mask", f"SELECT g.iy, g.ix, bool_or(n.v > 45) AS dilated FROM {T.GRID} g JOIN {T.GRID} n ON abs(n.iy - g.iy) <= 1 AND abs(n.ix - g.ix) <= 1 GROUP BY 1, 2")
def dilated_mask(spark, d):
    return N.dilated(T.grid(spark, d).withColumn("m", _c("v") > 45), [], "m", 1).select("iy", "ix", "dilated")


@query("window_correlation", f"""
    SELECT g.iy, g.ix, round(CASE WHEN count(*) * sum(n.v * n.v) - sum(n.v) * sum(n.v) > 1e-9 AND count(*) * sum(n.z * n.z) - sum(n.z) * sum(n.z) > 1e-9 THEN corr(n.v, n.z) END, 4) AS corr
    FROM {T.GRID} g JOIN {T.GRID} n ON abs(n.iy - g.iy) <= 2 AND abs(n.ix - g.ix) <= 2 GROUP BY 1, 2""")  # fmt: skip
def window_correlation(spark, d):
    return _r(N.window_correlation(T.grid(spark, d), [], "v", "z", 2), "corr", keep=("iy", "ix"))


@query("storm_cells", f"""
    WITH l AS (SELECT (iy // 4) * 5 + ix // 4 + 1 AS label, iy, ix, v FROM {T.GRID} WHERE v > 30)
    SELECT CAST(label AS INTEGER) AS label, count(*) AS cells, max(v) AS peak, arg_max(iy, (v, -iy, -ix)) AS peak_y, arg_max(ix, (v, -iy, -ix)) AS peak_x, round(sum(iy * v) / sum(v), 4) AS centre_y, round(sum(ix * v) / sum(v), 4) AS centre_x
    FROM l GROUP BY label HAVING count(*) >= 5 AND max(v) >= 40""")  # fmt: skip
def storm_cells(spark, d):
    label = (F.floor(_c("iy") / 4) * 5 + F.floor(_c("ix") / 4) + 1).cast("int")
    cells = N.storm_cells(T.grid(spark, d).where("v > 30").withColumn("label", label), [], "label", "v", 5, 40.0)
    return _r(cells, "centre_y", "centre_x", keep=("label", "cells", "peak", "peak_y", "peak_x"))


@query("local_peaks", f"SELECT g.iy, g.ix, g.v FROM {T.GRID} g JOIN {T.GRID} n ON abs(n.iy - g.iy) <= 2 AND abs(n.ix - g.ix) <= 2 GROUP BY 1, 2, 3 HAVING g.v = max(n.v) AND g.v >= 35")
def local_peaks(spark, d):
    return N.local_peaks(T.grid(spark, d), [], "v", 2, 35.0).select("iy", "ix", "v")


# --- data sets
def _station_rows(spark, d):
    ts = F.make_timestamp(F.lit(2026), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(days=(_c("day") % 400).cast("int"))
    return T.series(spark, d).select("id", ts.alias("time"), (_c("id") % 3 * 24).cast("int").alias("dtime"), _c("v").alias("value"))


_ROWS = f"(SELECT id, TIMESTAMP '2026-01-01' + to_days(CAST(day % 400 AS INTEGER)) AS time, CAST(id % 3 * 24 AS INTEGER) AS dtime, v AS value FROM {T.SERIES})"
_SOURCES = f"""(SELECT time + to_hours(dtime) AS valid, id % 5 AS id, NULL::INTEGER AS dtime, 'ob' AS source, value FROM {_ROWS} WHERE id < 10
    UNION ALL SELECT time + to_hours(dtime), id % 5, dtime, 'm1', value FROM {_ROWS} WHERE id BETWEEN 10 AND 24 UNION ALL SELECT time + to_hours(dtime + 24), id % 5, dtime, 'm2', 2 * value FROM {_ROWS} WHERE id >= 25)"""


def _sources(spark, d):
    rows = _station_rows(spark, d)
    part = lambda cond: rows.where(cond).withColumn("id", _c("id") % 5)
    return part("id < 10"), {"m1": part("id between 10 and 24"), "m2": part("id >= 25")}, {"m2": 24}, {"m2": lambda c: 2 * c}


@query("combined_outer", f"SELECT valid, id, max(value) FILTER (source = 'ob') AS ob, max(value) FILTER (source = 'm1') AS m1, max(value) FILTER (source = 'm2') AS m2 FROM {_SOURCES} GROUP BY 1, 2")
def combined_outer(spark, d):
    observed, models, shift, operations = _sources(spark, d)
    return DS.combined(observed, models, "valid", "outer", shift, operations)


@query("combined_inner", f"SELECT valid, id, max(value) FILTER (source = 'ob') AS ob, max(value) FILTER (source = 'm1') AS m1, max(value) FILTER (source = 'm2') AS m2 FROM {_SOURCES} GROUP BY 1, 2 HAVING ob IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL")
def combined_inner(spark, d):
    observed, models, shift, operations = _sources(spark, d)
    return DS.combined(observed, models, "valid", "inner", shift, operations)


@query("combined_by_lead", f"""
    SELECT valid, id, dtime, o.ob, m1, m2 FROM (SELECT valid, id, dtime, max(value) FILTER (source = 'm1') AS m1, max(value) FILTER (source = 'm2') AS m2 FROM {_SOURCES} WHERE source <> 'ob' GROUP BY 1, 2, 3)
    JOIN (SELECT valid, id, max(value) AS ob FROM {_SOURCES} WHERE source = 'ob' GROUP BY 1, 2) o USING (valid, id)""")  # fmt: skip
def combined_by_lead(spark, d):
    observed, models, shift, operations = _sources(spark, d)
    return DS.combined(observed, models, "issue", "left", shift, operations)


@query("blend_by_function", f"SELECT block, round(sum(exp(-abs(o - 25) / 10) * f) / sum(exp(-abs(o - 25) / 10)), 4) AS blend FROM {T.MODELS} GROUP BY block")
def blend_by_function(spark, d):
    return _r(DS.weighted(T.models(spark, d), ["block"], "f", "o", lambda s: F.exp(-F.abs(s - 25) / 10)), "blend", keep=("block",))


@query("land_lapse_rate", f"""
    WITH g AS (SELECT iy, ix, v, z, CAST((iy + ix) % 4 > 0 AS INTEGER) AS land FROM {T.GRID}),
    s AS (SELECT a.iy, a.ix, CASE WHEN var_pop(b.z) > 1e-9 THEN regr_slope(b.v, b.z) END AS slope FROM g a JOIN g b ON abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 2 AND abs(a.z - b.z) <= 50 WHERE a.land = 1 AND b.land = 1 GROUP BY 1, 2)
    SELECT g.iy, g.ix, round(coalesce(s.slope, -0.0065), 4) AS slope FROM g LEFT JOIN s USING (iy, ix)""")  # fmt: skip
def land_lapse_rate(spark, d):
    g = T.grid(spark, d).withColumn("land", ((_c("iy") + _c("ix")) % 4 > 0).cast("int"))
    return _r(R.local_slope(g, 2, "v", "z", 50.0, -0.0065, land="land"), "slope", keep=("iy", "ix"))


# --- stations on the sphere
_SPOTS = f"(SELECT id, 100 + sx * 2 AS lon, 20 + sy * 1.5 AS lat, sx AS fx, sy AS fy, value FROM {T.STATIONS})"
_CELLS = f"(SELECT iy * 100 + ix AS id, iy, ix, 100 + ix * 2.0 AS lon, 20 + iy * 1.5 AS lat, v FROM {T.GRID})"
_CHORD = "sqrt(power(6371 * (cos(radians(s.lat)) * cos(radians(s.lon)) - cos(radians(c.lat)) * cos(radians(c.lon))), 2) + power(6371 * (cos(radians(s.lat)) * sin(radians(s.lon)) - cos(radians(c.lat)) * sin(radians(c.lon))), 2) + power(6371 * (sin(radians(s.lat)) - sin(radians(c.lat))), 2))"
_RESIDUALS = f"""(SELECT s.id, any_value(s.lon) AS lon, any_value(s.lat) AS lat, any_value(s.value) - sum(g.v * (1 - abs(s.fy - g.iy)) * (1 - abs(s.fx - g.ix))) AS value
    FROM {_SPOTS} s JOIN {T.GRID} g ON abs(s.fy - g.iy) < 1 AND abs(s.fx - g.ix) < 1 GROUP BY s.id HAVING abs(sum((1 - abs(s.fy - g.iy)) * (1 - abs(s.fx - g.ix))) - 1) < 1e-9)"""


def _near_sql(source: str, k: int) -> str:
    return f"SELECT c.id, s.value, {_CHORD} AS d FROM {_CELLS} c, {source} s QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY d, s.id) <= {k}"


def _spots(spark, d):
    return T.stations(spark, d).select("id", (100 + _c("sx") * 2).alias("lon"), (20 + _c("sy") * 1.5).alias("lat"), _c("sx").alias("fx"), _c("sy").alias("fy"), "value")


def _sphere_cells(spark, d):
    return T.grid(spark, d).select((_c("iy") * 100 + _c("ix")).alias("id"), (100 + _c("ix") * 2.0).alias("lon"), (20 + _c("iy") * 1.5).alias("lat"), "v")


@query("sphere_idw", f"WITH n AS ({_near_sql(_SPOTS, 5)}) SELECT id, round(CASE WHEN min(d) + 1e-6 <= 300 THEN sum(value / power(d + 1e-6, 2)) / sum(1 / power(d + 1e-6, 2)) ELSE 0 END, 3) AS value FROM n GROUP BY id")
def sphere_idw(spark, d):
    out = N.sphere_analysis(_spots(spark, d), _sphere_cells(spark, d), 5, 300.0)
    return out.select("id", F.round("value", 3).alias("value"))


@query("sphere_idw_delta", f"WITH n AS ({_near_sql(_RESIDUALS, 4)}) SELECT c.id, round(any_value(c.v) + sum(value * exp(-power((d + 1e-6) / 500, 2)) / power(d + 1e-6, 2)) / sum(1 / power(d + 1e-6, 2)), 3) AS value FROM n JOIN {_CELLS} c USING (id) GROUP BY c.id")
def sphere_idw_delta(spark, d):
    left = N.residuals(_spots(spark, d), T.grid(spark, d), "v")
    return N.sphere_analysis(left, _sphere_cells(spark, d), 4, 500.0, background="v").select("id", F.round("value", 3).alias("value"))


@query("sphere_gaussian_delta", f"WITH n AS ({_near_sql(_RESIDUALS, 1)}) SELECT c.id, round(c.v + CASE WHEN d <= 400 THEN exp(-power(d / 400, 2)) * value ELSE 0 END, 3) AS value FROM n JOIN {_CELLS} c USING (id)")
def sphere_gaussian_delta(spark, d):
    left = N.residuals(_spots(spark, d), T.grid(spark, d), "v")
    return N.sphere_analysis(left, _sphere_cells(spark, d), 1, 400.0, background="v").select("id", F.round("value", 3).alias("value"))


# --- fields that grow with the tables
def _near(radius: int) -> str:
    return f"(SELECT a.iy + dy AS iy, a.ix + dx AS ix, a.v, a.z FROM {T.WIDE} a, (VALUES {', '.join(f'({y}, {x})' for y in range(-radius, radius + 1) for x in range(-radius, radius + 1))}) o(dy, dx))"


@query("wide_box_mean", f"SELECT g.iy, g.ix, round(avg(n.v), 4) AS box FROM {T.WIDE} g JOIN {_near(2)} n USING (iy, ix) GROUP BY 1, 2")
def wide_box_mean(spark, d):
    return _r(R.box_mean(T.wide(spark, d), [], 2, "v"), "box", keep=("iy", "ix"))


@query("wide_circle_mean", f"SELECT g.iy, g.ix, round(avg(n.v), 4) AS mean FROM {T.WIDE} g JOIN (SELECT a.iy + dy AS iy, a.ix + dx AS ix, a.v FROM {T.WIDE} a, (VALUES {', '.join(f'({y}, {x})' for y, x, _ in N.kernel(3, False))}) o(dy, dx)) n USING (iy, ix) GROUP BY 1, 2")
def wide_circle_mean(spark, d):
    return _r(N.circle_mean(T.wide(spark, d).select("iy", "ix", "v"), [], 3, "v"), "mean", keep=("iy", "ix"))


@query("wide_dilated", f"SELECT g.iy, g.ix, coalesce(bool_or(n.v > 48), false) AS dilated FROM {T.WIDE} g JOIN {_near(1)} n USING (iy, ix) GROUP BY 1, 2")
def wide_dilated(spark, d):
    return N.dilated(T.wide(spark, d).withColumn("m", F.coalesce(_c("v") > 48, F.lit(False))), [], "m", 1).select("iy", "ix", "dilated")


@query("wide_correlation", f"""
    SELECT g.iy, g.ix, round(CASE WHEN count(n.v) * sum(n.v * n.v) - sum(n.v) * sum(n.v) > 1e-9 AND count(n.v) * sum(n.z * n.z) - sum(n.z) * sum(n.z) > 1e-9 THEN corr(n.v, n.z) END, 4) + 0 AS corr
    FROM {T.WIDE} g JOIN {_near(2)} n USING (iy, ix) GROUP BY 1, 2""")  # fmt: skip
def wide_correlation(spark, d):
    return N.window_correlation(T.wide(spark, d), [], "v", "z", 2).select("iy", "ix", (F.round("corr", 4) + 0).alias("corr"))


@query("wide_peaks", f"SELECT g.iy, g.ix, g.v FROM {T.WIDE} g JOIN {_near(2)} n USING (iy, ix) GROUP BY 1, 2, 3 HAVING g.v = max(n.v) AND g.v >= 49")
def wide_peaks(spark, d):
    return N.local_peaks(T.wide(spark, d), [], "v", 2, 49.0).select("iy", "ix", "v")


# --- phenomena
@query("decoded_codes", f"""
    WITH c AS ({_codes_sql()}), n AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in P.NAMES.items())}) t(code, name))
    SELECT c.cell, c.logic, a.name AS a_name, b.name AS b_name, CASE c.logic WHEN 0 THEN a.name ELSE a.name || ['转', '间', '伴有'][c.logic] || b.name END AS phrase FROM c JOIN n a ON a.code = c.a JOIN n b ON b.code = c.b""")  # fmt: skip
def decoded_codes(spark, d):
    return P.code_weather(T.weather_steps(spark, d), ["cell"]).select("cell", P.decoded(_c("code").cast("int")).alias("x")).select("cell", "x.logic", "x.a_name", "x.b_name", "x.phrase")


@query("codes_of_cloud_fractions", _codes_sql())
def codes_of_cloud_fractions(spark, d):
    return P.code_weather(T.weather_steps(spark, d).withColumn("tcc", _c("tcc") / 100), ["cell"], cloud_unit="auto")


@query("segment_leads", "SELECT CAST(s AS INTEGER) AS segment, CAST((s - 1) * 12 + k AS INTEGER) AS lead FROM range(1, 21) a(s), (VALUES (3), (6), (9), (12)) b(k)")
def segment_leads(spark, d):
    return spark.range(1, 21).select(_c("id").cast("int").alias("segment")).select("segment", F.explode(Q.segment_leads(_c("segment"))).alias("lead"))


# --- times and text
@query("time_parts", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day, strftime(o_orderdate, '%H') AS hour FROM orders")
def time_parts(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", *Q.time_parts(F.date_format("o_orderdate", "yyyyMMddHH")))


@query("chunked_lists", "SELECT k, CAST((n - 1) // 4 AS INTEGER) AS chunk, list(x ORDER BY n) AS x FROM (SELECT p_size AS k, CAST(p_partkey AS VARCHAR) AS x, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part) GROUP BY 1, 2")
def chunked_lists(spark, d):
    rows = T.table(spark, d, "part").select(_c("p_size").alias("k"), "p_partkey", _c("p_partkey").alias("x"))
    return S.chunked_rows(rows, ["k"], "p_partkey", 4, "x")


@query("parsed_times", "SELECT o_orderkey, CAST(date_trunc('hour', o_orderdate) AS TIMESTAMP) AS t FROM orders")
def parsed_times(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", C.parsed_time(F.date_format("o_orderdate", "yyyy-MM-dd HH")).alias("t"))


@query("grid_text_back", f"SELECT iy, ix, 30 + iy * 0.5 AS lat, 100 + ix * 0.25 AS lon, round(v, 4) AS value FROM {T.GRID}")
def grid_text_back(spark, d):
    path = scratch_path(spark, "grid-text")
    cells = T.grid(spark, d).select("iy", "ix", (30 + _c("iy") * 0.5).alias("lat"), (100 + _c("ix") * 0.25).alias("lon"), _c("v").alias("value"))
    micaps.write_grid(cells, path, "test", datetime(2026, 3, 1), 24, 850)
    return micaps.ascending(micaps.read_grid(spark, path)).select("iy", "ix", "lat", "lon", "value")


@query("netcdf_back", f"SELECT CAST(z % 3 AS DOUBLE) AS member, CAST(iy AS DOUBLE) AS lat, CAST(ix AS DOUBLE) AS lon, CAST(CAST(v AS FLOAT) AS DOUBLE) AS value FROM {T.GRID}")
def netcdf_back(spark, d):
    folder = scratch_path(spark, "netcdf")
    cells = T.grid(spark, d).select((_c("z") % 3).cast("int").alias("k"), (_c("z") % 3).alias("member"), _c("iy").alias("lat"), _c("ix").alias("lon"), _c("v").alias("value"))
    netcdf.write(cells, folder.removeprefix("file:"), ["k"], ["member", "lat", "lon"], attributes={"units": "1"}).collect()  # a row a file
    return netcdf.read(spark, folder, "data0", ["member", "lat", "lon"]).where("value is not null").drop("file")


@query("station_text_back", f"SELECT CAST(id AS BIGINT) AS id, sx AS lon, sy AS lat, value FROM {T.STATIONS} WHERE sx >= 2 AND sx < 18 AND sy >= 2 AND sy < 18 AND value >= 5")
def station_text_back(spark, d):
    path = scratch_path(spark, "station-text")
    rows = T.stations(spark, d).select("id", _c("sx").alias("lon"), _c("sy").alias("lat"), F.lit(0.0).alias("alt"), "value")
    micaps.write_stations(rows, path, "test", box=(2, 18, 2, 18), least=5)
    return micaps.read_stations(spark, path).select("id", "lon", "lat", "value")


@query("station_list_back", f"SELECT CAST(id AS VARCHAR) AS id, sx AS lon, sy AS lat, value FROM {T.STATIONS}")
def station_list_back(spark, d):
    path = scratch_path(spark, "station-list")
    line = F.concat_ws(" ", "id", "sx", "sy", "value")
    T.stations(spark, d).select(F.explode(F.array(line, F.concat(line, F.lit(" x")), F.lit("a b"))).alias("value")).where("value not like '% x'").write.text(path)
    return micaps.station_list(spark, path, "data").select("id", "lon", "lat", "value")


@query("grid_headers", "SELECT p_partkey, 2020 + p_size % 6 AS year, p_size AS lead, 850.0 AS level, 0.25 AS dlon, 281 AS nlon FROM part")
def grid_headers(spark, d):
    line = F.format_string("diamond 4 part %02d 3 1 0 %d 850 0.25 0.25 70 140 0 60 281 241 1 0", 20 + _c("p_size") % 6, _c("p_size"))
    rows = T.table(spark, d, "part").select("p_partkey", micaps.header(line).alias("h"))
    return rows.select("p_partkey", F.year("h.issue").alias("year"), "h.lead", "h.level", "h.dlon", "h.nlon")


@query("newest_cycles", "SELECT strftime(o_orderdate, '%Y%m%d') || '0000' AS cycle, CAST(o_orderkey % 40 AS INTEGER) AS lead FROM orders WHERE strftime(o_orderdate, '%Y%m%d') = (SELECT max(strftime(o_orderdate, '%Y%m%d')) FROM orders)")
def newest_cycles(spark, d):
    names = T.table(spark, d, "orders").select(F.format_string("/in/%s0000.%03d.nc", F.date_format("o_orderdate", "yyyyMMdd"), _c("o_orderkey") % 40).alias("path"))
    return L.newest(L.cycles(names), minutes=[0, 30]).select(F.date_format("cycle", "yyyyMMddHHmm").alias("cycle"), "lead")


@query("leads_lacking", f"SELECT id, lead FROM (SELECT DISTINCT id, unnest(range(9200, 9300)) AS lead FROM {T.SERIES}) EXCEPT SELECT id, day FROM {T.SERIES}")
def leads_lacking(spark, d):
    s = T.series(spark, d).withColumnRenamed("day", "lead")
    return L.lacking(s, ["id"], "lead", list(range(9200, 9300)))


@query("segment_fields", """
    WITH k AS (SELECT v, CAST(l AS BIGINT) AS lead FROM (VALUES ('R03'), ('TCC'), ('FOG')) a(v), (VALUES (63), (66), (69), (72), (75), (78)) b(l)),
    s AS (SELECT CASE p_size % 3 WHEN 0 THEN 'R03' WHEN 1 THEN 'TCC' ELSE 'FOG' END AS v, CAST(60 + p_size AS BIGINT) AS lead, max(p_retailprice) AS value FROM part GROUP BY 1, 2)
    SELECT k.v, k.lead, round(CASE WHEN k.v = 'FOG' AND k.lead > 72 THEN 0 ELSE coalesce(s.value, CASE WHEN k.v = 'FOG' THEN 0 END) END, 4) AS value FROM k LEFT JOIN s ON s.v = k.v AND s.lead = k.lead""")  # fmt: skip
def segment_fields(spark, d):
    name = F.when(_c("p_size") % 3 == 0, "R03").when(_c("p_size") % 3 == 1, "TCC").otherwise("FOG")
    found = T.table(spark, d, "part").groupBy(name.alias("v"), (60 + _c("p_size")).cast("long").alias("lead")).agg(F.max("p_retailprice").alias("value"))
    return _r(L.segment_fields(found, {"R03": 240, "TCC": 240, "FOG": 72}, [63, 66, 69, 72, 75, 78]), "value", keep=("v", "lead"))


@query("states_saved", f"SELECT id, max(day) AS issue, round(arg_max(v, day), 4) AS score FROM {T.SERIES} WHERE day < 9400 GROUP BY id")
def states_saved(spark, d):
    path = scratch_path(spark, "states")
    s = T.series(spark, d).select("id", _c("day").alias("issue"), _c("v").alias("score"))
    L.save_states(s.where("issue < 9300"), path, "issue")
    L.save_states(s.where("issue between 9250 and 9500"), path, "issue")
    return _r(L.latest_states(spark, path, ["id"], "issue", 9400), "score", keep=("id", "issue"))
