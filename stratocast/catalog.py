"""All registered queries of the library proper and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratocast.functions import weather as W
from stratocast.operators import fields as K
from stratocast.operators import phenomena as P
from stratocast.operators import relational as R
from stratocast.plans import projections as T

FLAGSHIP = "phenomenon_codes"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and its SQL."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def scalar(name: str, column, sql: str) -> None:
    """A scalar function over every line item, rounded to 4 places."""
    query(name, f"SELECT ok, ln, round({sql}, 4) AS v FROM {T.MOMENTS}")(lambda spark, d: T.moments(spark, d).select("ok", "ln", F.round(column(), 4).alias("v")))


_c = F.col
SVP = (
    "power(10, CASE WHEN {k} > 273.16 THEN 10.79574 * (1 - 273.16 / {k}) - 5.028 * log10({k} / 273.16) + 1.50475e-4 * (1 - power(10, -8.2969 * ({k} / 273.16 - 1)))"
    " + 0.42873e-3 * (power(10, 4.76955 * (1 - 273.16 / {k})) - 1) + 0.78614 ELSE -9.09685 * (273.16 / {k} - 1) - 3.56654 * log10(273.16 / {k}) + 0.87682 * (1 - {k} / 273.16) + 0.78614 END)"
)
CHILL = "(13.12 + 0.6215 * t - 11.37 * power(greatest({v}, 4.824), 0.16) + 0.3965 * t * power(greatest({v}, 4.824), 0.16))"
AIR = f"(100 * {SVP.format(k='(t + 273.15)')} * (1 + 1e-8 * 101325 * (4.5 + 6e-4 * t * t)))"
APPARENT = f"(-2.7 + 1.04 * t + 2.0 * (0.001 * {AIR} * rh) - 0.65 * w)"
Z = "(0.0376 * power(power(10, 0.1 * refl), 0.6112))"
A = "(250.0 * power(att, 0.91))"
KDP = "(29.70 * power(greatest(kdp, 0), 0.85))"
_p = lambda: F.lit(101325.0)
scalar("wind_chill", lambda: W.wind_chill(_c("t"), _c("w")), CHILL.format(v="w"))
scalar("vapour_pressure", lambda: W.vapour_pressure_goff_gratch(_c("t") + 273.15), SVP.format(k="(t + 273.15)"))
scalar("vapour_pressure_in_air", lambda: W.vapour_pressure_in_air(_c("t") + 273.15, _p()), AIR)
scalar("relative_humidity", lambda: W.relative_humidity(_c("t") + 273.15, _c("t") + 273.15 - _c("w")), f"100 * {SVP.format(k='(t + 273.15 - w)')} / {SVP.format(k='(t + 273.15)')}")
scalar("apparent_temperature", lambda: W.apparent_temperature(_c("t"), _c("w"), _c("rh"), _p()), APPARENT)
scalar("feels_like", lambda: W.feels_like(_c("t"), _c("w"), _c("rh"), _p()), f"CASE WHEN t < 10 THEN {CHILL.format(v='w * 3.6')} WHEN t > 20 THEN {APPARENT} ELSE (t - 10) / 10 * {APPARENT} + (1 - (t - 10) / 10) * {CHILL.format(v='w * 3.6')} END")
scalar("wind_speed", lambda: W.wind_speed(_c("t"), _c("w")), "sqrt(t * t + w * w)")
scalar("wind_direction", lambda: W.wind_direction(_c("t"), _c("w")), "((270 - degrees(atan2(w, t))) % 360 + 360) % 360")
scalar("wind_u", lambda: W.wind_components(_c("refl") * 7, _c("w"))[0], "-w * sin(radians(refl * 7))")
scalar("wind_v", lambda: W.wind_components(_c("refl") * 7, _c("w"))[1], "-w * cos(radians(refl * 7))")
scalar("rain_z", lambda: W.rain_from_reflectivity(_c("refl")), Z)
scalar("rain_z_mp", lambda: W.rain_from_marshall_palmer(_c("refl")), "power(power(10, 0.1 * refl) / 200, 1 / 1.6)")
scalar("rain_zpoly", lambda: W.rain_from_polynomial(_c("refl")), "power(10, -2.3 + 0.17 * refl - 5.1e-3 * refl * refl + 9.8e-5 * refl * refl * refl - 6e-7 * refl * refl * refl * refl)")
scalar("rain_kdp", lambda: W.rain_from_kdp(_c("kdp")), KDP)
scalar("rain_a", lambda: W.rain_from_attenuation(_c("att")), A)
scalar("rain_zkdp", lambda: W.rain_switched(W.rain_from_reflectivity(_c("refl")), W.rain_from_kdp(_c("kdp")), 10.0), f"CASE WHEN {Z} > 10 THEN {KDP} ELSE {Z} END")
scalar("rain_za", lambda: W.rain_switched(W.rain_from_attenuation(_c("att")), W.rain_from_reflectivity(_c("refl")), 0.04, above=False), f"CASE WHEN {A} < 0.04 THEN {Z} ELSE {A} END")
scalar(
    "rain_hydro",
    lambda: W.rain_by_class(_c("refl"), _c("att"), _c("hydro")),
    f"CASE WHEN hydro IN (1, 2, 4, 6, 9) THEN 0.1 * power(power(10, 0.1 * refl), 0.5) WHEN hydro IN (3, 5) THEN CASE WHEN {A} < 0.04 THEN {Z} ELSE {A} END WHEN hydro IN (7, 8) THEN 0.6 * {Z} END",
)
scalar("lapse_adjusted", lambda: W.lapse_adjusted(_c("t"), -_c("att"), _c("refl") * 4 - 90), "t + -att * greatest(least(refl * 4 - 90, 50), -50) + -0.0065 * (refl * 4 - 90 - greatest(least(refl * 4 - 90, 50), -50))")
scalar("db_transform", lambda: W.db_transform(_c("att"), 0.03), "CASE WHEN att < 0.03 THEN -15 ELSE 10 * log10(greatest(att, 1e-9)) END")
scalar("db_inverse", lambda: W.db_inverse(_c("t")), "CASE WHEN t < -10 THEN 0 ELSE power(10, t / 10) END")
scalar("boxcox", lambda: W.boxcox(_c("refl"), 0.25, 5.0, -1.0), "CASE WHEN refl < 5 THEN -1 ELSE (power(refl, 0.25) - 1) / 0.25 END")
scalar("min_max_scaled", lambda: W.scaled(_c("refl"), 10.0, 40.0), "(least(greatest(refl, 10), 40) - 10) / 30.0")
scalar("lead_weight", lambda: W.piecewise(_c("refl"), [(10.0, 1.0), (20.0, 0.6), (40.0, 0.1)]), "CASE WHEN refl <= 10 THEN 1.0 WHEN refl <= 20 THEN 1.0 + (refl - 10) * -0.04 WHEN refl <= 40 THEN 0.6 + (refl - 20) * -0.025 ELSE 0.1 END")
scalar("convective_radius", lambda: W.convective_radius(_c("refl"), [(0, 1000), (25, 2000), (30, 3000), (35, 4000), (40, 5000)]), "CAST(CASE WHEN refl >= 40 THEN 5000 WHEN refl >= 35 THEN 4000 WHEN refl >= 30 THEN 3000 WHEN refl >= 25 THEN 2000 ELSE 1000 END AS DOUBLE)")
scalar("orographic_rate", lambda: W.orographic_rate(_c("t") + 273.15, _c("rh"), _p(), _c("att")), f"greatest(3600 / 461.5 * rh * {AIR} * att / (t + 273.15), 0)")
scalar("orographic_enhanced", lambda: W.enhance(_c("kdp"), _c("att"), add=False, threshold=0.2), "CASE WHEN kdp >= 0.2 THEN greatest(kdp - att, 0) ELSE kdp END")
scalar("friction_velocity", lambda: W.friction_velocity(_c("w"), F.lit(10.0), _c("att") + 0.01), "0.4 * w / ln(10.0 / (att + 0.01))")
scalar("gate_longitude", lambda: W.polar_to_lonlat(F.lit(116.0), F.lit(40.0), _c("refl") * 7, _c("w") * 10000)[0],
       "116 + degrees(atan2(sin(radians(refl * 7)) * sin(w * 10000 / 6371000.0) * cos(radians(40)), cos(w * 10000 / 6371000.0) - sin(radians(40)) * (sin(radians(40)) * cos(w * 10000 / 6371000.0) + cos(radians(40)) * sin(w * 10000 / 6371000.0) * cos(radians(refl * 7)))))")


def _codes_sql() -> str:
    """The rule table as SQL over long rows: a row for each cell and phenomenon, ranked by windows."""
    fine = {c: "r03 > 0 AND ptype = 1" for c in P.RAIN} | {c: "r03 > 0 AND ptype = 2" for c in P.SNOW}
    fine |= {"04": "r03 > 0 AND thunder >= 1", "05": "r03 > 0 AND hail >= 1", "06": "r03 > 0 AND ptype = 3", "19": "r03 > 0 AND ptype = 4", "00": "tcc <= 30", "01": "tcc > 30 AND tcc < 90", "02": "tcc >= 90"}
    fine |= {code: f"{name} = {level}" for name, codes in P.LEVELS.items() for level, code in codes.items()}
    amount = lambda kind, lo, hi: f"sum(CASE WHEN ptype = {kind} THEN r03 ELSE 0 END) >= {lo}" + (f" AND sum(CASE WHEN ptype = {kind} THEN r03 ELSE 0 END) < {hi}" if hi else "")
    whole = {c: amount(1, lo, hi) for c, (lo, hi) in P.RAIN.items()} | {c: amount(2, lo, hi) for c, (lo, hi) in P.SNOW.items()}
    whole |= {"04": "sum(r03) >= 0.1 AND bool_or(thunder >= 1)", "05": "sum(r03) >= 0.1 AND bool_or(r03 > 0 AND hail >= 1)", "06": "bool_or(ptype = 3 AND r03 > 0.1)", "19": "sum(r03) >= 0.1 AND bool_or(ptype = 4 AND r03 > 0.1)"}
    rows = " UNION ALL ".join(
        f"SELECT cell, '{c}' AS code, {i} AS rank, '{P._group(c)}' AS kin, bit_or(CASE WHEN {fine[c]} THEN 1 << CAST(step AS INTEGER) ELSE 0 END) AS bits, {whole.get(c, f'bool_or({fine[c]})')} AS here FROM s GROUP BY cell" for i, c in enumerate(P.RANKED)
    )
    first = lambda x: f"CASE WHEN {x}.bits = 0 THEN 4 WHEN {x}.bits % 2 = 1 THEN 0 WHEN ({x}.bits >> 1) % 2 = 1 THEN 1 WHEN ({x}.bits >> 2) % 2 = 1 THEN 2 ELSE 3 END"
    pairs = ", ".join(f"'{a}{b}'" for a, b in P.BETWEEN)
    return f"""
        WITH s AS (SELECT * FROM {T.STEPS}), r AS ({rows}),
        a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN here THEN rank WHEN code = '00' THEN 100 ELSE 1000 + rank END) = 1),
        b AS (SELECT r.* FROM r JOIN a ON r.cell = a.cell WHERE r.here AND r.code <> a.code AND (r.kin = '' OR r.kin <> a.kin) AND (r.bits & (15 - a.bits)) <> 0
              QUALIFY row_number() OVER (PARTITION BY r.cell ORDER BY r.rank) = 1),
        j AS (SELECT a.cell, a.code AS ca, b.code AS cb, a.rank < b.rank AS higher, bit_count(a.bits) AS la, bit_count(b.bits) AS lb, {first("a")} AS fa, {first("b")} AS fb,
              CASE WHEN b.code IS NULL THEN 0 WHEN (a.kin = 'fog' AND b.kin = 'haze') OR (a.kin = 'haze' AND b.kin = 'fog') THEN 3
                   WHEN least(a.code, b.code) || greatest(a.code, b.code) IN ({pairs}) AND (a.bits & (15 - b.bits)) <> 0 THEN 2 ELSE 1 END AS logic
              FROM a LEFT JOIN b ON a.cell = b.cell),
        o AS (SELECT *, CASE logic WHEN 0 THEN true WHEN 3 THEN higher WHEN 2 THEN la > lb OR (la = lb AND higher) ELSE fa < fb OR (fa = fb AND higher) END AS leads FROM j),
        f AS (SELECT cell, CASE WHEN leads THEN ca ELSE cb END AS a, CASE WHEN logic = 0 THEN ca WHEN leads THEN cb ELSE ca END AS b, CAST(logic AS INTEGER) AS logic FROM o)
        SELECT cell, a, b, logic, logic || a || b AS code FROM f"""


@query("phenomenon_codes", _codes_sql())
def phenomenon_codes(spark, d):
    return P.code_weather(T.weather_steps(spark, d), ["cell"])


@query("code_histogram", f"SELECT code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM ({_codes_sql()}) GROUP BY code ORDER BY n DESC, code LIMIT 20")
def code_histogram(spark, d):
    counts = phenomenon_codes(spark, d).groupBy("code").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "code").limit(20).select("code", "n", F.round(_c("n") / _c("total"), 4).alias("share"))


@query("threat_scores", f"""
    WITH g AS (SELECT m, grade, sum(CAST(f >= grade AND o >= grade AS INTEGER)) AS hits, sum(CAST(f < grade AND o >= grade AS INTEGER)) AS misses, sum(CAST(f >= grade AND o < grade AS INTEGER)) AS false_alarms
               FROM {T.MODELS}, (VALUES (0.1::DOUBLE), (10.0), (25.0), (50.0)) t(grade) GROUP BY m, grade)
    SELECT m, grade, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, CAST(false_alarms AS BIGINT) AS false_alarms, round(CASE WHEN hits + misses + false_alarms > 0 THEN hits / (hits + misses + false_alarms) ELSE 0 END, 4) AS ts,
           round(CASE WHEN hits + misses > 0 THEN (hits + false_alarms) / (hits + misses) END, 4) AS bias FROM g""")  # fmt: skip
def threat_scores(spark, d):
    out = R.contingency(T.models(spark, d), ["m"], "f", "o", [0.1, 10, 25, 50])
    return out.withColumn("ts", F.round("ts", 4)).withColumn("bias", F.round("bias", 4))


@query("similar_blocks", f"""
    WITH g AS (SELECT m, block, sum(CAST(f >= 25 AND o >= 25 AS INTEGER)) AS h, sum(CAST(f < 25 AND o >= 25 AS INTEGER)) AS s, sum(CAST(f >= 25 AND o < 25 AS INTEGER)) AS x FROM {T.MODELS} GROUP BY 1, 2),
    k AS (SELECT m, block, round(CASE WHEN h + s > 0 THEN h / (h + s + x) + 0.2 / (abs(9 * ((h + x) / (h + s) - 1)) + 1) ELSE -1 END, 6) AS score FROM g)
    SELECT m, block, score, CAST(row_number() OVER (PARTITION BY m ORDER BY score DESC, block) AS INTEGER) AS place FROM k QUALIFY place <= 5""")  # fmt: skip
def similar_blocks(spark, d):
    scored = R.contingency(T.models(spark, d), ["m", "block"], "f", "o", [25])
    scored = scored.select("m", "block", F.round(R.similarity(_c("ts"), _c("bias")), 6).alias("score"))
    return R.most_alike(scored, ["m"], "score", "block", 5)


@query("error_scores", f"SELECT m, round(avg(abs(f - o)), 4) AS mae, round(avg(CASE WHEN abs(f - o) <= 5 THEN 1.0 ELSE 0.0 END), 4) AS hit FROM {T.MODELS} GROUP BY ROLLUP (m)")
def error_scores(spark, d):
    out = R.error_scores(T.models(spark, d).withColumn("e", _c("f") - _c("o")), "m", "e", 5.0)
    return out.select("m", F.round("mae", 4).alias("mae"), F.round("hit", 4).alias("hit"))


@query("geometric_skill", f"SELECT id, round(exp(avg(ln(greatest(v / 1000.0, 1e-10)))), 4) AS skill FROM {T.SERIES} GROUP BY id")
def geometric_skill(spark, d):
    return R.geometric_mean(T.series(spark, d).withColumn("s", _c("v") / 1000.0), ["id"], "s").select("id", F.round("skill", 4).alias("skill"))


@query("kalman_error", f"""
    WITH s AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY day DESC) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM {T.SERIES})
    SELECT id, round(sum(v * CASE WHEN k = n - 1 THEN power(0.9, k) ELSE 0.1 * power(0.9, k) END), 4) AS me FROM s GROUP BY id""")  # fmt: skip
def kalman_error(spark, d):
    return R.decaying_mean(T.series(spark, d), ["id"], ["day"], "v", 0.1).select("id", F.round("me", 4).alias("me"))


@query("deaccumulated", f"SELECT id, day, round(greatest(v - coalesce(lag(v) OVER (PARTITION BY id ORDER BY day), 0), 0), 4) AS v FROM {T.SERIES}")
def deaccumulated(spark, d):
    return R.deaccumulate(T.series(spark, d), ["id"], "day", "v").select("id", "day", F.round("v", 4).alias("v"))


@query("between_days", f"""
    WITH s AS (SELECT id, day, v, lead(day) OVER w AS d1, lead(v) OVER w AS v1 FROM {T.SERIES} WINDOW w AS (PARTITION BY id ORDER BY day)),
    e AS (SELECT *, unnest(generate_series(day, coalesce(d1 - 1, day))) AS pt FROM s)
    SELECT id, pt AS day, round(CASE WHEN d1 IS NULL THEN v ELSE v + (pt - day) / (d1 - day)::DOUBLE * (v1 - v) END, 4) AS v FROM e""")  # fmt: skip
def between_days(spark, d):
    rows = T.series(spark, d).withColumn("day", _c("day").cast("long"))
    return R.between_steps(rows, ["id"], "day", "v", 1).select("id", "day", F.round("v", 4).alias("v"))


@query("box_mean", f"SELECT a.iy, a.ix, round(avg(b.v), 4) AS box FROM {T.GRID} a JOIN {T.GRID} b ON abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 2 GROUP BY 1, 2")
def box_mean(spark, d):
    return R.box_mean(T.grid(spark, d), [], 2, "v").select("iy", "ix", F.round("box", 4).alias("box"))


@query("circle_percentiles", f"SELECT a.iy, a.ix, round(quantile_cont(b.v, 0.25), 4) AS p25, round(quantile_cont(b.v, 0.9), 4) AS p90 FROM {T.GRID} a JOIN {T.GRID} b ON (a.iy - b.iy) * (a.iy - b.iy) + (a.ix - b.ix) * (a.ix - b.ix) <= 4 GROUP BY 1, 2")
def circle_percentiles(spark, d):
    out = R.circle_percentiles(T.grid(spark, d), [], 2.0, "v", [0.25, 0.9])
    return out.select("iy", "ix", F.round(_c("p")[0], 4).alias("p25"), F.round(_c("p")[1], 4).alias("p90"))


@query("local_lapse_rate", f"""
    SELECT a.iy, a.ix, round(CASE WHEN var_pop(b.z) > 1e-9 THEN regr_slope(b.v, b.z) ELSE -0.0098 END, 4) AS slope
    FROM {T.GRID} a JOIN {T.GRID} b ON abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 2 AND abs(a.z - b.z) <= 35 GROUP BY 1, 2""")  # fmt: skip
def local_lapse_rate(spark, d):
    return R.local_slope(T.grid(spark, d), 2, "v", "z", 35.0, W.LAPSE_K_PER_M).select("iy", "ix", F.round("slope", 4).alias("slope"))


@query("bilinear", f"""
    SELECT s.id, round(CASE WHEN count(g.v) = 4 THEN sum(g.v * (1 - abs(s.sy - c.y)) * (1 - abs(s.sx - c.x))) END, 4) AS v
    FROM {T.STATIONS} s, LATERAL (SELECT floor(s.sy) + a AS y, floor(s.sx) + b AS x FROM (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)) c
    LEFT JOIN {T.GRID} g ON g.iy = c.y AND g.ix = c.x GROUP BY s.id""")  # fmt: skip
def bilinear(spark, d):
    points = T.stations(spark, d).select("id", _c("sy").alias("fy"), _c("sx").alias("fx"))
    return R.bilinear(points, T.grid(spark, d), "v").select("id", F.round("v", 4).alias("v"))


@query("inverse_distance", f"""
    WITH d AS (SELECT g.iy, g.ix, s.value, greatest(sqrt(power(s.sy - g.iy, 2) + power(s.sx - g.ix, 2)), 1e-6) AS d, s.id FROM {T.GRID} g JOIN {T.STATIONS} s ON abs(s.sy - g.iy) <= 3 AND abs(s.sx - g.ix) <= 3),
    k AS (SELECT * FROM d WHERE d <= 3 QUALIFY row_number() OVER (PARTITION BY iy, ix ORDER BY d, id) <= 4),
    m AS (SELECT iy, ix, sum(value / power(d, 2)) / sum(1 / power(d, 2)) AS v FROM k GROUP BY 1, 2)
    SELECT g.iy, g.ix, round(coalesce(m.v, 0), 4) AS value FROM {T.GRID} g LEFT JOIN m USING (iy, ix)""")  # fmt: skip
def inverse_distance(spark, d):
    return R.inverse_distance(T.stations(spark, d), T.grid(spark, d), 4, 3, 2.0).select("iy", "ix", F.round("value", 4).alias("value"))


@query("snapped_stations", f"""
    SELECT g.iy, g.ix, coalesce(max(s.value), any_value(g.v)) AS value FROM {T.GRID} g LEFT JOIN {T.STATIONS} s ON CAST(floor(s.sy + 0.5) AS INTEGER) = g.iy AND CAST(floor(s.sx + 0.5) AS INTEGER) = g.ix GROUP BY 1, 2""")  # fmt: skip
def snapped_stations(spark, d):
    return R.snap_max(T.stations(spark, d), T.grid(spark, d).select("iy", "ix", _c("v").alias("value")))


@query("ensemble_reorder", f"""
    WITH a AS (SELECT id, member, row_number() OVER (PARTITION BY id ORDER BY value, member) AS r FROM {T.MEMBERS}),
    b AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY 2 * value + 1, member) AS r, 2 * value + 1 AS value FROM {T.MEMBERS})
    SELECT a.id, a.member, round(b.value, 4) AS value FROM a JOIN b USING (id, r)""")  # fmt: skip
def ensemble_reorder(spark, d):
    raw = T.members(spark, d)
    calibrated = raw.select("id", _c("member").alias("percentile"), (2 * _c("value") + 1).alias("value"))
    return R.ensemble_reorder(raw, calibrated, ["id"]).select("id", "member", F.round("value", 4).alias("value"))


@query("wet_mask", f"SELECT l_orderkey, l_linenumber, block, percent_rank() OVER (PARTITION BY block ORDER BY f DESC) < 0.3 AS wet FROM {T.MODELS}")
def wet_mask(spark, d):
    return R.wet_mask(T.models(spark, d), ["block"], "f", 0.3).select("l_orderkey", "l_linenumber", "block", "wet")


@query("matched_levels", f"""
    WITH s AS (SELECT block, x.level, avg(CASE WHEN o < x.level THEN 1.0 ELSE 0.0 END) AS s FROM {T.MODELS}, (VALUES (10.0::DOUBLE), (25.0), (40.0)) x(level) GROUP BY 1, 2),
    f AS (SELECT block, list_sort(list(f)) AS f, count(*) AS n FROM {T.MODELS} GROUP BY 1)
    SELECT s.block, s.level AS observed_level, round(f.f[CAST(floor(s.s * (n - 1)) AS BIGINT) + 1] + (s.s * (n - 1) - floor(s.s * (n - 1))) * (f.f[least(CAST(floor(s.s * (n - 1)) AS BIGINT) + 2, n)] - f.f[CAST(floor(s.s * (n - 1)) AS BIGINT) + 1]), 4) AS forecast_level
    FROM s JOIN f USING (block)""")  # fmt: skip
def matched_levels(spark, d):
    return R.matched_levels(T.models(spark, d), ["block"], "f", "o", [10, 25, 40]).select("block", "observed_level", F.round("forecast_level", 4).alias("forecast_level"))


@query("weighted_blend", f"SELECT block, round(sum(power(o + 1, -2) * f) / sum(power(o + 1, -2)), 4) AS blend FROM {T.MODELS} GROUP BY block")
def weighted_blend(spark, d):
    return R.weighted_blend(T.models(spark, d).withColumn("s", _c("o") + 1), ["block"], "f", "s").select("block", F.round("blend", 4).alias("blend"))


@query("lag_correlation", f"""
    WITH x AS (SELECT id, v, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b FROM {T.SERIES} WINDOW w AS (PARTITION BY id ORDER BY day)), g AS (SELECT id, corr(v, a) AS g1, corr(v, b) AS g2 FROM x GROUP BY id)
    SELECT id, round(g1, 4) AS gamma1, round(g2, 4) AS gamma2, round(g1 * (1 - g2) / (1 - g1 * g1), 4) AS phi1, round((g2 - g1 * g1) / (1 - g1 * g1), 4) AS phi2 FROM g""")  # fmt: skip
def lag_correlation(spark, d):
    out = R.lag_correlation(T.series(spark, d), ["id"], ["day"], "v")
    return out.select("id", *[F.round(c, 4).alias(c) for c in ("gamma1", "gamma2", "phi1", "phi2")])


@query("nearest_order", """
    WITH e AS (SELECT event_id, user_id % 50 AS u, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_id % 2 = 0), r AS (SELECT event_id AS other, user_id % 50 AS u, CAST(floor(epoch(ts)) AS BIGINT) AS t2 FROM events WHERE event_id % 2 = 1)
    SELECT e.event_id, e.u, e.t, r.t2, r.other FROM e JOIN r ON e.u = r.u AND abs(e.t - r.t2) <= 3600 QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - r.t2), r.t2, r.other) = 1""")  # fmt: skip
def nearest_order(spark, d):
    events = T.table(spark, d, "events").select("event_id", (_c("user_id") % 50).alias("u"), F.unix_timestamp(_c("ts").cast("timestamp")).alias("t"))
    right = events.where("event_id % 2 = 1").groupBy("u", _c("t").alias("t2")).agg(F.min("event_id").alias("other"))
    return R.nearest_in_time(events.where("event_id % 2 = 0"), right.select("u", "t2", "other"), ["u"], 3600)


@query("hourly_split", "SELECT ok, ln, round(part, 1) AS h1, round(part, 1) AS h2, round(kdp - 2 * part, 4) AS h3 FROM (SELECT *, CASE WHEN round(kdp / 3, 1) < 0.1 THEN 0 ELSE round(kdp / 3, 1) END AS part FROM " + T.MOMENTS + ")")
def hourly_split(spark, d):
    return T.moments(spark, d).withColumn("h", R.split_three(_c("kdp"))).select("ok", "ln", *[_c("h")[i].alias(f"h{i + 1}") for i in range(3)])


@query("complete_totals", f"SELECT cell, CASE WHEN count(r03) = 4 THEN round(sum(r03), 4) END AS total FROM {T.STEPS} GROUP BY cell")
def complete_totals(spark, d):
    return R.same_length_sum(T.weather_steps(spark, d), ["cell"], "r03", 4).select("cell", F.round("total", 4).alias("total"))


@query("valid_time_pairs", """
    SELECT f.l_suppkey AS id, f.l_linenumber AS dtime, f.l_orderkey AS f_key, o.l_orderkey AS o_key FROM lineitem f JOIN lineitem o
    ON f.l_suppkey = o.l_suppkey AND o.l_shipdate = f.l_shipdate + to_hours(24 * f.l_linenumber) WHERE o.l_linenumber = 1""")  # fmt: skip
def valid_time_pairs(spark, d):
    rows = T.table(spark, d, "lineitem").select(_c("l_suppkey").alias("id"), _c("l_shipdate").alias("time"), _c("l_linenumber").alias("k"), _c("l_orderkey").alias("key"))
    observed = rows.where("k = 1").select("id", "time", _c("key").alias("o_key"))
    forecast = rows.select("id", "time", _c("k").alias("n"), (_c("k") * 24).alias("dtime"), _c("key").alias("f_key"))
    return R.pair_on_valid_time(forecast, observed, ["id"]).select("id", _c("n").alias("dtime"), "f_key", "o_key")


def _embedded_fields(spark, d):
    """Embeddings as 8 x 8 fields: id, iy, ix, value."""
    m = T.members(spark, d)
    return m.select("id", F.floor(_c("member") / 8).cast("int").alias("iy"), (_c("member") % 8).cast("int").alias("ix"), "value")


FIELDS = f"(SELECT id, CAST(member // 8 AS INTEGER) AS iy, CAST(member % 8 AS INTEGER) AS ix, value FROM {T.MEMBERS})"


def _smooth9_sql(times: int) -> str:
    """Along an axis the ends stay (a line through the first two cells meets them) and the others take 1 2 1."""
    last, steps = FIELDS, []
    for n in range(times):
        for a, b in (("ix", "iy"), ("iy", "ix")):
            w = f"OVER (PARTITION BY id, {b} ORDER BY {a})"
            steps.append(f"{a}{n} AS (SELECT id, iy, ix, coalesce((lag(value) {w} + 2 * value + lead(value) {w}) / 4, value) AS value FROM {last})")
            last = f"{a}{n}"
    return f"WITH {', '.join(steps)} SELECT id, iy, ix, round(value, 4) AS value FROM {last}"


def _cascade_sql(level: int, levels: int, n: int = 8) -> str:
    """A band-pass part is a circular convolution; its kernel is the cosine sum of the band's weights."""
    wave = {(a, b): math.hypot(min(a, n - a), min(b, n - b)) for a in range(n) for b in range(n)}
    scale = {k: math.log(max(w, 0.5)) for k, w in wave.items()}
    low, high = min(scale.values()), max(scale.values())
    step = (high - low) / (levels - 1)
    parts = {k: [math.exp(-0.5 * ((x - low - i * step) / step) ** 2) for i in range(levels)] for k, x in scale.items()}
    kernel = {(y, x): sum(p[level] / sum(p) * math.cos(2 * math.pi * (a * y + b * x) / n) for (a, b), p in parts.items()) / n / n for y in range(n) for x in range(n)}
    rows = ", ".join(f"({y}, {x}, {k!r})" for (y, x), k in kernel.items())
    return f"SELECT id, CAST((iy + dy) % 8 AS INTEGER) AS iy, CAST((ix + dx) % 8 AS INTEGER) AS ix, round(sum(value * k), 4) AS value FROM {FIELDS}, (VALUES {rows}) w(dy, dx, k) GROUP BY 1, 2, 3"


def _rounded(df):
    return df.withColumn("value", F.round("value", 4))


@query("smooth9_fields", _smooth9_sql(2))
def smooth9_fields(spark, d):
    return _rounded(K.per_field(_embedded_fields(spark, d), "id", K.smooth9(2)))


@query("cascade_fields", _cascade_sql(1, 4))
def cascade_fields(spark, d):
    return _rounded(K.per_field(_embedded_fields(spark, d), "id", K.cascade_level(1, 4)))


@query("advected_fields", f"""
    WITH p AS (SELECT id, iy, ix, value, iy + 0.25 AS y, ix - 0.5 AS x FROM {FIELDS}), c AS (SELECT *, least(greatest(floor(y), 0), 6) AS y0, least(greatest(floor(x), 0), 6) AS x0 FROM p),
    m AS (SELECT c.id, c.iy, c.ix, sum(f.value * (1 - abs(c.y - f.iy)) * (1 - abs(c.x - f.ix))) AS moved FROM c JOIN {FIELDS} f ON f.id = c.id AND f.iy IN (c.y0, c.y0 + 1) AND f.ix IN (c.x0, c.x0 + 1) GROUP BY 1, 2, 3)
    SELECT id, iy, ix, round(CASE WHEN y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 THEN moved ELSE value END, 4) AS value FROM p JOIN m USING (id, iy, ix)""")  # fmt: skip
def advected_fields(spark, d):
    return _rounded(K.per_field(_embedded_fields(spark, d), "id", K.advect(0.5, -0.25)))


@query("labelled_fields", f"""
    WITH RECURSIVE f AS MATERIALIZED (SELECT id, iy, ix, iy * 8 + ix AS cell FROM {FIELDS} WHERE value >= 0.02),
    e AS MATERIALIZED (SELECT a.id, a.cell AS one, b.cell AS two FROM f a JOIN f b ON a.id = b.id AND abs(a.iy - b.iy) + abs(a.ix - b.ix) = 1),
    r AS (SELECT id, cell, cell AS reach FROM f UNION SELECT r.id, r.cell, e.two FROM r JOIN e ON e.id = r.id AND e.one = r.reach)
    SELECT id, iy, ix, CAST(coalesce(label, 0) AS DOUBLE) AS value FROM {FIELDS} LEFT JOIN (SELECT id, cell // 8 AS iy, cell % 8 AS ix, min(reach) + 1 AS label FROM r GROUP BY 1, 2, 3) USING (id, iy, ix)""")  # fmt: skip
def labelled_fields(spark, d):
    return K.per_field(_embedded_fields(spark, d), "id", K.labelled(0.02))
