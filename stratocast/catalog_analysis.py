"""Registered queries of station analyses, radar classes and column profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocast.catalog import _embedded_fields, query, scalar
from stratocast.functions import calendar as C
from stratocast.operators import analysis as A
from stratocast.operators import blending as B
from stratocast.operators import calibration as E
from stratocast.operators import fields as K
from stratocast.operators import radar as D
from stratocast.operators import relational as R
from stratocast.plans import projections as T

_c = F.col
REACH = "sqrt(power(s.sy - g.iy, 2) + power(s.sx - g.ix, 2))"


def _cells(spark, d):
    return T.grid(spark, d).select("iy", "ix", _c("v").alias("value"))


def _cressman_sql(radii: list[int], floor: float) -> str:
    steps = [f"g0 AS (SELECT iy, ix, v AS value FROM {T.GRID}), st AS (SELECT * FROM {T.STATIONS})"]
    for n, r in enumerate(radii):
        steps.append(f"n{n} AS (SELECT s.id, s.value AS observed, g.iy, g.ix, g.value, power({REACH} + 0.001, -2) AS w FROM g{n} g JOIN st s ON {REACH} <= {r})")
        steps.append(f"p{n} AS (SELECT id, any_value(observed) - sum(w * value) / sum(w) AS step FROM n{n} GROUP BY id)")
        steps.append(f"m{n} AS (SELECT iy, ix, sum(w * step) / sum(w) AS step, sum(w) AS w FROM n{n} JOIN p{n} USING (id) GROUP BY 1, 2)")
        steps.append(f"g{n + 1} AS (SELECT g.iy, g.ix, CASE WHEN m.w >= 1e-5 AND g.value + m.step > {floor} THEN g.value + m.step ELSE g.value END AS value FROM g{n} g LEFT JOIN m{n} m USING (iy, ix))")
    return f"WITH {', '.join(steps)} SELECT iy, ix, round(value, 4) AS value FROM g{len(radii)}"


@query("cressman", _cressman_sql([4, 2], 0.1))
def cressman(spark, d):
    out = A.cressman(T.stations(spark, d), _cells(spark, d), [4, 2], floor=0.1)
    return out.select("iy", "ix", F.round("value", 4).alias("value"))


@query("nearest_residual", f"""
    WITH n AS (SELECT g.iy, g.ix, s.value, {REACH} AS d, s.id FROM {T.GRID} g JOIN {T.STATIONS} s ON {REACH} <= 3
               QUALIFY row_number() OVER (PARTITION BY g.iy, g.ix ORDER BY {REACH}, s.id) = 1)
    SELECT g.iy, g.ix, round(g.v + coalesce(exp(-power(n.d / 3, 2)) * n.value, 0), 4) AS value FROM {T.GRID} g LEFT JOIN n USING (iy, ix)""")  # fmt: skip
def nearest_residual(spark, d):
    return A.nearest_residual(T.stations(spark, d), _cells(spark, d), 3).select("iy", "ix", F.round("value", 4).alias("value"))


@query("spread_residuals", f"""
    WITH n AS (SELECT g.iy, g.ix, s.value, {REACH} + 1e-6 AS d FROM {T.GRID} g JOIN {T.STATIONS} s ON {REACH} <= 4
               QUALIFY row_number() OVER (PARTITION BY g.iy, g.ix ORDER BY {REACH}, s.id) <= 3),
    m AS (SELECT iy, ix, sum(power(d, -2) * exp(-power(d / 2, 2)) * value) / sum(power(d, -2)) AS m FROM n GROUP BY 1, 2)
    SELECT g.iy, g.ix, round(g.v + coalesce(m.m, 0), 4) AS value FROM {T.GRID} g LEFT JOIN m USING (iy, ix)""")  # fmt: skip
def spread_residuals(spark, d):
    return A.spread_residuals(T.stations(spark, d), _cells(spark, d), 4, 3, 2.0).select("iy", "ix", F.round("value", 4).alias("value"))


@query("terrain_bilinear", f"""
    SELECT s.id, round(CASE WHEN count(g.v) = 4 THEN sum((g.v + (s.value - g.z) * -0.0065 * 0.5) * (1 - abs(s.sy - c.y)) * (1 - abs(s.sx - c.x))) END, 4) AS v
    FROM {T.STATIONS} s, LATERAL (SELECT floor(s.sy) + a AS y, floor(s.sx) + b AS x FROM (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)) c
    LEFT JOIN {T.GRID} g ON g.iy = c.y AND g.ix = c.x GROUP BY s.id""")  # fmt: skip
def terrain_bilinear(spark, d):
    points = T.stations(spark, d).select("id", _c("sy").alias("fy"), _c("sx").alias("fx"), _c("value").alias("alt"))
    return A.terrain_bilinear(points, T.grid(spark, d), "v", "z", -0.0065, 0.5).select("id", F.round("v", 4).alias("v"))


scalar("level_map", lambda: A.level_map(_c("refl"), [8.0, 20.0, 35.0], [10.0, 25.0, 50.0]), "CASE WHEN refl < 8 THEN refl * 10.0 / 8 WHEN refl < 20 THEN 10 + 15.0 * (refl - 8) / 12 WHEN refl < 35 THEN 25 + 25.0 * (refl - 20) / 15 ELSE refl * 50.0 / 35 END")
scalar("fused", lambda: A.fused(_c("refl") - 20, _c("kdp"), F.lit(0.25)), "0.25 * greatest(refl - 20, 0) + 0.75 * greatest(kdp, 0)")


@query("sample_similarity", f"""
    WITH g AS (SELECT m, block, x.grade, sum(CAST(f >= grade AND o >= grade AS INTEGER)) AS h, sum(CAST(f < grade AND o >= grade AS INTEGER)) AS s, sum(CAST(f >= grade AND o < grade AS INTEGER)) AS x
               FROM {T.MODELS}, (VALUES (10.0::DOUBLE), (25.0), (45.0)) x(grade) GROUP BY 1, 2, 3)
    SELECT m, block, round(coalesce(avg(CASE WHEN h + s + x > 10 THEN h / (h + s + x + 0.001) * (1 + 0.2 / (abs(9 * ((h + x + 0.001) / (h + s + 0.001) - 1)) + 1)) END), 0), 4) AS score FROM g GROUP BY 1, 2""")  # fmt: skip
def sample_similarity(spark, d):
    counts = R.contingency(T.models(spark, d), ["m", "block"], "f", "o", [10, 25, 45])
    return A.sample_similarity(counts, ["m", "block"]).select("m", "block", F.round("score", 4).alias("score"))


@query("first_beyond", f"""
    WITH r AS (SELECT id, row_number() OVER w AS place, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM {T.SERIES} WINDOW w AS (PARTITION BY id ORDER BY day))
    SELECT id, CAST(coalesce(min(CASE WHEN total > 500 THEN place END), count(*)) AS INTEGER) AS length FROM r GROUP BY id""")  # fmt: skip
def first_beyond(spark, d):
    return A.first_beyond(T.series(spark, d), ["id"], [_c("day")], "v", 500.0)


def _numbered(spark, d):
    from pyspark.sql.window import Window

    return T.series(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("day")))


@query("amounts_at", f"""
    WITH r AS (SELECT id, v, row_number() OVER w AS k, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM {T.SERIES} WINDOW w AS (PARTITION BY id ORDER BY day))
    SELECT id, CAST((k - 1) * 6 + p AS INTEGER) AS at, round(total - v + p / 6.0::DOUBLE * v, 4) AS total FROM r, generate_series(1, 6) x(p)""")  # fmt: skip
def amounts_at(spark, d):
    return A.amounts_at(_numbered(spark, d), ["id"], "k", "v", 6).select("id", _c("at").cast("int").alias("at"), F.round("total", 4).alias("total"))


PROFILE = "(SELECT l_orderkey AS ok, l_linenumber AS lev, max(l_quantity) AS v, CAST(l_linenumber * 250 + min(l_partkey % 100) AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2)"


@query("level_gradient", f"""
    WITH r AS (SELECT *, lag(v) OVER w AS v0, lag(z) OVER w AS z0, lead(v) OVER w AS v1, lead(z) OVER w AS z1, row_number() OVER w AS r FROM {PROFILE} WINDOW w AS (PARTITION BY ok ORDER BY lev))
    SELECT ok, lev, CASE WHEN r = 1 THEN round((v1 - v) / nullif(z1 - z, 0), 9) ELSE round((v - v0) / nullif(z - z0, 0), 9) END AS gradient FROM r""")  # fmt: skip
def level_gradient(spark, d):
    rows = T.table(spark, d, "lineitem").groupBy(_c("l_orderkey").alias("ok"), _c("l_linenumber").alias("lev")).agg(F.max("l_quantity").alias("v"), F.min(_c("l_partkey") % 100).alias("z"))
    rows = rows.withColumn("z", (_c("lev") * 250 + _c("z")).cast("double"))
    return A.level_gradient(rows, ["ok"], "lev", "v", "z", 9).select("ok", "lev", "gradient")


@query("declustered", f"""
    SELECT CAST(floor(sy / 4) AS BIGINT) AS by, CAST(floor(sx / 4) AS BIGINT) AS bx, round(median(sy), 4) AS sy, round(median(sx), 4) AS sx, round(median(value), 4) AS value, count(*) AS n FROM {T.STATIONS} GROUP BY 1, 2 HAVING count(*) >= 2""")  # fmt: skip
def declustered(spark, d):
    out = A.declustered(T.stations(spark, d), [], "sy", "sx", ["value"], 4.0, 2)
    return out.select("by", "bx", *[F.round(c, 4).alias(c) for c in ("sy", "sx", "value")], "n")


@query("pair_gaps", f"SELECT block, round(avg(CASE WHEN f > 45 OR o < 3 THEN 1.0 ELSE 0.0 END), 4) AS gaps, avg(CASE WHEN f > 45 OR o < 3 THEN 1.0 ELSE 0.0 END) <= 0.15 AS usable FROM {T.MODELS} GROUP BY block")
def pair_gaps(spark, d):
    rows = T.models(spark, d).withColumn("f", F.when(_c("f") <= 45, _c("f"))).withColumn("o", F.when(_c("o") >= 3, _c("o")))
    return A.pair_gaps(rows, ["block"], "f", "o", 0.15).select("block", F.round("gaps", 4).alias("gaps"), "usable")


@query("best_parameter", f"""
    WITH t AS (SELECT block, eta, avg(abs(f - o)) AS e0, avg(abs(f * eta - o)) AS e FROM {T.MODELS}, (VALUES (0.5::DOUBLE), (0.8), (1.2)) x(eta) GROUP BY 1, 2),
    b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY block ORDER BY round(e, 9), eta) = 1)
    SELECT block, CASE WHEN round(e, 9) < round(e0, 9) THEN eta ELSE 0 END AS eta, round(CASE WHEN round(e, 9) < round(e0, 9) THEN e ELSE e0 END, 4) AS error FROM b""")  # fmt: skip
def best_parameter(spark, d):
    out = A.best_parameter(T.models(spark, d), ["block"], _c("f") * _c("eta"), "f", "o", [0.5, 0.8, 1.2])
    return out.select("block", "eta", F.round("error", 4).alias("error"))


LEVELS = [10.0, 20.0, 35.0]


@query("percentiles_from_probabilities", f"""
    WITH c AS (SELECT block, t, avg(CASE WHEN f < t THEN 1.0 ELSE 0.0 END) AS p FROM {T.MODELS}, (VALUES (10.0::DOUBLE), (20.0), (35.0)) x(t) GROUP BY 1, 2),
    a AS (SELECT * FROM c UNION ALL SELECT DISTINCT block, 0.0, 0.0 FROM c UNION ALL SELECT DISTINCT block, 60.0, 1.0 FROM c),
    s AS (SELECT *, lead(t) OVER w AS t1, lead(p) OVER w AS p1 FROM a WINDOW w AS (PARTITION BY block ORDER BY t, p))
    SELECT block, q AS percentile, round(t + (q / 100 - p) / (p1 - p) * (t1 - t), 4) AS value FROM s, (VALUES (25.0::DOUBLE), (50.0), (90.0)) x(q) WHERE p1 > p AND q / 100 >= p AND q / 100 < p1""")  # fmt: skip
def percentiles_from_probabilities(spark, d):
    rows = T.models(spark, d).withColumn("t", F.explode(F.array(*map(F.lit, LEVELS)))).groupBy("block", "t").agg(F.avg((_c("f") < _c("t")).cast("double")).alias("p"))
    out = A.percentiles_from_probabilities(rows, ["block"], "t", "p", [25.0, 50.0, 90.0], 0.0, 60.0)
    return out.select("block", "percentile", F.round("value", 4).alias("value"))


@query("filled_leads", f"""
    WITH s AS (SELECT id, CAST(day % 48 AS INTEGER) AS h, max(v) AS v FROM {T.SERIES} GROUP BY 1, 2), a AS (SELECT * FROM s WHERE h % 3 <> 0), b AS (SELECT id, h, v / 2 AS v FROM s),
    k AS (SELECT DISTINCT id, CAST(x AS INTEGER) AS h FROM s, generate_series(0, 60, 3) g(x))
    SELECT k.id, k.h, coalesce(a.v, b.v) AS v FROM k LEFT JOIN a USING (id, h) LEFT JOIN b USING (id, h)""")  # fmt: skip
def filled_leads(spark, d):
    s = T.series(spark, d).groupBy("id", (_c("day") % 48).cast("int").alias("h")).agg(F.max("v").alias("v"))
    return A.filled_leads(s.where("h % 3 <> 0"), s.withColumn("v", _c("v") / 2), ["id"], "h", "v", 3, 60)


@query("standardised_fit", f"""
    WITH p AS (SELECT id, day % 3 AS name, avg(v) AS v FROM {T.SERIES} GROUP BY 1, 2), k AS (SELECT DISTINCT id, n AS name, 0.5 + n AS coef, 20.0 + n AS mean, 5.0 AS std, id % 7 AS b0 FROM {T.SERIES}, generate_series(0, 2) g(n))
    SELECT k.id, round(CASE WHEN count(p.v) = count(*) THEN any_value(b0) + sum(coef * (p.v - mean) / std) END, 4) AS fitted FROM k LEFT JOIN p USING (id, name) GROUP BY k.id""")  # fmt: skip
def standardised_fit(spark, d):
    p = T.series(spark, d).groupBy("id", (_c("day") % 3).alias("name")).agg(F.avg("v").alias("v"))
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("name")
    k = T.series(spark, d).select("id").distinct().select("id", n, (_c("id") % 7).cast("double").alias("b0"))
    k = k.select("*", (0.5 + _c("name")).alias("coef"), (20.0 + _c("name")).alias("mean"), F.lit(5.0).alias("std"))
    return A.standardised_fit(p, ["id"], k, "name", "v").select("id", F.round("fitted", 4).alias("fitted"))


def _hydro_sql(band: str) -> str:
    """The class by SQL: distances as a list, the place of the least."""
    clip = lambda x, name: f"greatest(least(2 * ({x} - {D.LIMITS[name][1]}) / ({D.LIMITS[name][0]} - {D.LIMITS[name][1]}) - 1, 1), -1)"
    scaled = {
        "Zh": clip("refl", "Zh"), "ZDR": clip("(kdp * 3 - 1)", "ZDR"), "KDP": clip("10 * log10(greatest(kdp, -0.5) + 0.6)", "KDP"),
        "RhoHV": clip("10 * log10(1.0000000000001 - least(1 - att / 2 - 0.001, 1))", "RhoHV"), "relH": "(2 / (1 + exp(-0.005 * (t * 150))) - 1)",
    }
    rows = [" + ".join(f"{w} * power({c!r} - {name}, 2)" for name, c, w in zip(D.VARIABLES, centre, D.WEIGHTS, strict=True)) for centre in D.centred_centroids(band)]
    lists = "[" + ", ".join(f"sqrt({r})" for r in rows) + "]"
    return f"SELECT ok, ln, CAST(list_position(x, list_min(x)) AS INTEGER) AS class FROM (SELECT ok, ln, {lists} AS x FROM (SELECT ok, ln, {', '.join(f'{e}::DOUBLE AS {n}' for n, e in scaled.items())} FROM {T.MOMENTS}))"


def _moments(spark, d):
    rows = T.moments(spark, d)
    return rows, {"Zh": _c("refl"), "ZDR": _c("kdp") * 3 - 1, "KDP": _c("kdp"), "RhoHV": 1 - _c("att") / 2 - 0.001, "relH": _c("t") * 150}


@query("hydrometeor_class", _hydro_sql("C"))
def hydrometeor_class(spark, d):
    rows, moments = _moments(spark, d)
    return D.with_distances(rows, moments, "C", "x").select("ok", "ln", D.nearest_class(_c("x")).alias("class"))


@query("hydrometeor_entropy")
def hydrometeor_entropy(spark, d):
    rows, moments = _moments(spark, d)
    shares = D.with_shares(D.with_distances(rows, moments, "X", "x").select("ok", "ln", "x"), "x", "X", "shares", "e")
    return shares.select("ok", "ln", F.round("e", 6).alias("entropy"), "shares")


@query("gate_filter", f"SELECT ok, ln, t IS NULL OR coalesce(rh < 0.5, true) OR coalesce(kdp < 0.05, true) OR coalesce(refl < 5 OR refl > 45, true) AS excluded FROM {T.MOMENTS}")
def gate_filter(spark, d):
    bad = D.excluded_by_moments(_c("t"), _c("refl"), _c("rh"), _c("kdp"), 0.5, 0.05, (5.0, 45.0))
    return T.moments(spark, d).select("ok", "ln", bad.alias("excluded"))


@query("calendar", """
    SELECT o_orderkey AS ok, CAST(CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 1 WHEN month(o_orderdate) IN (6, 7, 8) THEN 2 WHEN month(o_orderdate) IN (9, 10, 11) THEN 3 ELSE 4 END AS INTEGER) AS season,
           CAST(dayofyear(o_orderdate) AS INTEGER) AS yearday, CAST(day(last_day(o_orderdate)) AS INTEGER) AS days, dayofyear(make_date(CAST(year(o_orderdate) AS BIGINT), 12, 31)) = 366 AS leap,
           strftime(o_orderdate, '%Y/%m/%d') || '/f.024' AS path FROM orders""")  # fmt: skip
def calendar(spark, d):
    day = _c("o_orderdate").cast("date")
    return T.table(spark, d, "orders").select(
        _c("o_orderkey").alias("ok"), C.season(day).alias("season"), C.year_day(day).alias("yearday"), C.month_days(day).alias("days"), C.leap(day).alias("leap"), C.path("YYYY/MM/DD/f.VVV", day.cast("timestamp"), F.lit(24)).alias("path")
    )


@query("same_days_before", """
    SELECT o_orderkey AS ok, CAST(count(*) AS INTEGER) AS n, min(x) AS first_day, max(x) AS last_day
    FROM (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE) - to_years(y) - INTERVAL 2 DAY, CAST(o_orderdate AS DATE) - to_years(y) + INTERVAL 2 DAY, INTERVAL 1 DAY))::DATE AS x FROM orders, (VALUES (1), (2)) t(y)) GROUP BY 1""")  # fmt: skip
def same_days_before(spark, d):
    days = T.table(spark, d, "orders").select(_c("o_orderkey").alias("ok"), F.explode(C.same_days_before(_c("o_orderdate").cast("date"), 2, 2)).alias("x"))
    return days.groupBy("ok").agg(F.count("*").cast("int").alias("n"), F.min("x").alias("first_day"), F.max("x").alias("last_day"))


def _echoes(spark, d):
    return _embedded_fields(spark, d).withColumn("value", _c("value") * 150 + 20)


@query("wavelet_classes")
def wavelet_classes(spark, d):
    return K.per_field(_echoes(spark, d), "id", D.wavelet_classes(2))


@query("convective_stratiform")
def convective_stratiform(spark, d):
    return K.per_field(_echoes(spark, d), "id", D.convective_stratiform(1000.0, 1000.0, radius=3000.0))


@query("convective_areas", f"""
    WITH f AS (SELECT id, iy, ix, value * 150 + 20 AS dbz FROM (SELECT id, CAST(member // 8 AS INTEGER) AS iy, CAST(member % 8 AS INTEGER) AS ix, value FROM {T.MEMBERS})),
    b AS (SELECT f.id, f.iy, f.ix, any_value(f.dbz) AS dbz, 10 * log10(avg(power(10, n.dbz / 10))) AS back FROM f JOIN f n ON f.id = n.id AND sqrt(power(f.iy - n.iy, 2) + power(f.ix - n.ix, 2)) <= 3 GROUP BY 1, 2, 3),
    c AS (SELECT *, CASE WHEN back >= 40 THEN 5 WHEN back >= 35 THEN 4 WHEN back >= 30 THEN 3 WHEN back >= 25 THEN 2 ELSE 1 END AS reach FROM b
          WHERE dbz >= 42 OR dbz - back >= CASE WHEN back < 0 THEN 10 WHEN back < 42.43 THEN 10 - back * back / 180 ELSE 0 END)
    SELECT f.id, f.iy, f.ix, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.id = f.id AND sqrt(power(f.iy - c.iy, 2) + power(f.ix - c.ix, 2)) <= c.reach) THEN 2.0::DOUBLE ELSE 1.0 END AS value FROM f""")  # fmt: skip
def convective_areas(spark, d):
    return K.per_field(_echoes(spark, d), "id", D.convective_stratiform(1000.0, 1000.0, radius=3000.0, in_order=False))


@query("anchored_velocity")
def anchored_velocity(spark, d):
    fields = _embedded_fields(spark, d)
    folded = fields.withColumn("value", F.pmod(_c("value") * 100 + 10, F.lit(20.0)) - 10)
    return B.per_pair(folded, fields.withColumn("value", _c("value") * 100), "id", D.anchored(10.0))


@query("unfolded_velocity")
def unfolded_velocity(spark, d):
    return K.per_field(_embedded_fields(spark, d).withColumn("value", F.pmod(_c("value") * 100 + 10, F.lit(20.0)) - 10), "id", D.unfolded(10.0))


COEFFICIENTS = "(SELECT DISTINCT id, id % 5 / 10.0::DOUBLE AS alpha, 0.9::DOUBLE AS beta, 0.1::DOUBLE AS gamma, 1.2::DOUBLE AS delta FROM " + T.MEMBERS + " WHERE id % 3 > 0)"


@query("calibrated_percentiles", f"""
    WITH f AS (SELECT id, avg(value) AS mean, coalesce(var_samp(value), 0) AS var FROM {T.MEMBERS} GROUP BY id),
    c AS (SELECT f.id, coalesce(alpha, 0) + coalesce(beta, 1) * mean AS loc, sqrt(power(coalesce(gamma, 0), 2) + power(coalesce(delta, 1), 2) * var) AS sc FROM f LEFT JOIN {COEFFICIENTS} k USING (id))
    SELECT id, q AS percentile, round(loc + z * sc, 4) AS value FROM c, (VALUES (10.0::DOUBLE, -1.2815515655446008::DOUBLE), (50.0, 0.0), (90.0, 1.2815515655446008)) x(q, z)""")  # fmt: skip
def calibrated_percentiles(spark, d):
    members = T.members(spark, d)
    k = members.where("id % 3 > 0").select("id").distinct().select("id", ((_c("id") % 5) / 10).alias("alpha"), F.lit(0.9).alias("beta"), F.lit(0.1).alias("gamma"), F.lit(1.2).alias("delta"))
    out = E.at_percentiles(E.calibrated(E.location_and_scale(members, ["id"], "value"), k, ["id"]), [10.0, 50.0, 90.0])
    return out.select("id", "percentile", F.round("value", 4).alias("value"))


@query("ensemble_fit")
def ensemble_fit(spark, d):
    """The fit of each return and status flag over all line items: f as mean, a spread from the tax, o as truth."""
    rows = T.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("m"), _c("l_quantity").alias("mean"), (_c("l_tax") * 100 + 1).alias("var"), (_c("l_partkey") % 51).cast("double").alias("truth"))
    return E.fit(rows, ["m"])


@query("upwind_mean", f"""
    WITH g AS (SELECT iy, ix, v AS value, CAST(iy - 8 AS DOUBLE) AS u, CAST(z / 20 AS DOUBLE) AS w FROM {T.GRID}), k AS (SELECT *, sqrt(u * u + w * w) AS speed, greatest(abs(u), abs(w)) / sqrt(u * u + w * w) AS lead FROM g),
    p AS (SELECT *, unnest(generate_series(0, CAST(floor(lead * 5) AS BIGINT) - 1)) AS step FROM k WHERE floor(lead * 5) > 0),
    q AS (SELECT iy, ix, speed, step / lead AS d, greatest(0, least(19, CAST(round_even(iy - step / lead * w / speed, 0) AS INTEGER))) AS sy, greatest(0, least(19, CAST(round_even(ix - step / lead * u / speed, 0) AS INTEGER))) AS sx FROM p),
    m AS (SELECT q.iy, q.ix, 0.25 * sum(exp(-0.5 * power(d / (speed * 102.0 / 1000), 2)) * g.value) / sum(exp(-0.5 * power(d / (speed * 102.0 / 1000), 2))) AS c FROM q JOIN g ON q.sy = g.iy AND q.sx = g.ix GROUP BY 1, 2)
    SELECT g.iy, g.ix, round(coalesce(m.c, 0), 4) AS carried FROM g LEFT JOIN m USING (iy, ix)""")  # fmt: skip
def upwind_mean(spark, d):
    g = T.grid(spark, d).select("iy", "ix", _c("v").alias("value"), (_c("iy") - 8).cast("double").alias("u"), (_c("z") / 20).alias("v"))
    return B.drifted(g, "value", (19, 19), 5000.0, 1000.0, 102.0, 0.25).select("iy", "ix", F.round("carried", 4).alias("carried"))


@query("skill_blend_fields")
def skill_blend_fields(spark, d):
    rows = _embedded_fields(spark, d).withColumn("value", F.abs("value") * 50)
    return B.per_pair(rows, rows.withColumn("value", 50 - _c("value")), "id", B.skill_blend(30, levels=4))
