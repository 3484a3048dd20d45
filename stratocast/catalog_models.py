"""Registered queries of multi-model rain, wind profiles and satellite disks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratocast.catalog import _embedded_fields, query, scalar
from stratocast.functions import satellite as S
from stratocast.operators import blending, calibration, fields, radar
from stratocast.operators import multimodel as M
from stratocast.operators import nowcast as N
from stratocast.operators import profiles as P
from stratocast.plans import projections as T

_c = F.col
D = S.NOMINAL
E = f"(1 - power({D.minor}::DOUBLE / {D.major}, 2))"
CENTRIC = f"atan((1 - {E}) * tan(radians(refl)))"
RADIUS = f"({D.minor}::DOUBLE / sqrt(1 - {E} * power(cos({CENTRIC}), 2)))"
TURN = "radians(100 + t - 133)"
AWAY = f"({D.height}::DOUBLE - {RADIUS} * cos({CENTRIC}) * cos({TURN}))"
EAST = f"({RADIUS} * cos({CENTRIC}) * sin({TURN}))"
NORTH = f"({RADIUS} * sin({CENTRIC}))"
scalar("disk_line", lambda: S.line_column(_c("refl"), 100 + _c("t"), D)[0], f"1373.5::DOUBLE - asin({NORTH} / sqrt(power({AWAY}, 2) + power({EAST}, 2) + power({NORTH}, 2))) / {D.step}::DOUBLE")
scalar("disk_column", lambda: S.line_column(_c("refl"), 100 + _c("t"), D)[1], f"1373.5::DOUBLE + atan2({EAST}, {AWAY}) / {D.step}::DOUBLE")
X, Y = f"((w * 300 - 1373.5::DOUBLE) * {D.step}::DOUBLE)", f"((refl * 55 - 1373.5::DOUBLE) * {D.step}::DOUBLE)"
FLAT = f"power({D.major}::DOUBLE / {D.minor}, 2)"
AHEAD = f"({D.height}::DOUBLE * cos({X}) * cos({Y}))"
BEND = f"(power(cos({Y}), 2) + {FLAT} * power(sin({Y}), 2))"
ROOT = f"(power({AHEAD}, 2) - {BEND} * (power({D.height}::DOUBLE, 2) - power({D.major}::DOUBLE, 2)))"
FAR = f"(CASE WHEN {ROOT} >= 0 THEN ({AHEAD} - sqrt(greatest({ROOT}, 0))) / {BEND} END)"
scalar("disk_longitude", lambda: S.lat_lon(_c("refl") * 55, _c("w") * 300, D)[1], f"133 + degrees(atan2({FAR} * sin({X}) * cos({Y}), {D.height}::DOUBLE - {FAR} * cos({X}) * cos({Y})))")
scalar(
    "disk_latitude",
    lambda: S.lat_lon(_c("refl") * 55, _c("w") * 300, D)[0],
    f"degrees(atan({FLAT} * -({FAR} * sin({Y})) / sqrt(power({D.height}::DOUBLE - {FAR} * cos({X}) * cos({Y}), 2) + power({FAR} * sin({X}) * cos({Y}), 2))))",
)
scalar("calibrated_count", lambda: S.calibrated(_c("refl") - 3, F.array(*[F.lit(i * i / 8) for i in range(40)])), "CASE WHEN refl >= 3 AND refl < 43 THEN power(refl - 3, 2) / 8 END")

RAIN = "(SELECT l_returnflag || l_linestatus AS model, l_suppkey % 6 AS block, l_partkey AS id, max(l_quantity) AS forecast, CAST(l_partkey % 51 AS DOUBLE) AS observed FROM lineitem GROUP BY ALL)"
MODELS = ["AF", "NF", "NO", "RF", "XX"]
SCORES = f"""r AS (SELECT * FROM {RAIN} WHERE model IN ('AF', 'NF', 'NO', 'RF')), l AS (SELECT * FROM (VALUES (0.1::DOUBLE, 0.1::DOUBLE), (10.0, 0.15), (25.0, 0.3), (50.0, 0.45)) v(grade, w)),
    ms AS (SELECT unnest(['AF', 'NF', 'NO', 'RF', 'XX']) AS model), b AS (SELECT DISTINCT block FROM r),
    tf AS (SELECT block, model, grade, count(*) FILTER (forecast >= grade AND observed >= grade) AS h, count(*) FILTER (forecast >= grade OR observed >= grade) AS e FROM r, l GROUP BY ALL),
    te AS (SELECT x.block, x.model, y.model AS other, grade, count(*) FILTER (x.forecast >= grade AND y.forecast >= grade) AS h, count(*) FILTER (x.forecast >= grade OR y.forecast >= grade) AS e
        FROM r x JOIN r y USING (block, id), l GROUP BY ALL),
    al AS (SELECT block, model, grade, sum(CASE WHEN e >= 10 THEN h / e ELSE 0 END) / 5 AS alike FROM te GROUP BY ALL),
    raw AS (SELECT block, model, grade, coalesce(CASE WHEN e >= 10 THEN h / e END, 0) AS ts, coalesce(CASE WHEN e >= 10 THEN h / e END, 0) / (coalesce(alike, 0) + 100000) AS raw
        FROM b CROSS JOIN ms CROSS JOIN l LEFT JOIN tf USING (block, model, grade) LEFT JOIN al USING (block, model, grade)),
    tot AS (SELECT *, sum(raw) OVER (PARTITION BY block, grade) AS total, max(ts) OVER (PARTITION BY block, grade) AS best FROM raw),
    now AS (SELECT block, model, sum(w * CASE WHEN best >= 0.1 AND total > 0 THEN raw / total ELSE 0.2 END) AS now FROM tot JOIN l USING (grade) GROUP BY ALL),
    old AS (SELECT block, model, CASE WHEN block < 4 AND model <> 'AF' THEN block + length(model) ELSE 0 END AS old FROM now),
    sc AS (SELECT block, model, 0.9 * CASE WHEN sum(old) OVER (PARTITION BY block) = 0 THEN now ELSE old / sum(old) OVER (PARTITION BY block) END + 0.1 * now AS score FROM now JOIN old USING (block, model))"""


def _rain(spark, d):
    rows = T.table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("model"), (_c("l_suppkey") % 6).alias("block"), _c("l_partkey").alias("id"), "l_quantity", (_c("l_partkey") % 51).cast("double").alias("observed")
    )
    return rows.groupBy("model", "block", "id", "observed").agg(F.max("l_quantity").alias("forecast"))


def _multi_model(spark, d):
    history = _rain(spark, d)
    before = history.where("block < 4 and model in ('NF', 'NO', 'RF')").select("block", "model").distinct().withColumn("score", (_c("block") + 2).cast("double"))
    more = history.where("block < 4").select("block", F.lit("XX").alias("model")).distinct().withColumn("score", (_c("block") + 2).cast("double"))
    return M.multi_model_rain(history, history, before.unionByName(more), ["block"], "id", MODELS, 24)


@query("block_scores", f"WITH {SCORES} SELECT block, model, round(score, 4) AS score FROM sc")
def block_scores(spark, d):
    return _multi_model(spark, d)[1].select("block", "model", F.round("score", 4).alias("score"))


@query("multi_model_rain", f"""
    WITH {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC, model DESC) AS rk FROM sc),
    w AS (SELECT k.block, k.model, score / (sum(score) OVER (PARTITION BY k.block) + 1e-6::DOUBLE) AS weight FROM k SEMI JOIN r ON k.block = r.block AND k.model = r.model WHERE rk <= 5)
    SELECT q.block, q.id, round(coalesce(sum(weight * forecast), 0), 4) AS value FROM {RAIN} q LEFT JOIN w USING (block, model) GROUP BY 1, 2""")  # fmt: skip
def multi_model_rain(spark, d):
    return _multi_model(spark, d)[0].select("block", "id", F.round("value", 4).alias("value"))


@query("training_blocks", """
    SELECT CAST(b.i AS INTEGER) AS by, CAST(c.i AS INTEGER) AS bx, count(*) AS n FROM supplier, (SELECT unnest(generate_series(0, 3)) AS i) b, (SELECT unnest(generate_series(0, 4)) AS i) c
    WHERE s_suppkey * 13 % 40 BETWEEN (b.i - 1) * 10 AND (b.i + 2) * 10 AND s_suppkey * 7 % 60 BETWEEN (c.i - 1) * 12 AND (c.i + 2) * 12 GROUP BY ALL""")  # fmt: skip
def training_blocks(spark, d):
    rows = T.table(spark, d, "supplier").select((_c("s_suppkey") * 13 % 40).alias("y"), (_c("s_suppkey") * 7 % 60).alias("x"))
    return M.training_blocks(rows, "y", "x", (10.0, 12.0), 1, (4, 5)).groupBy("by", "bx").agg(F.count("*").alias("n"))


@query("corrected_profiles", """
    WITH p AS (SELECT l_partkey % 300 AS cell, 5.0::DOUBLE * l_linenumber * l_linenumber AS h, max(l_quantity) / 4 AS u FROM lineitem GROUP BY ALL),
    s AS (SELECT DISTINCT cell, CAST(cell % 40 AS DOUBLE) AS sigma, cell % 7 / 20.0::DOUBLE AS a, cell % 5 / 10.0::DOUBLE AS z0, CAST(cell % 90 - cell % 50 AS DOUBLE) AS dz FROM p),
    k AS (SELECT *, sigma * sqrt(2) AS amp, sigma > 0 AND a > 0 AS hilly, CASE WHEN sigma > 0 AND a > 0 THEN least(greatest(a * pi() / (sigma * sqrt(2)), pi() / 12000), 2 * pi() / 1000) END AS k FROM s),
    f AS (SELECT *, CASE WHEN hilly THEN greatest(least(greatest(least(greatest(ln(k * amp) - ln(0.04::DOUBLE), 0), 1) / k, 1), 2 * amp), 1) ELSE 0 END AS ref FROM k),
    q AS (SELECT f.*, goal, which FROM f, LATERAL (VALUES (ref, 'r'), (1 / k, 'd')) v(goal, which) WHERE hilly),
    e AS (SELECT q.cell, which, goal, coalesce(min(h) FILTER (h > goal), min(h)) AS h1, coalesce(arg_min(u, h) FILTER (h > goal), arg_min(u, h)) AS u1, coalesce(max(h) FILTER (h <= goal), min(h)) AS h0,
        coalesce(arg_max(u, h) FILTER (h <= goal), arg_min(u, h)) AS u0 FROM q JOIN p ON q.cell = p.cell GROUP BY 1, 2, 3),
    w AS (SELECT cell, which, CASE WHEN h1 = h0 THEN goal / h1 * u1 ELSE u0 + (goal - h0) / (h1 - h0) * (u1 - u0) END AS u FROM e)
    SELECT p.cell, p.h, round(greatest(0, CASE WHEN hilly AND z0 > 0 AND p.h < ref THEN r.u * ln(p.h / z0) / ln(ref / z0) ELSE p.u END + CASE WHEN hilly AND d.u > 0 THEN d.u * dz * k * exp(-k * p.h) ELSE 0 END), 3) AS u
    FROM p JOIN f ON p.cell = f.cell LEFT JOIN w r ON r.cell = p.cell AND r.which = 'r' LEFT JOIN w d ON d.cell = p.cell AND d.which = 'd'""")  # fmt: skip
def corrected_profiles(spark, d):
    h = 5.0 * _c("l_linenumber") * _c("l_linenumber")
    rows = T.table(spark, d, "lineitem").groupBy((_c("l_partkey") % 300).alias("cell"), h.alias("h")).agg((F.max("l_quantity") / 4).alias("u"))
    c = _c("cell")
    cells = P.profiles(rows, ["cell"], "h", "u").withColumns(
        {"sigma": (c % 40).cast("double"), "a_over_s": (c % 7) / 20, "z0": (c % 5) / 10, "terrain": (c % 90).cast("double"), "model_terrain": (c % 50).cast("double")}
    )
    return P.corrected_profiles(cells, 1000.0, 4000.0).select("cell", F.inline("corrected")).select("cell", "h", F.round("u", 3).alias("u"))


@query("nowcast_fields")
def nowcast_fields(spark, d):
    """Two members and two leads of every three successive embeddings, taken as steps of one field."""
    rows = _embedded_fields(spark, d).withColumn("step", (_c("id") % 3).cast("int")).withColumn("id", F.floor(_c("id") / 3)).withColumn("value", F.abs("value") * 10)
    return N.nowcast(rows, "id", 2, members=2, levels=3, half=3, fewest=20)


@query("linear_fit", f"""
    WITH r AS (SELECT hydro, att * 100 AS p, kdp AS q, t AS y FROM {T.MOMENTS}),
    m AS (SELECT hydro, avg(p) AS mp, avg(q) AS mq, avg(y) AS my, covar_pop(p, p) AS pp, covar_pop(q, q) AS qq, covar_pop(p, q) AS pq, covar_pop(y, p) AS yp, covar_pop(y, q) AS yq FROM r GROUP BY hydro),
    s AS (SELECT *, (yp * qq - yq * pq) / (pp * qq - pq * pq) AS b1, (yq * pp - yp * pq) / (pp * qq - pq * pq) AS b2 FROM m)
    SELECT hydro, round(my - b1 * mp - b2 * mq, 4) AS a, round(b1, 4) AS b1, round(b2, 4) AS b2 FROM s""")  # fmt: skip
def linear_fit(spark, d):
    rows = T.moments(spark, d).select("hydro", (_c("att") * 100).alias("p"), _c("kdp").alias("q"), _c("t").alias("y"))
    fits = calibration.linear_fit(rows, ["hydro"], ["p", "q"], "y")
    return fits.select("hydro", *[F.round(F.get("coefficients", F.lit(i)), 4).alias(n) for i, n in enumerate(("a", "b1", "b2"))])


@query("advected_along")
def advected_along(spark, d):
    rows = _embedded_fields(spark, d)
    return fields.per_fields(rows.withColumn("u", _c("value") * 2).withColumn("v", _c("iy") * 0.1), "id", ["value", "u", "v"], fields.advect_along(2))


@query("feature_classes")
def feature_classes(spark, d):
    return fields.per_field(_embedded_fields(spark, d).withColumn("value", _c("value") * 150 + 20), "id", radar.feature_classes(1000.0, 1000.0, radius=3000.0, least_cells=2))


@query("salient_blend")
def salient_blend(spark, d):
    rows = _embedded_fields(spark, d)
    return blending.per_pair(rows, rows.withColumn("value", _c("value") * -0.5 + 0.1), "id", blending.salient_blend(0.7))
