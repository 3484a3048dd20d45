"""Wind profiles over unresolved terrain: roughness and height corrections as array expressions, a row a cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the share to which a disturbance has decayed at the reference height.
DECAYED = 0.04


def profiles(df: DataFrame, keys: list[str], height: str, wind: str) -> DataFrame:
    """A row for each cell with `levels`, its (h, u) by height. Levels of a cell are few, so the list is bounded."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(height).alias("h"), F.col(wind).alias("u")))).alias("levels"))


def wind_at(levels: Column, height: Column) -> Column:
    """Linear between the levels around height; below the lowest a line to 0 at the ground.

    Above the highest level the line runs through the lowest and the highest.
    """
    first = F.get(levels, F.lit(0))
    up = F.coalesce(F.get(F.filter(levels, lambda x: x["h"] > height), F.lit(0)), first)
    low = F.coalesce(F.try_element_at(F.filter(levels, lambda x: x["h"] <= height), F.lit(-1)), first)
    between = low["u"] + (height - low["h"]) / (up["h"] - low["h"]) * (up["u"] - low["u"])
    return F.when(up["h"] == low["h"], F.try_divide(height, up["h"]) * up["u"]).otherwise(between)


def terrain_scale(df: DataFrame, spacing: float, model_spacing: float) -> DataFrame:
    """Adds amplitude, hilly, wavenumber and reference (height) from sigma and a_over_s.

    amplitude: half the height between valley and peak. Waves shorter than `spacing` or longer than six times
    `model_spacing` are held there. reference is within 1 m and twice the amplitude, 0 where the cell is not hilly.
    """
    amplitude = F.when(F.col("sigma") > 0, F.col("sigma") * math.sqrt(2))
    rows = df.withColumn("amplitude", amplitude).withColumn("hilly", F.coalesce((F.col("amplitude") > 0) & (F.col("a_over_s") > 0), F.lit(False)))
    wave = F.least(F.greatest(F.col("a_over_s") * math.pi / F.col("amplitude"), F.lit(math.pi / (3 * model_spacing))), F.lit(2 * math.pi / spacing))
    rows = rows.withColumn("wavenumber", F.when(F.col("hilly"), wave))
    reach = F.least(F.greatest(F.log(F.col("wavenumber") * F.col("amplitude")) - math.log(DECAYED), F.lit(0.0)), F.lit(1.0)) / F.col("wavenumber")
    reference = F.greatest(F.least(F.greatest(reach, F.lit(1.0)), 2 * F.col("amplitude")), F.lit(1.0))
    return rows.withColumn("reference", F.when(F.col("hilly"), reference).otherwise(0.0))


def corrected_profiles(df: DataFrame, spacing: float, model_spacing: float) -> DataFrame:
    """df (levels, sigma, a_over_s, z0, terrain, model_terrain) with `corrected`: (h, u) of each level.

    Under the reference height the wind follows the logarithm from z0 up to its old value there. Hills that the model
    smooths add their height difference, decaying upwards with the wavenumber; never below zero. Cells that are not
    hilly, or with a null level, keep their winds; without z0 above 0 the logarithm, without both terrains or a wind
    above 0 at the height of one inverse wavenumber the addition is left out. At height 0 the logarithm gives 0; where z0
    is the reference height, winds stay.
    """
    rows = terrain_scale(df, spacing, model_spacing)
    whole = ~F.exists("levels", lambda x: x["h"].isNull() | x["u"].isNull())
    rough = F.coalesce(F.col("hilly") & (F.col("z0") > 0) & whole, F.lit(False))
    rows = rows.withColumn("rough", rough).withColumn("at_reference", F.when(F.col("rough"), wind_at(F.col("levels"), F.col("reference"))))
    rows = rows.withColumn("driving", F.when(F.col("hilly") & whole, wind_at(F.col("levels"), 1 / F.col("wavenumber"))))
    lifted = F.when(F.col("driving") > 0, F.col("driving") * (F.col("terrain") - F.col("model_terrain")) * F.col("wavenumber"))
    rows = rows.withColumn("lifted", F.coalesce(lifted, F.lit(0.0)))

    def level(x: Column) -> Column:
        logarithm = F.try_divide(F.col("at_reference") * F.log(x["h"] / F.col("z0")), F.log(F.col("reference") / F.col("z0")))
        under = F.when(x["h"] <= 0, 0.0).otherwise(F.coalesce(logarithm, x["u"]))
        base = F.when(F.col("rough") & (x["h"] < F.col("reference")), under).otherwise(x["u"])
        decay = F.coalesce(F.col("wavenumber") * x["h"], F.lit(0.0))
        added = base + F.col("lifted") * F.when(decay > 1e-4, F.exp(-decay)).otherwise(1.0)
        return F.struct(x["h"].alias("h"), F.when(added < 0, 0.0).otherwise(added).alias("u"))

    return rows.withColumn("corrected", F.transform("levels", level)).select(*df.columns, "corrected")
