"""Coded weather phenomena: identify, select, judge and encode 12-hour weather from 3-hourly fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.functions.cleaning import cloud_percent

# Codes by influence (highest first), amounts in mm, cloud in per cent, exclusive groups and pairs.
RANKED = "12 37 36 17 11 10 05 16 15 09 19 31 20 65 64 63 58 57 14 06 08 04 62 56 30 07 55 61 02 01 00".split()
RAIN = {"07": (0.1, 10.0), "08": (10.0, 25.0), "09": (25.0, 50.0), "10": (50.0, 100.0), "11": (100.0, 250.0), "12": (250.0, None)}
SNOW = {"14": (0.1, 2.5), "15": (2.5, 5.0), "16": (5.0, 10.0), "17": (10.0, 20.0), "36": (20.0, 30.0), "37": (30.0, None)}
LEVELS = {"fog": {1: "61", 2: "62", 3: "63", 4: "64", 5: "65"}, "haze": {1: "55", 2: "56", 3: "57", 4: "58"}, "sand": {1: "30", 2: "20", 3: "31"}}
GROUPS = {"rain": "12 11 10 05 09 19 08 04 07", "snow": "37 36 17 16 15 14", "fog": "65 64 63 62 61", "haze": "58 57 56 55", "sand": "31 20 30"}
BETWEEN = [("00", "01"), ("01", "02"), ("02", "07")]
WET = 0.1


def _group(code: str) -> str:
    return next((g for g, codes in GROUPS.items() if code in codes.split()), "")


def code_weather(steps: DataFrame, keys: list[str], cloud_unit: str = "%") -> DataFrame:
    """keys, a, b, logic and code of each cell and segment, from rows with step 0 to 3, r03, ptype, tcc, fog, haze, sand, thunder, hail.

    Phenomena are bit sets over the four steps, so the whole rule table is one aggregation and array expressions.
    Nulls count as nothing there (cloud: 50 per cent). cloud_unit: "%", "1" (fractions), or "auto", which takes a table
    whose greatest cloud (nulls as 50) is at most 1.1 for fractions; the driver reads that one number.
    """
    if cloud_unit == "1":
        steps = steps.withColumn("tcc", F.coalesce(F.col("tcc") * 100.0, F.lit(50.0)))
    elif cloud_unit == "auto":
        filled = F.coalesce(F.col("tcc").cast("double"), F.lit(50.0))
        steps = steps.withColumn("tcc", cloud_percent(filled, F.lit(steps.agg(F.max(filled)).first()[0])))
    get = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    r, kind, cloud = get("r03"), get("ptype"), get("tcc", 50.0)
    bits = lambda cond: F.bit_or(F.when(cond, F.call_function("shiftleft", F.lit(1), F.col("step").cast("int"))).otherwise(0))
    fine = {
        "rain": (r > 0) & (kind == 1), "snow": (r > 0) & (kind == 2), "storm": (r > 0) & (get("thunder") >= 1), "hail": (r > 0) & (get("hail") >= 1),
        "sleet": (r > 0) & (kind == 3), "ice": (r > 0) & (kind == 4), "c00": cloud <= 30, "c01": (cloud > 30) & (cloud < 90), "c02": cloud >= 90,
    }
    for name, codes in LEVELS.items():
        fine |= {f"c{code}": F.floor(get(name)) == level for level, code in codes.items()}
    sums = [
        F.sum(F.when(kind == 1, r).otherwise(0.0)).alias("rain_mm"), F.sum(F.when(kind == 2, r).otherwise(0.0)).alias("snow_mm"), F.sum(r).alias("all_mm"),
        F.max(get("thunder") >= 1).alias("any_storm"), F.max((kind == 3) & (r > WET)).alias("any_sleet"), F.max((kind == 4) & (r > WET)).alias("any_ice"),
    ]
    cell = steps.groupBy(*keys).agg(*sums, *[bits(c).alias(f"f_{n}") for n, c in fine.items()])
    col = lambda n: F.col(f"f_{n}")
    within = lambda v, lo, hi: (v >= lo) & (v < hi) if hi else v >= lo
    seen: dict[str, tuple[Column, Column]] = {}
    for code, (lo, hi) in RAIN.items():
        seen[code] = (within(F.col("rain_mm"), lo, hi), col("rain"))
    for code, (lo, hi) in SNOW.items():
        seen[code] = (within(F.col("snow_mm"), lo, hi), col("snow"))
    wet = F.col("all_mm") >= WET
    seen |= {"04": (wet & F.col("any_storm"), col("storm")), "05": (wet & (col("hail") > 0), col("hail")), "06": (F.col("any_sleet"), col("sleet")), "19": (wet & F.col("any_ice"), col("ice"))}
    for code in ["00", "01", "02", *(c for codes in LEVELS.values() for c in codes.values())]:
        seen[code] = (col(f"c{code}") > 0, col(f"c{code}"))
    one = lambda code: F.struct(F.lit(code).alias("code"), F.lit(RANKED.index(code)).alias("rank"), F.lit(_group(code)).alias("kin"), seen[code][1].alias("bits"), seen[code][0].alias("here"))
    cell = cell.withColumn("all", F.array(*map(one, RANKED)))
    present = F.filter("all", lambda x: x["here"])
    cell = cell.withColumn("present", present).withColumn("first", F.when(F.size("present") > 0, F.element_at("present", 1)).otherwise(F.element_at("all", len(RANKED))))
    other = F.filter(
        "present",
        lambda x: (x["code"] != F.col("first.code")) & ((x["kin"] == "") | (x["kin"] != F.col("first.kin"))) & (x["bits"].bitwiseAND(F.bitwise_not(F.col("first.bits"))) != 0),
    )
    cell = cell.withColumn("second", F.when(F.size(other) > 0, F.element_at(other, 1)))
    a, b = "first", "second"
    start = lambda x: F.when(F.col(f"{x}.bits") == 0, 4).otherwise(F.instr(F.reverse(F.lpad(F.bin(F.col(f"{x}.bits").cast("long")), 4, "0")), "1") - 1)
    length = lambda x: F.bit_count(F.col(f"{x}.bits"))
    kin = F.array(F.col(f"{a}.kin"), F.col(f"{b}.kin"))
    joined = F.array_contains(kin, "fog") & F.array_contains(kin, "haze")
    pair = F.concat(F.least(f"{a}.code", f"{b}.code"), F.greatest(f"{a}.code", f"{b}.code")).isin([x + y for x, y in BETWEEN])
    # the second differs from the first by a step of its own; alternating needs the same of the first
    swings = F.col(f"{a}.bits").bitwiseAND(F.bitwise_not(F.col(f"{b}.bits"))) != 0
    higher = F.col(f"{a}.rank") < F.col(f"{b}.rank")
    logic = F.when(F.col(b).isNull(), 0).when(joined, 3).when(pair & swings, 2).otherwise(1)
    leads = (
        F.when(logic == 0, True)
        .when(logic == 3, higher)
        .when(logic == 2, (length(a) > length(b)) | ((length(a) == length(b)) & higher))
        .otherwise((start(a) < start(b)) | ((start(a) == start(b)) & higher))
    )
    front = F.when(leads, F.col(f"{a}.code")).otherwise(F.col(f"{b}.code"))
    back = F.when(F.col(b).isNull(), F.col(f"{a}.code")).when(leads, F.col(f"{b}.code")).otherwise(F.col(f"{a}.code"))
    out = cell.select(*keys, front.alias("a"), back.alias("b"), logic.cast("int").alias("logic"))
    return out.withColumn("code", F.concat(F.col("logic").cast("string"), "a", "b"))


# Names of codes and of the four relations.
NAMES = {
    "00": "晴", "01": "多云", "02": "阴", "04": "雷阵雨", "05": "雷阵雨并伴有冰雹", "06": "雨夹雪", "07": "小雨", "08": "中雨", "09": "大雨", "10": "暴雨", "11": "大暴雨", "12": "特大暴雨", "14": "小雪", "15": "中雪", "16": "大雪", "17": "暴雪",
    "19": "冻雨", "20": "沙尘暴", "30": "扬沙或浮尘", "31": "强沙尘暴", "36": "大暴雪", "37": "特大暴雪", "55": "轻度霾", "56": "中度霾", "57": "重度霾", "58": "严重霾", "61": "轻雾", "62": "大雾", "63": "浓雾", "64": "强浓雾", "65": "特强浓雾",
}
RELATIONS = {"1": "转", "2": "间", "3": "伴有"}


def decoded(code: Column) -> Column:
    """A code (number or text of up to five digits) as logic, a, b, their names and the phrase."""
    text = F.lpad(code.cast("string"), 5, "0")
    name = lambda table, key: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.concat(F.lit("未知("), key, F.lit(")")))
    logic, a, b = F.substring(text, 1, 1), F.substring(text, 2, 2), F.substring(text, 4, 2)
    phrase = F.when(logic == "0", name(NAMES, a)).otherwise(F.concat(name(NAMES, a), name(RELATIONS, logic), name(NAMES, b)))
    return F.struct(logic.cast("int").alias("logic"), a.alias("a"), b.alias("b"), name(NAMES, a).alias("a_name"), name(NAMES, b).alias("b_name"), phrase.alias("phrase"))
