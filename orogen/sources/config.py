"""World declarations in YAML or JSON: parsing, validation, the compiled script."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORLD = "name string, width int, height int, min_y int, max_y int, sea_level int"
STRATA = "seq int, lo int, hi int, terrain string, slope_lo double, slope_hi double"

# The five strata and two layers of the published example.
EXAMPLE_STRATA = [
    {"seq": 0, "lo": -64, "hi": 61, "terrain": "Gravel / Sand", "slope_lo": None, "slope_hi": None},
    {"seq": 1, "lo": 62, "hi": 130, "terrain": "Grass / Bare Dirt", "slope_lo": 0.0, "slope_hi": 35.0},
    {"seq": 2, "lo": 131, "hi": 190, "terrain": "Podzol / Coarse", "slope_lo": None, "slope_hi": None},
    {"seq": 3, "lo": 191, "hi": 250, "terrain": "Stone / Cobblestone", "slope_lo": None, "slope_hi": None},
    {"seq": 4, "lo": 251, "hi": 320, "terrain": "Deep Snow", "slope_lo": None, "slope_hi": None},
]
EXAMPLE_LAYERS = {"Populate": "populate_mask", "Frost": "frost_mask"}


def parse(text: str) -> dict:
    """A declaration from JSON or YAML text."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text)


def load(spark: SparkSession, path: str) -> dict:
    """A declaration from one file, read through Spark's own file systems."""
    return parse("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def world_row(spark: SparkSession, config: dict) -> DataFrame:
    w = config.get("world", {})
    return spark.createDataFrame([tuple(w.get(f.split()[0]) for f in WORLD.split(", "))], WORLD)


def strata_rows(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(k, *s["range"], s["terrain"], *(map(float, s["slope_limit"]) if "slope_limit" in s else (None, None))) for k, s in enumerate(config.get("strata", []))]
    return spark.createDataFrame(rows, STRATA)


def strata_list(config: dict) -> list[dict]:
    out = []
    for k, s in enumerate(config.get("strata", [])):
        low, high = s.get("slope_limit", (None, None))
        out.append({"seq": k, "lo": s["range"][0], "hi": s["range"][1], "terrain": s["terrain"], "slope_lo": low, "slope_hi": high})
    return out


def input_rows(spark: SparkSession, config: dict) -> DataFrame:
    return spark.createDataFrame(sorted(config.get("inputs", {}).items()), "role string, path string")


def strata_violations(strata: DataFrame, min_y: int, max_y: int) -> DataFrame:
    """(rule, seq, detail): reversed ranges, gaps, overlaps, ranges beyond the build limits, bad slopes."""
    order = Window.partitionBy(F.lit(0)).orderBy("lo", "seq")  # strata are a handful of parameter rows
    rows = strata.withColumn("after", F.lead("lo").over(order))
    bad = F.array(
        F.when(F.col("lo") > F.col("hi"), F.lit("reversed")),
        F.when(F.col("after") > F.col("hi") + 1, F.lit("gap")),
        F.when(F.col("after") <= F.col("hi"), F.lit("overlap")),
        F.when((F.col("lo") < min_y) | (F.col("hi") > max_y), F.lit("outside")),
        F.when((F.col("slope_lo") > F.col("slope_hi")) | (F.col("slope_lo") < 0) | (F.col("slope_hi") > 90), F.lit("slope")),
    )
    return rows.select(F.explode(F.filter(bad, lambda r: r.isNotNull())).alias("rule"), "seq", F.concat_ws(" ", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("detail"))


def violations(spark: SparkSession, config: dict) -> DataFrame:
    """All violated rules of a declaration; empty when it is sound."""
    w = config.get("world", {})
    found = []
    for name in ("name", "width", "height", "min_y", "max_y", "sea_level"):
        if name not in w:
            found.append(("missing", None, f"world.{name}"))
    if not found:
        if w["width"] <= 0 or w["height"] <= 0:
            found.append(("size", None, f"{w['width']} {w['height']}"))
        if w["min_y"] >= w["max_y"]:
            found.append(("limits", None, f"{w['min_y']} {w['max_y']}"))
        elif not w["min_y"] <= w["sea_level"] <= w["max_y"]:
            found.append(("sea_level", None, str(w["sea_level"])))
    if "heightmap" not in config.get("inputs", {}):
        found.append(("missing", None, "inputs.heightmap"))
    out = spark.createDataFrame(found, "rule string, seq int, detail string")
    return out.unionByName(strata_violations(strata_rows(spark, config), w.get("min_y", -64), w.get("max_y", 320)))


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def compile_script(config: dict, layers: dict[str, str] | None = None, directory: str = ".minecraft/saves/world", version: str = "1.19 or later (Deepslate / 384 blocks)") -> list[str]:
    """The build script of a declaration, line by line; the same text for the same input."""
    w, inputs = config["world"], config["inputs"]
    layers = EXAMPLE_LAYERS if layers is None else layers
    lines = [
        'print("[1/4] Loading height map");',
        f"var heightMap = wp.getHeightMap().fromFile({_quoted(inputs['heightmap'])}).go();",
        'print("[2/4] Shaping the world");',
        "var world = wp.createWorld().fromHeightMap(heightMap).scale(100)"
        f".fromLevels(0, 65535).toLevels({w['min_y']}, {w['max_y']}).withWaterLevel({w['sea_level']})"
        f".withLowerBuildLimit({w['min_y']}).withUpperBuildLimit({w['max_y']}).go();",
        'print("[3/4] Applying layers");',
    ]
    for layer, role in layers.items():
        if role in inputs:
            name = re.sub(r"\W", "", layer.lower())
            lines += [
                f"var {name}Mask = wp.getHeightMap().fromFile({_quoted(inputs[role])}).go();",
                f"var {name}Layer = wp.getLayer().withName({_quoted(layer)}).go();",
                f"wp.applyHeightMap({name}Mask).toWorld(world).applyToLayer({name}Layer).fromLevels(128, 255).toLevel(1).go();",
            ]
    return [*lines, 'print("[4/4] Exporting");', f"wp.exportWorld(world).toDirectory({_quoted(directory)}).withGameVersion({_quoted(version)}).go();"]


def script_lines(spark: SparkSession, config: dict, **options: object) -> DataFrame:
    """(seq, line) of the compiled script."""
    return spark.createDataFrame(list(enumerate(compile_script(config, **options))), "seq int, line string")


def write_script(lines: DataFrame, path: str) -> None:
    lines.repartition(1).sortWithinPartitions("seq").select("line").write.mode("overwrite").text(path)  # one short script
