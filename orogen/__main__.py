"""Command line: build a world's column table and script from a declaration.

    python -m orogen CONFIG HEIGHTMAP OUT [--mask LAYER=PATH ...]
"""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .operators import world
    from .sources import config, png

    parser = argparse.ArgumentParser(prog="orogen", description="Column table and build script of a declared world.")
    parser.add_argument("config")
    parser.add_argument("heightmap", help="PNG file, folder or pattern")
    parser.add_argument("out", help="folder for columns/ and script/")
    parser.add_argument("--mask", action="append", default=[], metavar="LAYER=PATH")
    parser.add_argument("--tile", type=int, default=None, help="side of tiled PNG files")
    given = parser.parse_args(arguments)

    spark = SparkSession.builder.getOrCreate()
    declared = config.load(spark, given.config)
    broken = config.violations(spark, declared).collect()  # a handful of rules
    if any(r["rule"] not in ("gap",) for r in broken):
        raise SystemExit("\n".join(f"{r['rule']}: {r['detail']}" for r in broken))
    w = declared["world"]
    built = world.create_world(png.read_grey(spark, given.heightmap, given.tile), levels=(0, 65535, w["min_y"], w["max_y"]), water_level=w["sea_level"], lower=w["min_y"], upper=w["max_y"])
    layers = []
    for pair in given.mask:
        layer, _, path = pair.partition("=")
        world.require_layers([layer], list(config.EXAMPLE_LAYERS))
        built = world.apply_mask(built, png.read_grey(spark, path, given.tile), layer)
        layers.append(layer)
    world.column_table(built, config.strata_list(declared), layers).write.mode("overwrite").parquet(f"{given.out}/columns")
    config.write_script(config.script_lines(spark, declared), f"{given.out}/script")


if __name__ == "__main__":
    main()
