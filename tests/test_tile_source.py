import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orogen.sources import tile_source


def cells(spark, a, names):
    rows = [(int(z), int(x), *map(int, np.atleast_1d(a[z, x]))) for z, x in np.ndindex(a.shape[:2])]
    return spark.createDataFrame(rows, ", ".join(["z int", "x int", *(f"{n} int" for n in names)])).repartition(3)


@pytest.mark.parametrize(("bands", "bits"), [("v", 16), ("v", 8), ("r,g,b", 8), ("r,g,b", 16)])
def test_tiles_round_trip(spark, tmp_path, bands, bits):
    names = bands.split(",")
    a = np.random.default_rng(bits).integers(0, 1 << bits, (23, 31, len(names)))
    folder = str(tmp_path / "tiles")
    tile_source.write(cells(spark, a, names), folder, 8, bands, bits)
    assert len(os.listdir(folder)) == 3 * 4 and all(f.startswith("tile_") for f in os.listdir(folder))
    back = tile_source.read(spark, folder, 8, bands)
    got = np.full(a.shape, -1)
    for r in back.collect():
        assert (r["tile_z"], r["tile_x"]) == (r["z"] // 8, r["x"] // 8)
        got[r["z"], r["x"]] = [r[n] for n in names]
    assert (got == a).all() and back.rdd.getNumPartitions() == 12
    tile_source.write(cells(spark, a[:5, :5], names), folder, 8, bands, bits)  # takes the place of all tiles
    assert os.listdir(folder) == ["tile_0_0.png"]


def test_ranges_of_tile_keys_choose_files(spark, tmp_path):
    folder = str(tmp_path / "tiles")
    tile_source.write(cells(spark, np.arange(400).reshape(20, 20), ["v"]), folder, 5)
    some = tile_source.read(spark, folder, 5, tile_z="2:2", tile_x="1:")
    assert some.rdd.getNumPartitions() == 3
    for f in os.listdir(folder):  # no other file is opened
        if not f.startswith("tile_2_"):
            (tmp_path / "tiles" / f).write_bytes(b"damaged")
    even = some.filter("v % 2 = 0")
    assert {(r["z"], r["x"]) for r in even.collect()} == {(z, x) for z in range(10, 15) for x in range(5, 20) if (20 * z + x) % 2 == 0}
    assert some.count() == 75 and tile_source.read(spark, folder, 5, tile_z="2:2", tile_x=":1").count() == 50
    with pytest.raises(Exception, match="not a PNG"):
        tile_source.read(spark, folder, 5).count()


def test_failed_writes_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "tiles")
    tile_source.write(cells(spark, np.full((6, 6), 7), ["v"]), folder, 5)
    for bad, message in ((np.full((6, 6), 300), "does not fit"), (np.full((6, 6), -1), "does not fit")):
        with pytest.raises(Exception, match=message):
            tile_source.write(cells(spark, bad, ["v"]), folder, 5, bits=8)
    scattered = cells(spark, np.full((40, 40), 1), ["v"]).select(F.lit(0).alias("tile_z"), F.lit(0).alias("tile_x"), "z", "x", "v").repartition(4, "v", "z", "x")
    with pytest.raises(Exception, match="not together|by two tasks"):
        scattered.write.format("png_tiles").option("tile", 20).mode("overwrite").save(folder)
    back = tile_source.read(spark, folder, 5).collect()
    assert len(back) == 36 and {r["v"] for r in back} == {7} and not any(f.startswith("_") for f in os.listdir(folder))


def test_empty_folders(spark, tmp_path):
    assert tile_source.read(spark, str(tmp_path / "none"), 5).collect() == []
    tile_source.write(cells(spark, np.zeros((1, 1)), ["v"]).filter("z < 0"), str(tmp_path / "empty"), 5)
    assert tile_source.read(spark, str(tmp_path / "empty"), 5).collect() == []
