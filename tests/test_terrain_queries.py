import pytest

from orogen.plans import fixtures as fx
from orogen.plans.queries import ORACLES, QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, tiny, duck, name):
    got, want = same_rows(QUERIES[name](spark, tiny), duck, ORACLES[name])
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_partitioning_does_not_matter(spark, tiny):
    names = ["ridge_render", "dither_mask", "station_jitter", "poisson_points"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(tuple, QUERIES[q](spark, tiny).collect()), key=repr) for q in names])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_every_supplier_is_rendered(spark):
    d = "/root/testdata/sf0.1"
    n = fx.table(spark, d, "supplier").count()
    assert n > 100
    assert QUERIES["ridge_layers"](spark, d).select("inst_id").distinct().count() == n
    assert fx.peaks(spark, d).count() == n
    for name in ("ridge_render", "ridge_noise_render", "peak_render"):
        assert QUERIES[name](spark, d).filter("h is not null").count() == 64 * 64
