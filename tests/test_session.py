import glob

import pytest

from lavra.functions.arrow import ship
from lavra.session import CLEANUP, drop_materialized, materialize, shared_dir, tidy


def test_materialized_tables_keep_rows_and_can_be_dropped(spark):
    df = materialize(spark.range(10).selectExpr("id", "id % 3 as k").repartition(3), "some", "k")
    assert sorted(r.id for r in df.filter("k = 1").collect()) == [1, 4, 7]
    folder = shared_dir(spark).removeprefix("file://") + "/lavra/some-*"
    assert glob.glob(folder)
    drop_materialized(spark)
    assert not glob.glob(folder)


def test_settings_come_back(spark):
    before = spark.conf.get(CLEANUP, None)
    with pytest.raises(ValueError), tidy(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(CLEANUP, None) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://h:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_shipping_once(spark):
    ship(spark)
    ship(spark)
    assert spark.sparkContext._lavra_shipped
