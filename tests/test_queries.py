"""Every query of the library against its SQL, and the plans that matter."""

import zlib

import pytest

from reefline.plans import registry
from tests.compare import SMALL, database, same


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    same(registry.queries()[name](spark, SMALL).toPandas(), con.sql(registry.oracle_sql()[name]).df())


def test_split_tag_is_crc32(spark):
    rows = registry.queries()["split_tags"](spark, SMALL).limit(300).collect()
    for r in rows:
        assert (r.split == "val") == (zlib.crc32(f"{r.l_orderkey}_{r.l_linenumber}".encode()) % 11 == 0)


def test_tracker_query_keeps_one_track_for_each_lane(spark):
    rows = registry.queries()["sort_tracks"](spark, SMALL).toPandas()
    assert len(rows) and rows.groupby(["base_name", "frame"]).track_id.apply(lambda s: s.is_unique).all()


@pytest.mark.parametrize("name", ["event_track_association", "box_iou_pairs", "asof_height", "height_change"])
def test_no_cartesian_product(spark, name):
    plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_entry_has_every_query():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
