"""Every query of the catalogue against its SQL, or as a run with a stable schema where SQL has no form."""

import pytest

import __spark_entry__ as driver
from listwright.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, name):
    assert compare(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf) is None


#: Rows of the queries without SQL, as counted on the view beside them (at least one row where there is no count).
ROWS = {"topic_scores": "documents", "projected_points": "listings", "html_description": "pages", "export_json": "listings", "export_markdown": "listings", "dataset_shuffled": "documents", "corridor_polygons": None, "corridor_count": None, "html_links": None, "html_elements": None, "vectors_indexed": None, "towns_in_corridors": None, "corridor_outline_members": None}


def test_all_queries_are_tested():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(ROWS)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf)
    if not ROWS[name]:
        assert got.count() > 0
        return
    own = catalog.view(spark, sf, ROWS[name])
    if name == "projected_points":
        own = own.filter("latitude IS NOT NULL")
    assert got.count() == own.count()


def test_driver_contract(spark):
    assert driver.entry(spark).columns == ["id", "title", "price", "rooms", "source_name"]
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(catalog.QUERIES) <= set(driver.queries())
