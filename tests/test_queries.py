"""Every query of the catalogue on small tables, against SQL where there is some."""

import pytest

from lorespark.plans import catalog

from .conftest import SF
from .oracle import assert_same

#: These read tables that only the larger folders hold, or take long; test_small.py has their operators, and
#: test_extract.py those over all documents, whose invented prose holds no events.
SMALL = sorted(k for k in catalog.QUERIES if not k.endswith("_of_documents") and k not in {"prepared_corpus", "bindings_table", "category_list", "graph_neighbours", "date_range_rows", "place_rows", "integrity_violations", "duplicate_names", "lineage", "entities_merged", "events_nearest", "relations_found", "claims_made", "places_found", "entity_types", "date_records"})


@pytest.mark.parametrize("name", [k for k in SMALL if k in catalog.ORACLE_SQL])
def test_matches_sql(spark, name):
    assert_same(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, SF)


@pytest.mark.parametrize("name", [k for k in SMALL if k not in catalog.ORACLE_SQL])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["events_nearest", "relations_found", "claims_made", "places_found", "integrity_violations"])
def test_larger_tables(spark, name):
    assert_same(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, "/root/testdata/sf0.01")


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["item_id", "doc_id", "rank", "score"]
    assert 0 < df.count() <= 400
