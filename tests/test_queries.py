"""Every audit query against its SQL, on the smallest tables."""

import pytest
from oracle import SMALL, same

from dossierlake.plans import file_queries, registry, whole_audit


@pytest.fixture(scope="module", autouse=True)
def shared_audit():
    """The queries of the whole audit take their stages from one run here."""
    found, own = {}, whole_audit.driver_audit

    def shared(spark, sf_dir):
        if sf_dir not in found:
            found[sf_dir] = own(spark, sf_dir)
        return found[sf_dir]

    whole_audit.driver_audit = file_queries.driver_audit = shared
    yield
    whole_audit.driver_audit = file_queries.driver_audit = own


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name], spark)


@pytest.mark.parametrize("name", sorted(registry.LITERAL))
def test_literal_rows(spark, name):
    module = registry.LITERAL[name]
    same(module.QUERIES[name], module.ORACLE_SQL[name], spark)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry_is_a_frame_of_every_project(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
