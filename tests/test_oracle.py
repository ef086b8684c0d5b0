"""Registered queries against their oracle text. All of them with TOUCHLINE_ALL=1, else a cross-section."""

import os

import pytest

from tests.harness import differences, duck
from touchline.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "league_table", "table_positions", "recent_form", "elo_ratings", "expected_goals_and_outcomes", "ticket_blocks", "typed_history",
    "sanitised_history", "file_audit", "xg_enriched", "config_evaluation", "source_metrics", "best_tickets", "ticket_columns",
    "settled_tickets", "matchday_diagnosis", "matchday_recommendations",
    "history_from_files", "typed_history_from_files", "published_history", "published_manifest", "xg_from_files", "matchdays_from_files", "roster_from_files",
)
NAMES = [n for n, q in REGISTRY.items() if q.sql] if os.environ.get("TOUCHLINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    got = REGISTRY[name].run(spark, SF).toPandas()
    want = con.execute(REGISTRY[name].sql).df()
    assert differences(got, want) == []


def test_oracle_texts_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
