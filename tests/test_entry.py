import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry_is_sound():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(
    "name",
    ["series_summary", "series_shape", "watch_list", "parse_ranges", "name_lookup", "suggest_mappings", "orphan_pairs", "rate_limit_hits", "stream_transitions", "normalised_rows", "code_ranking", "chart_requests", "prose_picks", "without_identity", "row_materials", "fused_rows", "computed_series", "stream_frames"],
)
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels pages conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    rel = con.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, DATA)
    columns = sorted(rel.columns)
    assert columns == sorted(found.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(str([flat(r[rel.columns.index(c)]) for c in columns]) for r in rel.fetchall())
    assert sorted(str([flat(r[c]) for c in columns]) for r in found.collect()) == want
