import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import rows_of
from egresslens.plans.bridges import HOST, TABLES, packets
from egresslens.operators import filters, totals

from .conftest import SF

# A spread over the areas; check_oracle.py runs all of them at a larger scale.
CHECKED = ["t02_top_destinations", "a01_totals", "u06_all_findings", "d02_multipart_upload", "d11_smtp_attachment",
           "w02_unique_names", "w03_usb_history", "w05_tftp_transfers", "j08_tftp_assignment", "n01_lexical_features",
           "n02_response_features", "w01_single_pass_match", "w04_roc_counts", "n13_class_report", "n04_target_encoding",
           "s09_report_scan", "k07_text_report", "r05_streaming_matches"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 10


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_host_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    packets(spark, SF).write.parquet(path)
    plan = _plan(totals.outbound_by_destination(filters.host_filter(spark.read.parquet(path), HOST), HOST))
    assert f"EqualTo(ip.src,{HOST})" in plan
    assert "http" not in plan.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["j04_tlsh_distances", "j03_ssdeep_scores", "w01_single_pass_match", "j10_prefix_join"])
def test_no_cross_product(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
