import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from scripts.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["clean_customers", "user_features", "segment_top_items", "sample_negatives", "generate_candidates", "top_k_similar"]


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns[:3] == ["segment_key", "segment_rank", "article_id"] and df.count() > 0


def test_every_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = entry_points.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["user_totals", "purchase_sequence", "generate_candidates", "top_k_similar", "ranking_train"])
def test_plans_have_no_cartesian_product(spark, name):
    plan = entry_points.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_points_work_without_the_optional_operators():
    """With the pipeline and its operators gone, everything else is still registered."""
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "assert 'user_features' in e.queries() and not [q for q in (*e.queries(), *e.oracle_sql()) if q.startswith('op')]"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
