import pytest

from hushframe import catalog
from tests.oracle import check

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, catalog.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_imports_without_the_training_data_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['hushframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'a8_pii_profile' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True)
