"""Every registered query against its SQL on the smallest tables."""

import pytest

from partloom.plans import REGISTRY
from tests.compare import compare, connect

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(TABLES)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, REGISTRY[name], TABLES) is None


def test_entry_runs(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_lives_without_the_training_data_packages(tmp_path):
    """Without the subpackage, or without a package that it imports, the other queries are still there."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "tiktoken.py").write_text("raise ImportError('left out')")
    code = "import __spark_entry__ as d; q = d.queries(); print(len(q), 'quota_selection' in q, any(n.startswith('op') for n in q))"
    for path, training in ((root, True), (f"{tmp_path}:{root}", False)):
        out = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) >= len(REGISTRY) and out[1] == "True"
        if not training or not os.path.isdir(f"{root}/partloom/llm"):
            assert out[2] == "False"
