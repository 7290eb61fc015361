"""Stages that several steps share are computed once."""

import pytest

from partloom.plans import REGISTRY, labels
from partloom.session import SharedStages

TABLES = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_equal_plans_are_stored_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a"))
    stage = SharedStages()
    first = stage(spark.read.parquet(str(tmp_path / "a")).filter("id > 1"), "a")
    assert stage(spark.read.parquet(str(tmp_path / "a")).filter("id > 1"), "a") is first
    assert stage(spark.read.parquet(str(tmp_path / "a")).filter("id > 2"), "a") is not first


@pytest.mark.parametrize("name", ["part_scores", "best_part", "ambiguity", "membership_summary", "visibility_pixels"])
def test_queries_scan_few_tables(spark, name, monkeypatch):
    """The points are read from the input once, and the last step reads three stored stages at most."""
    computed = []

    class Counted(SharedStages):
        def __call__(self, df, stage):
            known = sum(map(len, self._stored.values()))
            stored = super().__call__(df, stage)
            if sum(map(len, self._stored.values())) > known:
                computed.append((stage, df))
            return stored

    monkeypatch.setattr(labels, "SharedStages", Counted)
    result = REGISTRY[name].plan(spark, TABLES)
    stages = [n for n, _ in computed]
    assert len(stages) == len(set(stages)) and {"points", "owners", "scores"} <= set(stages)
    plans = [df._jdf.queryExecution().executedPlan().toString() for _, df in computed] + [result._jdf.queryExecution().executedPlan().toString()]
    assert sum("embeddings.parquet" in p for p in plans) == 1
    assert 1 <= scans(result) <= 3
