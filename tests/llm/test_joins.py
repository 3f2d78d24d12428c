"""Joins of rows that Spark takes for fewer bytes than they are."""

import pytest
from pyspark.sql import functions as F

from turnwise.llm import components, simhash


@pytest.mark.parametrize("bucket", [1, simhash.BUCKET])
def test_no_table_of_fingerprints_or_edges_is_broadcast(spark, monkeypatch, bucket):
    plans = []
    for module in (simhash, components):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, plain=plain: plans.append(df) or plain(df, label))
    prints = spark.range(300).select((F.col("id") * 3).alias("fp"))
    links = simhash.fingerprint_links(prints, bucket)
    found = components.connected_components(links)
    assert found.count() == 300
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*plans, links)]
    assert not any("BroadcastHashJoin" in plan for plan in plans) and any("SortMergeJoin" in plan for plan in plans)
