"""What reaches the scans, and where intermediate tables may lie."""

import re
from types import SimpleNamespace

import pytest

from talea import session
from talea.plans import ledger, problems


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["list_before", "list_keyset", "hot_senders"])
def test_times_reach_the_scan(spark, data, name):
    text = plan(ledger.QUERIES[name](spark, data))
    assert any("created_at" in x for x in re.findall(r"PushedFilters: \[(.*)\]", text)), text


def test_columns_are_pruned(spark, data):
    scans = re.findall(r"ReadSchema: struct<(.*)>", plan(problems.QUERIES["p4_figures"](spark, data)))
    assert scans and all(set(re.findall(r"(\w+):", s)) == {"from_account", "to_account", "created_at"} for s in scans)


@pytest.mark.parametrize("name", ["p2_rolling", "p3_found", "p4_found", "p5_found"])
def test_no_nested_loops(spark, data, name):
    text = plan(problems.QUERIES[name](spark, data))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getConf=lambda: conf, applicationId="other", master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))
