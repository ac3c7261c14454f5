"""Scale properties read from the physical plans of registered queries."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF001


def plan(spark, name):
    df = E.queries()[name](spark, SF001)
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def scans(p, table):
    return re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}", p)


@pytest.mark.parametrize("name", ["vec_l2", "vec_neg_ip", "vec_cosine", "vec_normalize", "quantized_durations"])
def test_row_local_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_knn_reads_two_columns_and_shuffles_only_topk(spark):
    p = plan(spark, "knn_cosine")
    cols = {re.sub(r"#\d+L?", "", c) for c in scans(p, "embeddings")}
    assert cols == {"vec_id,embedding"}
    ex = re.findall(r"Exchange (\w+)\(([^)]*)\)", p)
    assert len(ex) == 1 and ex[0][0] == "hashpartitioning" and ex[0][1].startswith("qid")
    assert "WindowGroupLimit" in p and "MapInArrow" in p


def test_sweep_never_sort_merges_the_table(spark):
    p = plan(spark, "recall_sweep")
    assert not re.search(r"SortMergeJoin \[id#", p)
    assert re.search(r"BroadcastHashJoin \[id#\d+L\], \[id#\d+L\], Inner, BuildRight", p)


def test_ivf_search_prunes_lists(spark):
    p = plan(spark, "ivf_search")
    assert re.search(r"PartitionFilters: \[[^\]]*list_id[^\]]*dynamicpruning", p)


def test_scrub_reads_only_text_columns(spark):
    p = plan(spark, "scrub_counts")
    cols = {re.sub(r"#\d+L?", "", c) for c in scans(p, "documents")}
    assert cols == {"doc_id,text"}
