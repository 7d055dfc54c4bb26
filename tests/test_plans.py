"""Shapes of plans: what reaches the scan, what is broadcast, what is summed before a shuffle."""

import re

from pyspark.sql import functions as F

from multiweave.operators import fulltext, geosearch, joins, temporal
from multiweave.plans import queries as core
from multiweave.session import read

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(core.QUERIES["filter_eq"](spark, D))
    assert "EqualTo(o_orderstatus,F)" in p and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>", p)
    assert "l_comment" not in plan(core.QUERIES["scan_project"](spark, D)) and "l_discount" not in plan(core.QUERIES["scan_project"](spark, D))


def test_box_of_a_radius_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 21.0, 52.0)], "id long, lon double, lat double").write.parquet(f"{tmp_path}/p")
    p = plan(geosearch.within_radius(spark.read.parquet(f"{tmp_path}/p"), 21.0, 52.0, 1000))
    assert "GreaterThanOrEqual(lon" in p and "PushedFilters: [IsNotNull(l" in p  # the text of the plan is cut short after some filters


def test_aggregates_are_summed_before_the_shuffle(spark):
    for name in ("agg_group_by", "ts_time_bucket", "hist_as_of", "mv_count_sum_avg"):
        assert "partial_" in plan(core.QUERIES[name](spark, D)), name


def test_sketches_are_not_carried_with_distinct_keys(spark):
    p = plan(core.QUERIES["agg_approximate"](spark, D))
    assert "approx_count_distinct" in p
    assert not [x for x in p.splitlines() if re.search(r"keys=\[l_returnflag#\d+, l_orderkey#\d+\w*\]", x) and "approx_" in x]


def test_ranks_come_from_counts(spark):
    p = plan(core.QUERIES["win_rank_dense"](spark, D))
    assert "partial_count" in p and "BroadcastHashJoin" in p and "dense_rank" not in p


def test_no_pairs_of_all_rows(spark):
    for name in ("join_range_bins", "join_asof", "join_salted", "join_inner", "join_multi_star"):
        p = plan(core.QUERIES[name](spark, D))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_top_k_moves_k_rows_a_task(spark):
    assert "TakeOrderedAndProject" in plan(core.QUERIES["vec_cosine_knn"](spark, D)) and "TakeOrderedAndProject" in plan(core.QUERIES["topk"](spark, D))


def test_no_python_where_columns_do(spark):
    docs = read(spark, D, "documents")
    log = read(spark, D, "events").select(F.col("event_id").alias("lsn"), F.lit(1).alias("at"), F.lit("upsert").alias("op"), F.col("user_id").alias("key"))
    for df in (fulltext.bm25(docs, "a b", id_col="doc_id", text_col="text"), temporal.history(log, "key"), joins.salted_join(log, log.select("key").distinct(), "key"), core.QUERIES["doc_project"](spark, D), core.QUERIES["vec_scalar_quantize"](spark, D)):
        assert not re.search("Python|Pandas|Arrow", plan(df))
